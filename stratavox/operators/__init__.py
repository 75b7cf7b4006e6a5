"""Operators on labelled volumes: DataFrames of voxels (x, y, z, v), longs, without background rows."""
