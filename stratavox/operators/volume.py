"""Volumes: the grid, voxel ids, blocks, windows, and exchange of block halos.

A volume is a DataFrame (x, y, z, v) of its non-zero voxels; missing voxels are background. A ``Grid`` has what a dataset's
metadata would: dimensions, block size, resolution and offset in nanometres.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

XYZ = ["x", "y", "z"]


@dataclass(frozen=True)
class Grid:
    dim: tuple[int, int, int]
    block: tuple[int, int, int] = (32, 32, 32)
    resolution: tuple[float, float, float] = (4.0, 4.0, 4.0)
    offset: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @property
    def blocks(self) -> tuple[int, int, int]:
        return tuple(-(-d // b) for d, b in zip(self.dim, self.block, strict=True))

    def voxels(self, nm: float) -> float:
        """A length in voxels."""
        return nm / self.resolution[0]

    def volume_voxels(self, nm3: float) -> float:
        return nm3 / (self.resolution[0] * self.resolution[1] * self.resolution[2])

    def index(self) -> Column:
        """The 1-based linear id of a voxel, x fastest."""
        return self.dim[0] * self.dim[1] * F.col("z") + self.dim[0] * F.col("y") + F.col("x") + 1

    def position(self, voxel_id: Column) -> dict[str, Column]:
        """Coordinates of a linear id."""
        i = voxel_id - 1
        nx, ny, _ = self.dim
        return {"x": i % nx, "y": F.floor(i / nx) % ny, "z": F.floor(i / (nx * ny))}

    def inside(self) -> Column:
        return F.col("x").between(0, self.dim[0] - 1) & F.col("y").between(0, self.dim[1] - 1) & F.col("z").between(0, self.dim[2] - 1)

    def block_key(self) -> list[Column]:
        return [F.floor(F.col(c) / b).alias(f"b{c}") for c, b in zip(XYZ, self.block, strict=True)]


def blocks(spark: SparkSession, grid: Grid, pad: int = 0) -> DataFrame:
    """Rows (bx, by, bz, ox, oy, oz, dx, dy, dz) of every block, cropped at the end and grown by pad on each side."""
    nx, ny, nz = grid.blocks
    at = spark.range(nx * ny * nz).select((F.col("id") % nx).alias("bx"), (F.floor(F.col("id") / nx) % ny).alias("by"), F.floor(F.col("id") / (nx * ny)).alias("bz"))
    for c, d, b in zip(XYZ, grid.dim, grid.block, strict=True):
        start = F.col(f"b{c}") * b
        at = at.withColumns({f"o{c}": start - pad, f"d{c}": F.least(F.lit(b), F.lit(d) - start) + 2 * pad})
    return at


def existing_blocks(volume: DataFrame, grid: Grid) -> DataFrame:
    """The blocks that hold a voxel, with their number of voxels."""
    return volume.groupBy(*grid.block_key()).agg(F.count("*").alias("voxels"))


def window(volume: DataFrame, offset: tuple[int, int, int], dim: tuple[int, int, int]) -> DataFrame:
    """The voxels of a box, in the volume's coordinates."""
    return volume.where(" and ".join(f"{c} between {o} and {o + d - 1}" for c, o, d in zip(XYZ, offset, dim, strict=True)))


def permute(volume: DataFrame, order: str) -> DataFrame:
    """Axes in another order, such as "zyx"."""
    return volume.select(*(F.col(old).alias(new) for new, old in zip(XYZ, order, strict=True)), "v")


def physical(grid: Grid) -> dict[str, Column]:
    """Coordinates in nanometres."""
    return {f"{c}_nm": F.col(c) * r + o for c, r, o in zip(XYZ, grid.resolution, grid.offset, strict=True)}


def stencil(volume: DataFrame, keep: str, radius: int = 1) -> DataFrame:
    """Each voxel once for each lattice offset (dx, dy, dz; d2 its squared length) that passes ``keep``, moved by it.

    The voxel's own place is (x0, y0, z0); its other columns stay.
    """
    names = [c for c in volume.columns if c not in XYZ]
    out = volume.select(*(F.col(c).alias(f"{c}0") for c in XYZ), *names)
    for c in XYZ:
        out = out.withColumn(f"d{c}", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    out = out.withColumn("d2", (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).cast("long")).where(keep)
    return out.select(*((F.col(f"{c}0") + F.col(f"d{c}")).alias(c) for c in XYZ), *(f"{c}0" for c in XYZ), *names, "d2")


_DENSE = {"long": np.int64, "bigint": np.int64, "int": np.int64, "double": np.float64, "float": np.float64, "boolean": np.bool_}


def spread_to_blocks(rows: DataFrame, grid: Grid, halo: int) -> DataFrame:
    """Each row once for each block (bx, by, bz) that it is in or within the halo of."""
    near = []
    for c, b, d in zip(XYZ, grid.block, grid.dim, strict=True):
        low, high = F.floor((F.col(c) - halo) / b), F.floor((F.col(c) + halo) / b)
        near.append(F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(-(-d // b) - 1))))
    rest = [c for c in rows.columns]
    out = rows.select(*rest, F.explode(near[0]).alias("bx"), near[1].alias("ys"), near[2].alias("zs"))
    return out.select(*rest, "bx", F.explode("ys").alias("by"), "zs").select(*rest, "bx", "by", F.explode("zs").alias("bz"))


class Block:
    """What a kernel gets: dense arrays [x, y, z] by column, with the halo; missing and null values are 0."""

    def __init__(self, arrays: dict[str, np.ndarray], corner: tuple[int, ...], dim: tuple[int, ...], halo: int):
        self.arrays, self.corner, self.dim, self.halo = arrays, corner, dim, halo
        self.shape = next(iter(arrays.values())).shape
        self.core = tuple(slice(halo, n - halo) for n in self.shape)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.arrays[name]

    def inside(self) -> np.ndarray:
        """Which places are in the volume."""
        ok = [(np.arange(n) + o >= 0) & (np.arange(n) + o < d) for n, o, d in zip(self.shape, self.corner, self.dim, strict=True)]
        return ok[0][:, None, None] & ok[1][:, None] & ok[2]

    def moved(self, a: np.ndarray, by: tuple[int, int, int], fill=0) -> np.ndarray:
        """The array of each place's neighbour at an offset."""
        out = np.full_like(a, fill)
        here = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(by, a.shape, strict=True))
        there = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(by, a.shape, strict=True))
        out[here] = a[there]
        return out

    def rows(self, where: np.ndarray, **columns: np.ndarray) -> dict[str, np.ndarray]:
        """Columns x, y, z and others of the places in the block itself where a condition holds."""
        at = np.nonzero(where[self.core])
        xyz = {c: (a + o + self.halo).astype(np.int64) for c, a, o in zip(XYZ, at, self.corner, strict=True)}
        return xyz | {name: a[self.core][at] for name, a in columns.items()}


def over_blocks(rows: DataFrame, grid: Grid, halo: int, kernel: Callable[[Block], dict[str, np.ndarray]], schema: str, only: DataFrame | None = None, every: bool = False) -> DataFrame:
    """Runs a numpy kernel on each block with its halo; the kernel's columns are the result's rows.

    rows has x, y, z and value columns; several volumes may be united with nulls in each other's columns. A voxel goes to the few blocks whose halo it is
    in, so one exchange brings every block what it needs. Blocks without any row are skipped unless every is set; only (bx, by, bz) names the blocks to run.
    """
    names = [c for c in rows.columns if c not in XYZ]
    kinds = {c: _DENSE[rows.schema[c].dataType.simpleString()] for c in names}
    spread = spread_to_blocks(rows, grid, halo)
    if only is not None:
        spread = spread.join(only, ["bx", "by", "bz"], "left_semi")
    if every:
        spread = spread.unionByName(blocks(rows.sparkSession, grid).select("bx", "by", "bz"), allowMissingColumns=True)
    block, dim = grid.block, grid.dim

    def run(t: pa.Table) -> pa.Table:
        col = lambda c: t.column(c).combine_chunks()
        corner = tuple(int(col(f"b{c}")[0].as_py()) * b - halo for c, b in zip(XYZ, block, strict=True))
        size = tuple(min(b, d - (o + halo)) + 2 * halo for b, d, o in zip(block, dim, corner, strict=True))
        at = [np.asarray(col(c).fill_null(-(1 << 40))) - o for c, o in zip(XYZ, corner, strict=True)]
        ok = np.logical_and.reduce([(a >= 0) & (a < n) for a, n in zip(at, size, strict=True)])
        arrays = {}
        for name in names:
            arrays[name] = np.zeros(size, kinds[name])
            own = ok & np.asarray(col(name).is_valid())
            arrays[name][tuple(a[own] for a in at)] = np.asarray(col(name).fill_null(0 if kinds[name] != np.bool_ else False))[own]
        return pa.table(kernel(Block(arrays, corner, dim, halo)))

    return spread.groupBy("bx", "by", "bz").applyInArrow(run, schema)


def map_blocks(volume: DataFrame, grid: Grid, halo: int, kernel: Callable[[np.ndarray, tuple[int, int, int]], np.ndarray], out: str = "long") -> DataFrame:
    """over_blocks for one volume and one dense result of the padded array's shape: rows (x, y, z, v) of its non-zero places."""

    def run(b: Block) -> dict[str, np.ndarray]:
        done = kernel(b["v"], b.corner)
        return b.rows(done != 0, v=done.astype(np.int64 if out == "long" else np.float64))

    return over_blocks(volume.select(*XYZ, "v"), grid, halo, run, f"x long, y long, z long, v {out}")


def united(**volumes: DataFrame) -> DataFrame:
    """Rows (x, y, z, name, name, ...) of several volumes (x, y, z, v), each value under its volume's name and null under the others'."""
    out = None
    for name, volume in volumes.items():
        own = volume.select(*XYZ, F.col("v").alias(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
