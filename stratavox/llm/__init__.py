"""Training-data operators: deduplication, filtering, extraction, privacy and packing on DataFrames."""
