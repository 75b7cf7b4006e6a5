"""Volumes over the driver's tables, with coordinates modular in the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.operators.volume import XYZ, Grid

GRID = Grid((64, 64, 32), (32, 32, 16))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z, v) with v the greatest quantity of the line items at a place."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = t.select((F.col("l_orderkey") % 64).alias("x"), (F.col("l_partkey") % 64).alias("y"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 32).alias("z"), F.col("l_quantity").cast("long").alias("v"))
    return at.groupBy(*XYZ).agg(F.max("v").alias("v"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z, v) with v from 1 to 40, by customer of the orders at a place."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = t.select((F.col("o_orderkey") % 64).alias("x"), (F.col("o_custkey") % 64).alias("y"), (F.col("o_orderkey") * 5 % 32).alias("z"), (F.col("o_custkey") % 40 + 1).alias("v"))
    return at.groupBy(*XYZ).agg(F.max("v").alias("v"))


def box(spark: SparkSession, grid: Grid = GRID) -> DataFrame:
    """Every place of a grid."""
    nx, ny, nz = grid.dim
    return spark.range(nx * ny * nz).select((F.col("id") % nx).alias("x"), (F.floor(F.col("id") / nx) % ny).alias("y"), F.floor(F.col("id") / (nx * ny)).alias("z"))
