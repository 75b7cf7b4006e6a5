"""Renumbering of objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavox.plans.checkpoints import cut

from .volume import XYZ


def dense_numbers(ids: DataFrame) -> DataFrame:
    """Rows (v, number): distinct ids numbered 1..k in ascending order.

    Ids are sorted by range over all tasks; each partition is numbered by itself and shifted by what the ones before hold, a
    table with a row for each partition.
    """
    placed = cut(ids.select("v").distinct().repartitionByRange("v").withColumn("part", F.spark_partition_id()))  # parts are read twice, so they are fixed first
    placed = placed.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy("v")))
    before = placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before.select("part", "before")), "part").select("v", (F.col("own") + F.col("before")).cast("long").alias("number"))


def majority_numbers(volume: DataFrame, other: DataFrame) -> DataFrame:
    """Rows (v, number): the id of the other volume that each object overlaps most, the smaller on ties; objects without overlap are left out."""
    both = volume.where("v > 0").join(other.where("v > 0").select(*XYZ, F.col("v").alias("o")), XYZ)
    counts = both.groupBy("v", "o").agg(F.count("*").alias("n"))
    return counts.groupBy("v").agg(F.max_by("o", F.struct("n", -F.col("o"))).alias("number"))


def apply_numbers(volume: DataFrame, numbers: DataFrame) -> DataFrame:
    """The volume with ids replaced; an id without a number raises an error."""
    joined = volume.join(numbers.select("v", "number"), "v", "left")
    checked = F.when(F.col("number").isNull(), F.raise_error(F.concat(F.lit("no number for object "), F.col("v").cast("string"))).cast("long")).otherwise(F.col("number"))
    return joined.select(*XYZ, checked.alias("v"))


def smallest_type(volume: DataFrame) -> DataFrame:
    """One row (objects, largest, dtype): the narrowest unsigned type that holds every id."""
    most = F.coalesce(F.max("v"), F.lit(0))
    kind = F.when(most < 1 << 8, "uint8").when(most < 1 << 16, "uint16").when(most < 1 << 32, "uint32").otherwise("uint64")
    return volume.where("v > 0").agg(F.count_distinct("v").alias("objects"), most.alias("largest"), kind.alias("dtype"))
