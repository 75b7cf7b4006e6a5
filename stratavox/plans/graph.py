"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut, drop


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: greater neighbours of u point to u's least neighbour; small star: lesser neighbours and u itself do.

    Least neighbours are partial aggregates; the join back on nodes with very many neighbours is split by adaptive execution. In a large star only
    neighbours greater than u move.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    if large:
        moved = both.where(F.col("v") > F.col("u")).join(least, "u")
    else:
        moved = both.join(least, "u").where(F.col("v") != F.col("m")).select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for each node with an edge; the component is its least node. edges: (u, v), longs.

    Edges are kept as (greater, lesser). Rounds grow with the logarithm of the longest chain.
    """
    edges = cut(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        moved = cut(_star(_star(edges, True), False))
        drop(edges)
        edges = moved
        # done once every node hangs from one root: steps keep connection, so such stars are the components
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        if ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child + parent > 1").isEmpty():
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
