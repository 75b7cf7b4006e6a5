"""Skeleton graphs: edges between skeleton voxels of an object, pruning, and the longest shortest path of each object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.plans.checkpoints import cut

from .chains import contract, nodes_of, solve
from .stencils import AROUND, HALF
from .volume import XYZ, Grid, stencil


def skeleton_edges(skeleton: DataFrame, grid: Grid) -> DataFrame:
    """Rows (obj, u, v, w): 26-neighbours within an object, u < v by voxel id, w the distance in voxels."""
    met = stencil(skeleton, f"{AROUND} and {HALF}").join(skeleton.select(*XYZ, F.col("v").alias("other")), XYZ).where("v = other")
    ids = met.withColumn("v_id", grid.index()).select(F.col("v").alias("obj"), "v_id", *(F.col(f"{c}0").alias(c) for c in XYZ), "d2").withColumn("u_id", grid.index())
    return ids.select("obj", F.least("u_id", "v_id").alias("u"), F.greatest("u_id", "v_id").alias("v"), F.sqrt("d2").alias("w"))


def degrees(edges: DataFrame) -> DataFrame:
    """Rows (obj, node, degree, kind): end (1 neighbour), branch (3 or more), path."""
    both = edges.select("obj", F.col("u").alias("node")).unionByName(edges.select("obj", F.col("v").alias("node")))
    kind = F.when(F.col("degree") == 1, "end").when(F.col("degree") >= 3, "branch").otherwise("path")
    return both.groupBy("obj", "node").agg(F.count("*").alias("degree")).withColumn("kind", kind)


def longest_paths(vertices: DataFrame, edges: DataFrame, least: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, kept, lengths): the nodes of each object's longest shortest path in order (obj, at, along, node), the nodes that pruning leaves (obj, node), and (obj, length).

    Branches of at most ``least`` go, the shortest first, while the longest path is over three times that. An object without edges has its first node as path. vertices: (obj, node).
    """
    own = cut(vertices.select("obj", "node").distinct())
    chains, inner = contract(edges)
    solved = solve(chains, inner, least)
    single = own.join(solved.select("obj"), "obj", "left_anti")
    alone = single.groupBy("obj").agg(F.min("node").alias("node")).select("obj", F.lit(0).alias("at"), F.lit(0.0).alias("along"), "node")
    paths = nodes_of(solved, "way", inner).unionByName(alone)
    kept = own.join(nodes_of(solved, "gone", inner).select("obj", "node"), ["obj", "node"], "left_anti")
    return paths, kept, solved.select("obj", "length").unionByName(alone.select("obj", F.lit(0.0).alias("length")))


def length_and_thickness(vertices: DataFrame, edges: DataFrame, resolution: float, least: float = 0.0) -> DataFrame:
    """Rows (obj, length_nm, radius_mean_nm, radius_sd_nm, path, pruned): along each object's longest shortest path after pruning; pruned has all nodes left.

    vertices: (obj, node, radius). A task gets an object's chains; their nodes are joined to its answer.
    """
    paths, kept, lengths = longest_paths(vertices, edges, least)
    radius = vertices.groupBy("obj", "node").agg(F.min("radius").alias("radius"))
    along = paths.join(radius, ["obj", "node"]).groupBy("obj").agg(
        (F.avg("radius") * resolution).alias("radius_mean_nm"), F.coalesce(F.stddev_samp("radius") * resolution, F.lit(float("nan"))).alias("radius_sd_nm"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "along", "node"))), lambda p: p.node).alias("path"),
    )
    left = kept.groupBy("obj").agg(F.sort_array(F.collect_list("node")).alias("pruned"))
    return lengths.join(along, "obj").join(left, "obj").select("obj", (F.col("length") * resolution).alias("length_nm"), "radius_mean_nm", "radius_sd_nm", "path", "pruned")


def paint(paths: DataFrame, grid: Grid, column: str = "path") -> DataFrame:
    """Rows (x, y, z, v): the longest paths, or with "pruned" the pruned skeletons, as a volume."""
    return paths.select(F.col("obj").alias("v"), F.explode(column).alias("node")).select(*(c.alias(k) for k, c in grid.position(F.col("node")).items()), "v")
