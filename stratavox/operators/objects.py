"""Per-object tables and histograms: partial and final hash aggregation on labels."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.plans.checkpoints import cut, drop

from .blockstate import State
from .distance import chamfer_steps, geodesic
from .stencils import exposed_faces
from .volume import XYZ, Block, Grid, stencil


def object_info(volume: DataFrame, grid: Grid) -> DataFrame:
    """Rows (id, volume, area, com_x.., min_x.., max_x..) in nanometres, by label."""
    r = grid.resolution[0]
    stats = exposed_faces(volume, grid).groupBy("v").agg(
        F.count("*").alias("n"), F.sum("faces").alias("faces"), *(f(c).alias(f"{k}_{c}") for c in XYZ for k, f in (("sum", F.sum), ("min", F.min), ("max", F.max)))
    )
    com = [(r * F.col(f"sum_{c}") / F.col("n") + o).alias(f"com_{c}") for c, o in zip(XYZ, grid.offset, strict=True)]
    ends = [(r * F.col(f"{k}_{c}") + o).alias(f"{k}_{c}") for k in ("min", "max") for c, o in zip(XYZ, grid.offset, strict=True)]
    return stats.select(F.col("v").alias("id"), (F.col("n") * r**3).alias("volume"), (F.col("faces") * r**2).alias("area"), *com, *ends)


def contact_info(contacts: DataFrame, a: DataFrame, b: DataFrame, grid: Grid) -> DataFrame:
    """object_info of contact sites (x, y, z, a, b, component) with their pair and each side's surface area within the site."""
    sites = cut(contacts.select(*XYZ, F.col("component").alias("v"), "a", "b"))
    info = object_info(sites.select(*XYZ, "v").distinct(), grid)
    own = sites.select("v", "a", "b").distinct()
    side = lambda volume, name: sites.join(exposed_faces(volume, grid).select(*XYZ, F.col("v").alias(name), "faces"), [*XYZ, name]).groupBy("v").agg((F.sum("faces") * grid.resolution[0] ** 2).alias(f"area_{name}"))
    out = info.join(own, F.col("id") == F.col("v")).drop("v")
    for volume, name in ((a, "a"), (b, "b")):
        out = out.join(side(volume, name).withColumnRenamed("v", "id"), "id", "left").withColumn(f"area_{name}", F.coalesce(f"area_{name}", F.lit(0.0)))
    return out


def object_counts(volumes: dict[str, DataFrame]) -> DataFrame:
    """Rows (object, count): how many labels each volume has."""
    out = None
    for name, volume in volumes.items():
        row = volume.where("v > 0").agg(F.count_distinct("v").alias("count")).select(F.lit(name).alias("object"), "count")
        out = row if out is None else out.unionByName(row)
    return out


def unit_bin(value: Column) -> Column:
    """The bin, 1 to 255, of a value in [0, 1]."""
    return (F.ceil(254 * value) + 1).cast("long")


def bin_centre(number: Column) -> Column:
    return (number - 1) / 255 + 0.5 / 255


def project_to_volume(medial: DataFrame, volume: DataFrame, radius: int) -> DataFrame:
    """Rows (x, y, z, v, value): the mean value of the medial voxels (x, y, z, d2, value) whose ball of squared radius d2 covers a voxel."""
    balls = stencil(medial.select(*XYZ, F.col("d2").alias("reach"), "value"), f"d2 <= {radius * radius}", radius).where("d2 <= reach")
    return balls.join(volume.where("v > 0").select(*XYZ, "v"), XYZ).groupBy(*XYZ, "v").agg(F.avg("value").alias("value"))


def value_histogram(valued: DataFrame, volume: DataFrame, grid: Grid) -> DataFrame:
    """Rows (bin, centre, volume, area): object volume and surface by bin of the voxels' values (x, y, z, v, value)."""
    faces = exposed_faces(volume, grid).select(*XYZ, "faces")
    r = grid.resolution[0]
    by_bin = valued.withColumn("bin", unit_bin(F.col("value"))).join(faces, XYZ).groupBy("bin").agg((F.count("*") * r**3).alias("volume"), (F.sum("faces") * r**2).alias("area"))
    return by_bin.select("bin", bin_centre(F.col("bin")).alias("centre"), "volume", "area")


def planarity_thickness(medial: DataFrame, grid: Grid, bins: int = 100, width_nm: float = 8.0) -> DataFrame:
    """Rows (bin, thickness, count): medial voxels (d2, value) by planarity bin and thickness in steps of width_nm, the last bin open."""
    nm = 2 * F.sqrt("d2") * grid.resolution[0]
    return medial.groupBy(unit_bin(F.col("value")).alias("bin"), F.least(F.floor(nm / width_nm), F.lit(bins - 1)).cast("long").alias("thickness")).agg(F.count("*").alias("count"))


def nearest_medial(volume: DataFrame, medial: DataFrame, grid: Grid) -> DataFrame:
    """Rows (x, y, z, v, value): each object voxel's mean value over all medial voxels (x, y, z, value) that are nearest to it within the objects.

    Nearness is chamfer distance. The nearest medial voxels of a place are those of the neighbours from which an exact step leads to it. Steps are three to five long, so places
    within a band of three distances take theirs from the two bands before, and each pair of a place and a medial voxel is made once, of two tables of the size of a band.
    """
    known = cut(geodesic(medial, volume, grid))
    step = F.when(F.col("d2") == 1, 3).when(F.col("d2") == 2, 4).otherwise(5)
    there = known.select(*XYZ, F.col("d").alias("to"))
    exact = stencil(known, "d2 > 0").join(there, XYZ).where(F.col("d") + step == F.col("to"))
    exact = exact.select(*(F.col(f"{c}0").alias(f"from_{c}") for c in XYZ), *XYZ, F.floor(F.col("to") / 3).alias("band"))
    exact = cut(exact.repartitionByRange("band", F.xxhash64(*XYZ)))  # so that a scan for a band skips the other files
    bands = known.agg(F.coalesce(F.floor(F.max("d") / 3), F.lit(0))).first()[0]
    before, met = [], cut(medial.join(known.where("d = 0").select(*XYZ), XYZ).select(*XYZ, grid.index().alias("source"), "value"))
    pairs = met
    for band in range(1, bands + 1):
        before = [*before[-1:], met]
        near = reduce(DataFrame.unionByName, before).select(*(F.col(c).alias(f"from_{c}") for c in XYZ), "source", "value")
        met = cut(near.join(exact.where(F.col("band") == band), [f"from_{c}" for c in XYZ]).select(*XYZ, "source", "value").distinct())
        pairs = pairs.unionByName(met)
    mean = pairs.groupBy(*XYZ).agg(F.avg("value").alias("value"))
    return volume.where("v > 0").join(mean, XYZ).select(*XYZ, "v", "value")


def path_weighted(volume: DataFrame, medial: DataFrame, grid: Grid) -> DataFrame:
    """Rows (x, y, z, v, value): each object voxel's mean value over all shortest chamfer paths within the objects that lead to it from medial voxels (x, y, z, value).

    A voxel takes its value from the neighbours from which an exact step leads to it, each by its number of paths; numbers are kept as logarithms. Blocks settle what they can and run again
    when a neighbour's margin has settled, so what moves are margins, not pairs of places and sources.
    """
    inside = volume.where("v > 0").select(*XYZ, "v")
    start = medial.join(inside.select(*XYZ), XYZ, "left_semi").groupBy(*XYZ).agg(F.avg("value").alias("mean"))
    known = geodesic(start, inside, grid).select(*XYZ, (F.col("d") + 1).alias("after"))
    rows = cut(inside.join(known, XYZ).join(start.withColumn("settled", F.lit(True)), XYZ, "left"))
    steps = [(s, cost) for s, cost in chamfer_steps()]

    def kernel(b: Block) -> tuple[dict[str, np.ndarray], np.ndarray]:
        after, settled, mean, paths = b["after"], b["settled"].copy(), b["mean"].copy(), b["paths"].copy()
        core = np.zeros(after.shape, bool)
        core[b.core] = True
        before = settled.copy()
        # from which neighbours an exact step leads here; seeds have none, as 0 is no voxel's distance and one more
        exact = [(s, (b.moved(after, s) == after - cost) & (b.moved(after, s) > 0)) for s, cost in steps]
        while True:
            waits = ~core | settled | (after == 0)
            for s, to in exact:
                waits |= to & ~b.moved(settled, s, False)
            ready = np.nonzero(~waits)
            if not len(ready[0]):
                break
            logs = np.full((len(steps), len(ready[0])), -np.inf)
            values = np.zeros_like(logs)
            for k, (s, to) in enumerate(exact):
                own = to[ready]
                there = tuple(np.clip(r + d, 0, n - 1) for r, d, n in zip(ready, s, after.shape, strict=True))
                logs[k], values[k] = np.where(own, paths[there], -np.inf), np.where(own, mean[there], 0)
            top = logs.max(0)
            weight = np.exp2(logs - top)
            mean[ready], paths[ready] = (weight * values).sum(0) / weight.sum(0), top + np.log2(weight.sum(0))
            settled[ready] = True
        return {"settled": settled, "mean": mean, "paths": paths}, settled & ~before

    state = State(rows, grid, {"v": np.int64, "after": np.int64, "settled": np.bool_, "mean": np.float64, "paths": np.float64})
    active = cut(state.all_keys())
    while not active.isEmpty():
        woken = state.run(1, kernel, active, again=False)
        drop(active)
        active = woken
    return state.rows(lambda a: a["settled"], "x long, y long, z long, v long, mean double").withColumnRenamed("mean", "value")


def contact_sheetness(contacts: DataFrame, valued: DataFrame, surface: DataFrame, grid: Grid) -> DataFrame:
    """Rows (component, sheetness, area): mean bin centre of contact-site surface voxels, and their area."""
    met = contacts.select(*XYZ, "component").join(valued.select(*XYZ, "value"), XYZ).join(surface.select(*XYZ, "faces"), XYZ).where("faces > 0").withColumn("bin", unit_bin(F.col("value")))
    return met.groupBy("component").agg(bin_centre(F.avg("bin")).alias("sheetness"), (F.sum("faces") * grid.resolution[0] ** 2).alias("area"))


def contact_sheetness_tables(contacts: DataFrame, bins: DataFrame, organelles: DataFrame, grid: Grid) -> DataFrame:
    """Rows (kind, id, sheetness, area) from three volumes over the same places, in one aggregation by three keys.

    kind "bin": the sheetness of each bin and the surface area that contact sites have in it, where any. "organelle" and "site": the mean sheetness of an organelle's voxels at contact sites, and
    of a site's voxels; organelle 0 has those without one. contacts: (x, y, z, component), bins: (x, y, z, v) with v from 1 to 255, organelles: (x, y, z, v).
    """
    faces = exposed_faces(bins, grid, against_background=True).select(*XYZ, F.col("v").alias("bin"), "faces")
    owner = organelles.where("v > 0").select(*XYZ, F.col("v").alias("organelle"))
    met = contacts.where("component > 0").select(*XYZ, F.col("component").alias("site")).join(faces, XYZ).join(owner, XYZ, "left").withColumn("organelle", F.coalesce("organelle", F.lit(0)))
    keys = {"bin": F.col("bin"), "organelle": F.col("organelle"), "site": F.col("site")}
    each = met.select("bin", "faces", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("long").alias("id")) for k, c in keys.items()))).alias("key"))
    sums = each.groupBy("key.kind", "key.id").agg(F.avg("bin").alias("mean"), F.sum("faces").alias("faces"))
    area = F.when(F.col("kind") == "bin", F.col("faces") * grid.resolution[0] * grid.resolution[1])
    return sums.where("kind <> 'bin' or faces > 0").select("kind", "id", bin_centre(F.col("mean")).alias("sheetness"), area.alias("area"))


def thickness_histogram(medial: DataFrame, grid: Grid, bins: int = 200, width_nm: float = 0.5) -> DataFrame:
    """Rows (bin, from_nm, count), all bins: twice the radius of medial voxels (d2 in voxels)."""
    spark = medial.sparkSession
    nm = 2 * F.sqrt("d2") * grid.resolution[0]
    counted = medial.select(F.least(F.floor(nm / width_nm), F.lit(bins - 1)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return spark.range(bins).withColumnRenamed("id", "bin").join(counted, "bin", "left").select("bin", (F.col("bin") * width_nm).alias("from_nm"), F.coalesce("n", F.lit(0)).alias("count"))


def protrusion_area(protrusions: DataFrame, synapses: DataFrame, grid: Grid) -> DataFrame:
    """Rows (id, other_area, synapse_area): surface of protrusions, edges of the volume included, outside and inside the second volume."""
    faces = exposed_faces(protrusions, grid, count_edge=True, against_background=True)
    inside = synapses.where("v > 0").select(*XYZ, F.lit(True).alias("inside")).distinct()
    r2 = grid.resolution[0] ** 2
    joined = faces.join(inside, XYZ, "left")
    return joined.groupBy(F.col("v").alias("id")).agg(
        (F.sum(F.when(F.col("inside").isNull(), F.col("faces")).otherwise(0)) * r2).alias("other_area"), (F.sum(F.when(F.col("inside"), F.col("faces")).otherwise(0)) * r2).alias("synapse_area")
    )


def overlap_matrix(volume: DataFrame, other: DataFrame) -> DataFrame:
    """Rows (a, b, n): voxels that objects of two volumes share."""
    both = volume.where("v > 0").select(*XYZ, F.col("v").alias("a")).join(other.where("v > 0").select(*XYZ, F.col("v").alias("b")), XYZ)
    return both.groupBy("a", "b").agg(F.count("*").alias("n"))
