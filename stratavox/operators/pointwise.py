"""Point-wise operators, masks and filters (one voxel in, one voxel out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .volume import XYZ, Grid


def threshold(volume: DataFrame, at_least: float) -> DataFrame:
    return volume.where(F.col("v") >= at_least)


def distance_to_intensity(nm: Column) -> Column:
    """A signed distance as a prediction value, 127 at the boundary."""
    return 128 * F.tanh(nm / 50) + 127


def intensity_to_distance(v: Column) -> Column:
    """The signed distance in nanometres that a prediction value stands for."""
    x = (v - 127) / 128
    return 25 * F.log((1 + x) / (1 - x))


def binarize(volume: DataFrame, label: int = 1) -> DataFrame:
    return volume.where("v > 0").select(*XYZ, F.lit(label).cast("long").alias("v"))


def cast8(volume: DataFrame) -> DataFrame:
    """The lowest 8 bits; voxels that become 0 are background."""
    return volume.withColumn("v", F.col("v") % 256).where("v <> 0")


def crop(volume: DataFrame, grid: Grid, offset_nm: tuple[float, float, float], dim: tuple[int, int, int], binary: bool = False) -> DataFrame:
    """A box at an offset in nanometres, in coordinates of its own."""
    start = [int((o - g) / r) for o, g, r in zip(offset_nm, grid.offset, grid.resolution, strict=True)]
    out = volume.where(" and ".join(f"{c} between {o} and {o + d - 1}" for c, o, d in zip(XYZ, start, dim, strict=True)))
    v = F.when(F.col("v") > 0, F.lit(255)).otherwise(0).cast("long") if binary else F.col("v")
    return out.select(*((F.col(c) - o).alias(c) for c, o in zip(XYZ, start, strict=True)), v.alias("v"))


def remap_classes(volume: DataFrame, classes: dict[str, list[int]], label: int = 255) -> DataFrame:
    """Rows (name, x, y, z, v) of one binary volume for each class set."""
    named = F.array(*(F.when(F.col("v").isin(ids), F.lit(name)) for name, ids in classes.items()))
    return volume.select(F.explode(F.array_compact(named)).alias("name"), *XYZ, F.lit(label).cast("long").alias("v"))


def validation_crops(volume: DataFrame, grid: Grid) -> DataFrame:
    """Rows (crop, x, y, z, v): the whole and the two halves along each axis."""
    crops = [F.lit("whole")] + [F.when(F.col(c) < d // 2, F.lit(f"{c}_low")).otherwise(F.lit(f"{c}_high")) for c, d in zip(XYZ, grid.dim, strict=True)]
    return volume.select(F.explode(F.array(*crops)).alias("crop"), *XYZ, "v")


def apply_mask(volume: DataFrame, mask: DataFrame, keep_within: bool = False, scale: int = 1) -> DataFrame:
    """Without the voxels where the mask (at 1 / scale of the resolution) is set, or only those."""
    return _masked(volume, mask, keep_within, scale).select(*volume.columns)


def _masked(volume: DataFrame, mask: DataFrame, keep_within: bool, scale: int) -> DataFrame:
    places = mask.where("v > 0").select(*(F.col(c).alias(f"m{c}") for c in XYZ)).distinct()
    on = [F.floor(F.col(c) / scale) == F.col(f"m{c}") for c in XYZ]
    return volume.join(places, on, "left_semi" if keep_within else "left_anti")


def invert(volume: DataFrame, box: DataFrame) -> DataFrame:
    """The background voxels of a box (rows x, y, z) as 255."""
    return box.join(volume.where("v <> 0").select(*XYZ), XYZ, "left_anti").select(*XYZ, F.lit(255).cast("long").alias("v"))


def filter_ids(volume: DataFrame, keep: DataFrame | None = None, drop: DataFrame | None = None, relabel: DataFrame | None = None) -> DataFrame:
    """Voxels of the objects in keep (v), or else not in drop (v); relabel (v, to) renames what stays."""
    if keep is not None:
        volume = volume.join(keep.select("v").distinct(), "v", "left_semi")
    elif drop is not None:
        volume = volume.join(drop.select("v").distinct(), "v", "left_anti")
    if relabel is not None:
        volume = volume.join(relabel.select("v", "to"), "v", "left").withColumn("v", F.coalesce("to", "v"))
    return volume.select(*XYZ, "v")


def volume_filter(volume: DataFrame, at_least: float, at_most: float | None = None, always: list[int] = ()) -> DataFrame:
    """Objects with at_least < voxels <= at_most, or named in always, renumbered 1..k by their old ids.

    The table of objects is small against the volume but unbounded, so it meets the volume in an ordinary join.
    """
    from .renumber import dense_numbers

    size = volume.where("v > 0").groupBy("v").agg(F.count("*").alias("n"))
    ok = (F.col("n") > at_least) & ((F.col("n") <= at_most) if at_most is not None else F.lit(True)) | F.col("v").isin(list(always))
    return volume.join(dense_numbers(size.where(ok).select("v")), "v").select(*XYZ, F.col("number").alias("v"))


def label_predictions(prediction: DataFrame, components: DataFrame, at_least: float, scale: int = 1) -> DataFrame:
    """The component (at 1 / scale of the resolution) of each voxel whose prediction reaches a value."""
    labels = components.select(*(F.col(c).alias(f"m{c}") for c in XYZ), F.col("v").alias("label"))
    on = [F.floor(F.col(c) / scale) == F.col(f"m{c}") for c in XYZ]
    return prediction.where(F.col("v") >= at_least).join(labels, on).select(*XYZ, F.col("label").alias("v"))


def separate_classes(volume: DataFrame, nuclear: DataFrame, sheetness: DataFrame, cutoff: float = 0.9) -> DataFrame:
    """Each object's class: 1 neither, 2 nuclear (id), 3 sheet and 4 tube by (id, sheetness)."""
    joined = volume.join(nuclear.select(F.col("id").alias("v"), F.lit(True).alias("nuclear")).distinct(), "v", "left").join(sheetness.select(F.col("id").alias("v"), "sheetness"), "v", "left")
    kind = F.when(F.col("nuclear"), 2).when(F.col("sheetness") >= cutoff, 3).when(F.col("sheetness").isNotNull(), 4).otherwise(1)
    return joined.select(*XYZ, F.col("v").alias("id"), kind.cast("long").alias("v"))


def cell_interior(box: DataFrame, membrane: DataFrame, outside_distance: DataFrame, mask: DataFrame, beyond: float = 3.0) -> DataFrame:
    """Voxels of a box inside a mask, not membrane, and farther than beyond from the outside (rows x, y, z, d2 of those nearer)."""
    inner = box.join(membrane.where("v > 0").select(*XYZ), XYZ, "left_anti").join(outside_distance.where(F.col("d2") <= beyond * beyond).select(*XYZ), XYZ, "left_anti")
    return inner.join(mask.where("v > 0").select(*XYZ), XYZ, "left_semi").select(*XYZ, F.lit(1).cast("long").alias("v"))


def compare(a: DataFrame, b: DataFrame, nonzero_only: bool = False) -> DataFrame:
    """One row (voxels, mismatches, equal) of a full outer comparison."""
    left, right = a.select(*XYZ, F.col("v").alias("va")), b.select(*XYZ, F.col("v").alias("vb"))
    va, vb = F.coalesce("va", F.lit(0)), F.coalesce("vb", F.lit(0))
    differs = ((va != 0) != (vb != 0)) if nonzero_only else (va != vb)
    return left.join(right, XYZ, "full_outer").agg(F.count("*").alias("voxels"), F.coalesce(F.sum(differs.cast("long")), F.lit(0)).alias("mismatches")).withColumn("equal", F.col("mismatches") == 0)


def remove_edge_voxels(volume: DataFrame, grid: Grid) -> DataFrame:
    """Without the voxels on the volume's faces."""
    return volume.where(" and ".join(f"{c} between 1 and {d - 2}" for c, d in zip(XYZ, grid.dim, strict=True)))
