"""Connected components, hole filling and contact sites.

Components are labelled by their least voxel id. Blocks are contracted first in numpy; only pairs of voxels across block faces reach the distributed star contraction, as one edge for each two
parts that meet. Components that touch no face of their block are final there, and those of them that are too small go at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.plans.checkpoints import cut
from stratavox.plans.graph import connected_components

from .stencils import AROUND, FACES, HALF
from .volume import XYZ, Block, Grid, over_blocks, stencil, united


def label_block(dense: np.ndarray, around: bool) -> np.ndarray:
    """Components of equal values by the flat index + 1 of their first voxel."""
    flat_ids = np.arange(1, dense.size + 1).reshape(dense.shape)
    label = np.where(dense != 0, flat_ids, 0)
    steps = [(1, 0, 0), (0, 1, 0), (0, 0, 1)] if not around else [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (z, y, x) > (0, 0, 0)]
    views = []
    for s in steps:
        a = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(s, dense.shape, strict=True))
        b = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(s, dense.shape, strict=True))
        same = (dense[a] == dense[b]) & (dense[a] != 0)
        views.append((flat_ids[a][same] - 1, flat_ids[b][same] - 1))
    u, v = (np.concatenate(x) for x in zip(*views, strict=True))
    root = label.ravel().copy()
    while True:
        before = root.copy()
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        set_ = root > 0
        root[set_] = root[root[set_] - 1]
        if (root == before).all():
            return root.reshape(dense.shape)


def _contracted(volume: DataFrame, grid: Grid, around: bool, more_than: float = 0) -> DataFrame:
    """Rows (x, y, z, v, root): the least voxel id of each voxel's component within its block. Components inside a block with no more voxels than more_than are left out."""

    def kernel(b: Block) -> dict[str, np.ndarray]:
        # flat order x fastest, so that the first voxel of a component has its least id
        local = label_block(b["v"].transpose(2, 1, 0), around).transpose(2, 1, 0)
        nx, ny, _ = b.shape
        if more_than > 0:
            n = np.bincount(local.ravel(), minlength=local.size + 1)
            for axis, (o, d) in enumerate(zip(b.corner, b.dim, strict=True)):
                moved = np.moveaxis(local, axis, 0)
                for end, inner in ((0, o > 0), (-1, o + local.shape[axis] < d)):
                    if inner:
                        n[moved[end]] = np.iinfo(n.dtype).max
            local = np.where(n[local] > more_than, local, 0)
        k = np.maximum(local - 1, 0)
        x, y, z = k % nx + b.corner[0], k // nx % ny + b.corner[1], k // (nx * ny) + b.corner[2]
        return b.rows(local > 0, v=b["v"], root=grid.dim[0] * grid.dim[1] * z + grid.dim[0] * y + x + 1)

    return over_blocks(volume.where("v <> 0").select(*XYZ, "v"), grid, 0, kernel, "x long, y long, z long, v long, root long")


def across_faces(local: DataFrame, grid: Grid, around: bool, same: list[str]) -> DataFrame:
    """Rows (root, to, the columns of same): parts of neighbouring blocks that meet at a face and have the same values; local: (x, y, z, root, ...)."""
    low = local.where(" or ".join(f"{c} % {b} = 0" for c, b in zip(XYZ, grid.block, strict=True)))
    high = local.where(" or ".join(f"{c} % {b} = {b - 1}" for c, b in zip(XYZ, grid.block, strict=True)))
    face = low.unionByName(high).distinct() if around else high
    near = stencil(face, f"{AROUND if around else FACES} and {HALF}")
    crossing = near.where(" or ".join(f"floor({c} / {b}) <> floor({c}0 / {b})" for c, b in zip(XYZ, grid.block, strict=True)))
    other = (face if around else low).select(*XYZ, *same, F.col("root").alias("to"))
    return crossing.join(other, [*XYZ, *same]).where("root <> to").select("root", "to", *same).distinct()


def components(volume: DataFrame, grid: Grid, around: bool = False, more_than: float = 0) -> DataFrame:
    """Rows (x, y, z, v, component): neighbours (6, or 26 with around) with equal values are one component.

    Only voxels on block faces are joined with each other. Components inside a block with no more voxels than more_than may be left out already.
    """
    local = cut(_contracted(volume, grid, around, more_than))
    met = across_faces(local.select(*XYZ, "v", "root"), grid, around, ["v"])
    merged = connected_components(met.select(F.col("root").alias("u"), F.col("to").alias("v")))
    return local.join(merged, F.col("root") == F.col("node"), "left").select(*XYZ, "v", F.coalesce("component", "root").alias("component"))


def sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("component").agg(F.count("*").alias("n"))


def keep_sizes(labelled: DataFrame, more_than: float, at_most: float | None = None) -> DataFrame:
    """Components with more_than < voxels <= at_most."""
    ok = F.col("n") > more_than
    if at_most is not None:
        ok &= F.col("n") <= at_most
    return labelled.join(sizes(labelled).where(ok).select("component"), "component", "left_semi")


def largest(labelled: DataFrame) -> DataFrame:
    """The largest component, with ties."""
    n = sizes(labelled)
    return labelled.join(n.join(n.agg(F.max("n").alias("n")), "n").select("component"), "component", "left_semi")


def segment(
    prediction: DataFrame, grid: Grid, at_least: float, more_than_nm3: float = 0.0, around: bool = False, smooth_nm: float = 0.0, mask: DataFrame | None = None, mask_scale: int = 2, inside: DataFrame | None = None
) -> DataFrame:
    """Smooth, mask, threshold, label and drop small components: rows (x, y, z, v) with v the component.

    smooth_nm is the Gaussian's sigma; whole-number predictions stay whole numbers. Places without a set voxel of the mask, which is coarser by mask_scale, count as 0. With inside, the
    rows (x, y, z) of all places, what is labelled are the places of value 0 instead, as for holes, and neither smoothing, mask nor threshold applies.
    """
    from .lines import gaussian
    from .pointwise import apply_mask, binarize, invert, threshold

    if inside is not None:
        found = invert(prediction, inside)
    else:
        if smooth_nm:
            whole = dict(prediction.dtypes)["v"] not in ("double", "float")
            prediction = gaussian(prediction, grid, grid.voxels(smooth_nm))
            if whole:
                prediction = prediction.withColumn("v", F.round("v").cast("long"))
        if mask is not None:
            prediction = apply_mask(prediction, mask, keep_within=True, scale=mask_scale)
        found = binarize(threshold(prediction, at_least))
    least = float(np.ceil(grid.volume_voxels(more_than_nm3)))
    return keep_sizes(components(found, grid, around, least), least).select(*XYZ, F.col("component").alias("v"))


def fill_holes(volume: DataFrame, box: DataFrame, grid: Grid) -> DataFrame:
    """Background components that touch exactly one object and not the volume's edge take its id. box: rows (x, y, z) of all places."""
    objects = volume.where("v > 0").select(*XYZ, "v")
    empty = box.join(objects.select(*XYZ), XYZ, "left_anti").withColumn("v", F.lit(255).cast("long"))
    holes = cut(components(empty, grid))
    edge = " or ".join(f"{c} = 0 or {c} = {d - 1}" for c, d in zip(XYZ, grid.dim, strict=True))
    outside = holes.where(edge).select("component").distinct()

    def kernel(b: Block) -> dict[str, np.ndarray]:
        own, found = b["hole"][b.core], []
        for axis in range(3):
            for d in (-1, 1):
                other = b.moved(b["v"], tuple(d * (k == axis) for k in range(3)))[b.core]
                met = (own > 0) & (other > 0)
                found.append(np.column_stack([own[met], other[met]]))
        pairs = np.unique(np.concatenate(found), axis=0)
        return {"component": pairs[:, 0], "object": pairs[:, 1]}

    both = united(v=objects, hole=holes.select(*XYZ, F.col("component").alias("v")))
    met = over_blocks(both, grid, 1, kernel, "component long, object long")
    owner = met.groupBy("component").agg(F.min("object").alias("object"), F.max("object").alias("most")).where("object = most").join(outside, "component", "left_anti")
    filled = holes.join(owner, "component").select(*XYZ, F.col("object").alias("v"))
    return objects.unionByName(filled)


def label_pairs(at: np.ndarray, pair: np.ndarray, around: bool) -> np.ndarray:
    """For rows of places [n, 3] and numbers of their pairs, the index of the first row of each row's component; rows must be sorted by pair and then by z, y, x."""
    size = at.max(0) + 2 if len(at) else np.ones(3, int)
    flat = ((pair * size[2] + at[:, 2]) * size[1] + at[:, 1]) * size[0] + at[:, 0]
    ends = []
    for z, y, x in [(0, 0, 1), (0, 1, 0), (1, 0, 0)] if not around else [(z, y, x) for z in (0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (z, y, x) > (0, 0, 0)]:
        # one more place on each axis than there are, so that a step beyond the end finds no row
        to = flat + (z * size[1] + y) * size[0] + x
        j = np.minimum(np.searchsorted(flat, to), len(flat) - 1)
        same = (flat[j] == to) & (at[:, 0] + x >= 0) & (at[:, 1] + y >= 0)
        ends.append(np.stack([np.flatnonzero(same), j[same]]))
    u, v = np.concatenate(ends, 1)
    root = np.arange(len(flat))
    while True:
        before = root.copy()
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        root = root[root]
        if (root == before).all():
            return root


def pair_components(both: DataFrame, grid: Grid, around: bool = False) -> DataFrame:
    """Components within each pair of objects: rows (x, y, z, a, b, component) from rows (x, y, z, a, b); a place may be in several pairs.

    Blocks are contracted pair by pair; what reaches the distributed contraction are the parts on block faces.
    """

    def run(t: pa.Table) -> pa.Table:
        x, y, z, a, b = (np.asarray(t.column(c).combine_chunks()) for c in (*XYZ, "a", "b"))
        order = np.lexsort((x, y, z, b, a))
        x, y, z, a, b = (c[order] for c in (x, y, z, a, b))
        pair = np.cumsum(np.r_[0, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        at = np.stack([x, y, z], 1)
        root = label_pairs(at - at.min(0), pair, around)
        ids = grid.dim[0] * grid.dim[1] * z + grid.dim[0] * y + x + 1
        return pa.table({"x": x, "y": y, "z": z, "a": a, "b": b, "root": ids[root]})

    rows = both.select(*(F.col(c).cast("long").alias(c) for c in (*XYZ, "a", "b")), *grid.block_key())
    local = cut(rows.groupBy("bx", "by", "bz").applyInArrow(run, "x long, y long, z long, a long, b long, root long"))
    # a part is named by its pair and its least voxel
    met = across_faces(local, grid, around, ["a", "b"])
    node = lambda c: F.xxhash64(c, "a", "b")
    edges = cut(met.select(node("root").alias("u"), node("to").alias("v"), F.least("root", "to").alias("least")))
    merged = connected_components(edges.select("u", "v"))
    least = edges.join(merged, F.col("u") == F.col("node")).groupBy("component").agg(F.min("least").alias("least"))
    named = cut(merged.join(least, "component").select("node", "least"))
    return local.withColumn("node", node("root")).join(named, "node", "left").select(*XYZ, "a", "b", F.coalesce("least", "root").alias("component"))


def contacts_overlap(a: DataFrame, b: DataFrame, grid: Grid, nm: float, around: bool = False) -> DataFrame:
    """Contact sites where the halos of two volumes' objects overlap, by pair of objects."""
    from .distance import contact_halo

    left, right = contact_halo(a, grid, nm), contact_halo(b, grid, nm)
    both = left.select(*XYZ, F.col("v").alias("a")).join(right.select(*XYZ, F.col("v").alias("b")), XYZ)
    return pair_components(cut(both), grid, around)


def line_voxels(dx: int, dy: int, dz: int) -> list[tuple[int, int, int]]:
    """The lattice line from the origin to an offset, both ends included: the longest axis steps by one and the others round."""
    n = max(abs(dx), abs(dy), abs(dz))
    step = lambda d, k: (2 * k * abs(d) + n - 1) // (2 * n) * (1 if d > 0 else -1) if n else 0
    return [(step(dx, k), step(dy, k), step(dz, k)) for k in range(n + 1)]


def contacts_sight(a: DataFrame, b: DataFrame, grid: Grid, nm: float) -> DataFrame:
    """Contact sites of surface voxels within nm / resolution + 1 whose line of sight crosses background only: all voxels of those lines.

    Blocks have a halo of the reach and one more, so that both surfaces and all lines that start in a block lie in it.
    """
    from .stencils import surface

    most = int((grid.voxels(nm) + 1) ** 2)
    radius = int(np.sqrt(most) + 1e-9)
    span = range(-radius, radius + 1)
    lines = [line_voxels(x, y, z) for x in span for y in span for z in span if x * x + y * y + z * z <= most]

    def kernel(k: Block) -> dict[str, np.ndarray]:
        own = surface(k, k["a"])
        mask = np.zeros(k.shape, bool)
        mask[k.core] = own[k.core]
        other, free = surface(k, k["b"]), (k["a"] == 0) & (k["b"] == 0)
        found = []
        for line in lines:
            seen = mask & k.moved(other, line[-1], False)
            for step in line[1:-1]:
                seen &= k.moved(free, step, False)
            at = np.argwhere(seen)
            if len(at):
                pair = np.column_stack([k["a"][seen], k["b"][tuple((at + line[-1]).T)]])
                found += [np.column_stack([at + np.array(step) + np.array(k.corner), pair]) for step in line]
        rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 5), np.int64)
        return {c: rows[:, i] for i, c in enumerate([*XYZ, "a", "b"])}

    both = united(a=a.where("v > 0"), b=b.where("v > 0"))
    seen = over_blocks(both, grid, radius + 1, kernel, "x long, y long, z long, a long, b long").distinct()
    return pair_components(cut(seen), grid, around=True)


def contact_sites(volumes: dict[str, DataFrame], grid: Grid, nm: float, pairs: list[tuple[str, str]] | None = None, self_pairs: bool = False) -> DataFrame:
    """Rows (contact, x, y, z, a, b, component) over all pairs of volumes, or those named; contact is "<first>_to_<second>".

    With a distance of 0 the halos' overlap counts, else lines of sight. With self_pairs a volume's objects also meet each other.
    """
    from .distance import self_pairs as own_pairs

    names = list(volumes)
    pairs = pairs or [(m, n) for i, m in enumerate(names) for n in names[i + (not self_pairs) :]]
    out = None
    for m, n in pairs:
        if m == n:
            sites = pair_components(cut(own_pairs(volumes[m], grid, nm)), grid, around=True)
        else:
            sites = (contacts_overlap if nm == 0 else contacts_sight)(volumes[m], volumes[n], grid, nm)
        sites = sites.select(F.lit(f"{m}_to_{n}").alias("contact"), *XYZ, "a", "b", "component")
        out = sites if out is None else out.unionByName(sites)
    return out


# Workflows


def fill_and_filter(volume: DataFrame, box: DataFrame, grid: Grid, more_than_nm3: float, at_most_nm3: float | None = None) -> DataFrame:
    """Holes are filled, and then objects outside the sizes go; the others are renumbered."""
    from .pointwise import volume_filter

    filled = cut(fill_holes(volume, box, grid))
    return volume_filter(filled, grid.volume_voxels(more_than_nm3), None if at_most_nm3 is None else grid.volume_voxels(at_most_nm3))


def cell_volume(box: DataFrame, membrane: DataFrame, outside: DataFrame, mask: DataFrame, grid: Grid, beyond: float = 3.0, more_than_nm3: float = 0.0) -> DataFrame:
    """Rows (x, y, z, v): components of what lies inside the mask, isn't membrane, and is farther than beyond voxels from the outside (x, y, z, v)."""
    from .distance import edt_bounded
    from .pointwise import cell_interior

    inner = cell_interior(box, membrane, edt_bounded(outside, grid, int(beyond * beyond)), mask, beyond)
    found = components(inner, grid)
    return keep_sizes(found, float(np.ceil(grid.volume_voxels(more_than_nm3)))).select(*XYZ, F.col("component").alias("v"))


def light_contacts(predictions: dict[str, DataFrame], grid: Grid, at_least: dict[str, float], more_than_nm3: float = 0.0) -> DataFrame:
    """Contact sites of light-microscopy channels: threshold, components, and overlap of halos at distance 0 for all pairs of channels."""
    segmented = {name: cut(segment(p, grid, at_least[name], more_than_nm3)) for name, p in predictions.items()}
    return contact_sites(segmented, grid, 0.0)
