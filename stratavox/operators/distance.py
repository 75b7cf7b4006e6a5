"""Distance transforms, nearest labels, expansion, erosion and geodesic distance.

Squared distances are exact and separable: along each axis in turn, a place takes the least of its line's values plus the squared step. Ties go to
the smaller label, since distance and label travel in one ordered key. A bounded transform whose radius is at most half a block runs in blocks with
a halo of that radius, one exchange. Any other runs over bundles of whole lines, one exchange an axis: no halo has to be guessed or grown, memory is a
bundle's, and places out of reach are never made. Where only being within a large distance matters, bounds by blocks settle most blocks before any distance is taken (``reach``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.plans.checkpoints import cut, drop

from .blockstate import State
from .stencils import surface_voxels
from .volume import XYZ, Block, Grid, over_blocks

_FAR = 1 << 61
#: Lines in a bundle along each of the two other axes.
BUNDLE = 16


# Nearest labels. A key is d2 * (labels + 1) + the label's rank.


def _sweep(key: np.ndarray, radius: int, times: int, axis: int) -> np.ndarray:
    """Keys after steps of up to radius along an axis."""
    key = np.moveaxis(key, axis, -1)
    best = key.copy()
    for k in range(1, min(radius, key.shape[-1] - 1) + 1):
        np.minimum(best[..., k:], key[..., :-k] + k * k * times, out=best[..., k:])
        np.minimum(best[..., :-k], key[..., k:] + k * k * times, out=best[..., :-k])
    return np.moveaxis(np.minimum(best, _FAR), -1, axis)


def _two_least(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], times: int) -> tuple[np.ndarray, np.ndarray]:
    """The two least keys of different labels, from two such pairs."""
    first = np.minimum(a[0], b[0])
    rank = first % times
    other = [np.where((x >= _FAR) | (x % times == rank), _FAR, x) for x in (np.maximum(a[0], b[0]), a[1], b[1])]
    return first, np.minimum.reduce(other)


def _sweep_two(keys: tuple[np.ndarray, np.ndarray], radius: int, times: int, axis: int) -> tuple[np.ndarray, np.ndarray]:
    keys = tuple(np.moveaxis(k, axis, -1) for k in keys)
    best = tuple(k.copy() for k in keys)
    for k in range(1, min(radius, keys[0].shape[-1] - 1) + 1):
        for here, there in ((slice(k, None), slice(None, -k)), (slice(None, -k), slice(k, None))):
            new = _two_least(tuple(b[..., here] for b in best), tuple(np.minimum(x[..., there] + k * k * times, _FAR) for x in keys), times)
            for b, x in zip(best, new, strict=True):
                b[..., here] = x
    return tuple(np.moveaxis(b, -1, axis) for b in best)


def _over_lines(rows: DataFrame, grid: Grid, axis: int, kernel, schema: str) -> DataFrame:
    """Runs kernel(columns, places, shape) on bundles of lines along an axis; places are dense indices with that axis last."""
    others = [c for k, c in enumerate(XYZ) if k != axis]
    keyed = rows.select("*", *(F.floor(F.col(c) / BUNDLE).alias(f"b{c}") for c in others))
    n = grid.dim[axis]

    def run(t: pa.Table) -> pa.Table:
        col = {c: np.asarray(t.column(c).combine_chunks()) for c in t.column_names}
        corner = [int(col[f"b{c}"][0]) * BUNDLE for c in others]
        done, at = kernel(col, tuple(col[c] - o for c, o in zip(others, corner, strict=True)) + (col[XYZ[axis]],), (BUNDLE, BUNDLE, n))
        out = {c: (a + o).astype(np.int64) for c, a, o in zip([*others, XYZ[axis]], at, [*corner, 0], strict=True)} | done
        return pa.table(out).select([f.split()[0] for f in schema.split(", ")])

    return keyed.groupBy(*(f"b{c}" for c in others)).applyInArrow(run, schema)


def nearest_labels(sources: DataFrame, grid: Grid, most_d2: int, second: bool = False) -> DataFrame:
    """Rows (x, y, z, v, d2): the nearest label within the distance, the smaller on ties; with second also v2, the nearest other label within it, or 0."""
    radius = math.isqrt(most_d2)
    names = ["v", "d2"] + (["v2", "d22"] if second else [])
    schema = ", ".join(f"{c} long" for c in [*XYZ, *names])

    def keys_of(label: np.ndarray, d2: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        return d2 * (len(ranks) + 1) + np.searchsorted(ranks, label)

    def columns(keys: tuple[np.ndarray, ...], ranks: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for key, v, d2 in zip(keys, names[::2], names[1::2], strict=False):
            far = key // (len(ranks) + 1) > most_d2
            out |= {v: np.where(far, 0, np.append(ranks, 0)[np.where(far, len(ranks), key % (len(ranks) + 1))]), d2: np.where(far, most_d2 + 1, key // (len(ranks) + 1))}
        return out

    def sweep(keys: tuple[np.ndarray, ...], times: int, axis: int) -> tuple[np.ndarray, ...]:
        return _sweep_two(keys, radius, times, axis) if second else (_sweep(keys[0], radius, times, axis),)

    if 2 * radius <= min(grid.block):

        def in_block(b: Block) -> dict[str, np.ndarray]:
            ranks = np.unique(b["v"][b["v"] != 0])
            keys = (np.where(b["v"] != 0, keys_of(b["v"], np.zeros(b.shape, np.int64), ranks), _FAR),)
            keys += (np.full(b.shape, _FAR),) if second else ()
            for axis in range(3):
                keys = sweep(keys, len(ranks) + 1, axis)
            found = columns(keys, ranks)
            return b.rows((found["d2"] <= most_d2) & b.inside(), **found)

        return over_blocks(sources.select(*XYZ, "v"), grid, radius, in_block, schema)

    rows = sources.select(*XYZ, F.col("v").cast("long").alias("v"), F.lit(0).cast("long").alias("d2"), *([F.lit(0).cast("long").alias("v2"), F.lit(most_d2 + 1).cast("long").alias("d22")] if second else []))

    def in_lines(col, at, shape):
        ranks = np.unique(np.concatenate([col[c] for c in names[::2]]))
        ranks = ranks[ranks != 0]
        keys = ()
        for v, d2 in zip(names[::2], names[1::2], strict=True):
            key = np.full(shape, _FAR)
            key[at] = np.where(col[d2] <= most_d2, keys_of(col[v], col[d2], ranks), _FAR)
            keys += (key,)
        found = columns(sweep(keys, len(ranks) + 1, 2), ranks)
        at = np.nonzero(found["d2"] <= most_d2)
        return {c: a[at] for c, a in found.items()}, at

    for axis in (2, 1, 0):
        rows = _over_lines(rows, grid, axis, in_lines, schema)
    return rows.where(grid.inside())


# Depth: distance to the background.


def _lower(f: np.ndarray, weight: float) -> np.ndarray:
    """The least of each line's values plus the weighted squared step, until no longer step can lower any."""
    best = f.copy()
    some = np.isfinite(f).any(-1, keepdims=True)
    for k in range(1, f.shape[-1]):
        step = (weight * k) ** 2
        if not (np.where(some, best, 0) > step).any():
            break
        np.minimum(best[..., k:], f[..., :-k] + step, out=best[..., k:])
        np.minimum(best[..., :-k], f[..., k:] + step, out=best[..., :-k])
    return best


def edt_kernel(inside: np.ndarray, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Exact squared distances of a whole array to the nearest False, axis by axis; infinite where there is none."""
    out = np.where(inside, np.inf, 0.0)
    for axis, w in enumerate(weights):
        out = np.moveaxis(_lower(np.moveaxis(out, axis, -1), w), -1, axis)
    return out


def depth(volume: DataFrame, grid: Grid, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), beyond_is_background: bool = True) -> DataFrame:
    """Rows (x, y, z, v, d2 double): the exact squared distance of each object voxel to the background, however deep it lies.

    Places beyond the volume count as background or not at all; voxels without any background have an infinite distance. Weights are the lengths of
    a voxel along the axes.
    """
    schema = "x long, y long, z long, v long, d2 double"
    rows = volume.where("v > 0").select(*XYZ, F.col("v").cast("long").alias("v"), F.lit(float("inf")).alias("d2"))

    def along(weight: float):
        def kernel(col, at, shape):
            f = np.zeros((*shape[:2], shape[2] + 2))
            if not beyond_is_background:
                f[..., [0, -1]] = np.inf
            moved = (at[0], at[1], at[2] + 1)
            f[moved] = col["d2"]
            return {"v": col["v"], "d2": _lower(f, weight)[moved]}, at

        return kernel

    for axis in (2, 1, 0):
        rows = _over_lines(rows, grid, axis, along(weights[axis]), schema)
    return rows


def depth_bounded(volume: DataFrame, grid: Grid, most_d2: int) -> DataFrame:
    """Rows (x, y, z, v, d2): set voxels within most_d2 of background in the volume."""
    radius = math.isqrt(most_d2)
    if 2 * radius > min(grid.block):
        return depth(volume, grid, beyond_is_background=False).where(F.col("d2") <= most_d2).withColumn("d2", F.col("d2").cast("long"))

    def kernel(b: Block) -> dict[str, np.ndarray]:
        key = np.where((b["v"] == 0) & b.inside(), 0, _FAR)
        for axis in range(3):
            key = _sweep(key, radius, 1, axis)
        return b.rows((b["v"] > 0) & (key <= most_d2), v=b["v"], d2=key)

    return over_blocks(volume.where("v > 0").select(*XYZ, "v"), grid, radius, kernel, "x long, y long, z long, v long, d2 long")


# Reach: which places are within a distance of any voxel, without the distance itself.


def reached_blocks(volume: DataFrame, grid: Grid, most_d2: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, blocks): pairs (bx, by, bz, sx, sy, sz) of blocks and blocks of voxels that may reach them, and blocks (bx, by, bz, full) that may be reached at all.

    Bounds come from the box that a block's voxels fill: a block is full if even its farthest corner from the farthest corner of some such box is within the distance, and isn't reached if
    its nearest point is beyond it. Only the others need distances.
    """
    radius = math.isqrt(most_d2)
    held = volume.groupBy(*(k.alias(f"s{c}") for c, k in zip(XYZ, grid.block_key(), strict=True))).agg(*(f(c).alias(f"{n}{c}") for c in XYZ for n, f in (("low", F.min), ("high", F.max))))
    near = held
    for c, b, d in zip(XYZ, grid.block, grid.dim, strict=True):
        first, last = F.greatest(F.floor((F.col(f"low{c}") - radius) / b), F.lit(0)), F.least(F.floor((F.col(f"high{c}") + radius) / b), F.lit(-(-d // b) - 1))
        near = near.withColumn(f"b{c}", F.explode(F.sequence(first, last)))
    square = lambda e: e * e
    least, most = F.lit(0), F.lit(0)
    for c, b, d in zip(XYZ, grid.block, grid.dim, strict=True):
        low, high = F.col(f"b{c}") * b, F.least(F.col(f"b{c}") * b + b, F.lit(d)) - 1
        least = least + square(F.greatest(F.lit(0), low - F.col(f"high{c}"), F.col(f"low{c}") - high))
        most = most + square(F.greatest(high - F.col(f"low{c}"), F.col(f"high{c}") - low))
    pairs = cut(near.select("bx", "by", "bz", *(f"s{c}" for c in XYZ), least.alias("near"), most.alias("far")).where(F.col("near") <= most_d2))
    blocks = cut(pairs.groupBy("bx", "by", "bz").agg((F.min("far") <= most_d2).alias("full")))
    return pairs.select("bx", "by", "bz", *(f"s{c}" for c in XYZ)), blocks


def reach(volume: DataFrame, grid: Grid, most_d2: int) -> DataFrame:
    """Rows (x, y, z): all places within the distance of a voxel of the volume, for distances beyond half a block.

    Blocks that bounds settle enter no kernel; the others get the voxels within the distance of them. A task's arrays have the size of a block by its window, squared.
    """
    own = volume.select(*XYZ).distinct()
    pairs, blocks = reached_blocks(own, grid, most_d2)
    places = blocks.where("full").select("bx", "by", "bz")
    for c, b, d in zip(XYZ, grid.block, grid.dim, strict=True):
        places = places.withColumn(c, F.explode(F.sequence(F.col(f"b{c}") * b, F.least(F.col(f"b{c}") * b + b, F.lit(d).cast("long")) - 1)))
    block, dim = grid.block, grid.dim
    keyed = own.select(*XYZ, *(k.alias(f"s{c}") for c, k in zip(XYZ, grid.block_key(), strict=True)))
    met = keyed.join(pairs.join(blocks.where("not full"), ["bx", "by", "bz"], "left_semi"), [f"s{c}" for c in XYZ])
    beyond = sum((F.pow(F.greatest(F.lit(0), F.col(f"b{c}") * b - F.col(c), F.col(c) - F.col(f"b{c}") * b - b + 1), 2) for c, b in zip(XYZ, block, strict=True)), F.lit(0))
    met = met.where(beyond <= most_d2).select("bx", "by", "bz", *XYZ)

    def run(t: pa.Table) -> pa.Table:
        key, at = ([np.asarray(t.column(c).combine_chunks()) for c in names] for names in (("bx", "by", "bz"), XYZ))
        corner = [int(k[0]) * b for k, b in zip(key, block, strict=True)]
        size = [min(b, d - o) for b, d, o in zip(block, dim, corner, strict=True)]
        (xs, xi), (ys, yi) = (np.unique(a, return_inverse=True) for a in at[:2])
        target = [o + np.arange(n) for o, n in zip(corner, size, strict=True)]
        best = np.full((len(xs), len(ys), size[2]), _FAR)
        for k, z in enumerate(target[2]):
            np.minimum.at(best[:, :, k], (xi, yi), (at[2] - z) ** 2)
        for values, to in ((ys, target[1]), (xs, target[0])):
            # [x, y, z] to [x, target y, z], turned to [target y, x, z], and that to [target y, target x, z], turned
            done = np.full((best.shape[0], len(to), best.shape[2]), _FAR)
            for k, v in enumerate(values):
                np.minimum(done, best[:, k][:, None] + ((to - v) ** 2)[None, :, None], out=done)
            best = done.transpose(1, 0, 2)
        found = np.nonzero(best <= most_d2)
        return pa.table({c: found[i] + o for i, (c, o) in enumerate(zip(XYZ, corner, strict=True))})

    partial = met.groupBy("bx", "by", "bz").applyInArrow(run, "x long, y long, z long")
    return places.select(*XYZ).unionByName(partial)


# Operators


def edt_bounded(volume: DataFrame, grid: Grid, most_d2: int) -> DataFrame:
    """Rows (x, y, z, d2): squared distance to the nearest set voxel, up to most_d2."""
    return nearest_labels(volume.where("v > 0"), grid, most_d2).select(*XYZ, "d2")


def contact_halo(volume: DataFrame, grid: Grid, nm: float) -> DataFrame:
    """Rows (x, y, z, v): places outside objects within nm / resolution + 1 voxels, by nearest label, and the objects' surface voxels."""
    most = int((grid.voxels(nm) + 1) ** 2)
    around = nearest_labels(volume.where("v > 0"), grid, most).where("d2 > 0")
    return around.select(*XYZ, "v").unionByName(surface_voxels(volume, grid))


def self_pairs(volume: DataFrame, grid: Grid, nm: float) -> DataFrame:
    """Rows (x, y, z, a, b), a < b: halo places with a second label within the distance: the nearest label and the nearest other one."""
    most = int((grid.voxels(nm) + 1) ** 2)
    best = nearest_labels(surface_voxels(volume, grid), grid, most, second=True).where("v2 <> 0")
    return best.select(*XYZ, F.least("v", "v2").alias("a"), F.greatest("v", "v2").alias("b"))


def expand(volume: DataFrame, grid: Grid, nm: float, value: int | None = None, prediction: DataFrame | None = None, at_least: float = 127) -> DataFrame:
    """Labels grown into the background by nm, or all of it as one value; with a prediction, only where it reaches at_least."""
    most = int(grid.voxels(nm) ** 2)
    if value is not None and 2 * math.isqrt(most) > min(grid.block):
        out = reach(volume.where("v > 0"), grid, most).withColumn("v", F.lit(value))
    else:
        out = nearest_labels(volume.where("v > 0"), grid, most).select(*XYZ, "v")
    if prediction is not None:
        out = out.join(prediction.where(F.col("v") >= at_least).select(*XYZ), XYZ, "left_semi")
    return out if value is None else out.withColumn("v", F.lit(value).cast("long"))


def erode(volume: DataFrame, grid: Grid, nm: float) -> DataFrame:
    """Without the voxels within ceil(nm / resolution) of background."""
    most = int(np.ceil(grid.voxels(nm))) ** 2
    return volume.where("v > 0").join(depth_bounded(volume, grid, most).select(*XYZ), XYZ, "left_anti")


def bodies_and_protrusions(volume: DataFrame, grid: Grid, nm: float) -> DataFrame:
    """Rows (x, y, z, v, part): "body" within 1.1 of the distance of what erosion leaves, else "protrusion"."""
    reach = int((1.1 * np.ceil(grid.voxels(nm))) ** 2)
    core = edt_bounded(erode(volume, grid, nm), grid, reach)
    joined = volume.where("v > 0").join(core, XYZ, "left")
    return joined.select(*XYZ, "v", F.when(F.col("d2").isNotNull(), "body").otherwise("protrusion").alias("part"))


def expanded_surface(volume: DataFrame, grid: Grid, nm: float) -> DataFrame:
    """Object voxels within nm of background."""
    return depth_bounded(volume, grid, int(grid.voxels(nm) ** 2)).select(*XYZ, "v")


def expand_and_apply_mask(volume: DataFrame, mask: DataFrame, grid: Grid, nm: float, keep_within: bool = False) -> DataFrame:
    from .pointwise import apply_mask

    grown = expand(mask, grid, grid.resolution[0] * np.ceil(grid.voxels(nm)), 255)
    return apply_mask(volume, grown, keep_within)


def filament_tubes(centreline: DataFrame, grid: Grid, outer_nm: float = 12.5, inner_nm: float = 6.0) -> DataFrame:
    """Shells around centreline voxels: within the outer radius but not the inner, by nearest label."""
    outer = nearest_labels(centreline, grid, int(grid.voxels(outer_nm) ** 2))
    return outer.where(F.col("d2") > int(grid.voxels(inner_nm) ** 2)).select(*XYZ, "v")


def trimmed_tubes(centreline: DataFrame, grid: Grid, outer_nm: float = 12.5, inner_nm: float = 6.0) -> DataFrame:
    """Tubes (x, y, z, v) around each object's centreline, open at its ends: within the outer radius of it, not within the inner one, and not beyond an end.

    An end has one neighbour of its object, or two that are face neighbours of each other, of which the nearer counts. The centreline would go on by the step from that neighbour; places within the outer
    radius that are no farther from there than from the end are cut off. A place in several objects' tubes goes to the nearest centreline, then to the smaller label.
    """
    outer, inner = grid.voxels(outer_nm), grid.voxels(inner_nm)
    reach = int(np.ceil(outer))
    span = range(-reach, reach + 1)
    ball = np.array(sorted(((x, y, z) for x in span for y in span for z in span if x * x + y * y + z * z <= outer * outer), key=lambda p: sum(c * c for c in p)))
    far2 = (ball**2).sum(1)
    steps = np.array([s for s, _ in chamfer_steps()])
    halo = reach + 1

    def ends(line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End voxels and the steps on from them."""
        near = np.stack([line[tuple((at + s).T)] for s in steps], 1)
        found = []
        for p, own in zip(at, near, strict=True):
            to = steps[own]
            if len(to) == 2:
                to = to[:0] if ((to[0] - to[1]) ** 2).sum() >= 2 else to[[(to**2).sum(1).argmin()]]
            if len(to) == 1:
                found.append((p, -to[0]))
        return tuple(np.array(c).reshape(-1, 3) for c in zip(*found)) if found else (np.zeros((0, 3), int),) * 2

    def kernel(b: Block) -> dict[str, np.ndarray]:
        v = np.pad(b["v"], reach + 1)
        best, label = np.full(v.shape, _FAR), np.zeros(v.shape, np.int64)
        for own in np.unique(b["v"][b["v"] > 0]):
            line = v == own
            at = np.argwhere(line)
            d2 = np.full(v.shape, _FAR)
            for step, k in zip(ball[::-1], far2[::-1], strict=True):
                # nearer steps come later and stay
                d2[tuple((at + step).T)] = k
            tube = (d2 <= outer * outer) & ~(d2 < inner * inner)
            for p, on in zip(*ends(line, at), strict=True):
                beyond = ball[((ball - on) ** 2).sum(1) <= far2]
                tube[tuple((p + beyond).T)] = False
            nearer = tube & (d2 < best)
            best, label = np.where(nearer, d2, best), np.where(nearer, own, label)
        inner_part = (slice(reach + 1, -reach - 1),) * 3
        return b.rows((label[inner_part] > 0) & b.inside(), v=label[inner_part])

    return over_blocks(centreline.where("v > 0").select(*XYZ, "v"), grid, halo, kernel, "x long, y long, z long, v long")


# Geodesic distance

#: Chamfer steps to face, edge and corner neighbours.
_CHAMFER = {1: 3, 2: 4, 3: 5}


def chamfer_steps() -> list[tuple[tuple[int, int, int], int]]:
    """The 26 neighbours and the lengths of the steps to them."""
    return [((x, y, z), _CHAMFER[abs(x) + abs(y) + abs(z)]) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) != (0, 0, 0)]


def _relax(b: Block, inside: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Distances within a block and its halo of one, until no step lowers any."""
    steps = chamfer_steps()
    while True:
        best = d
        for step, cost in steps:
            best = np.where(inside, np.minimum(best, b.moved(best, step, _FAR) + cost), _FAR)
        if (best == d).all():
            return d
        d = best


def geodesic_state(seeds: DataFrame, mask: DataFrame, grid: Grid, most: int = _FAR - 1) -> State:
    """Blocks with the channels inside and after: the geodesic distance and one more, or 0 where it isn't known."""
    inside = mask.where("v <> 0").select(*XYZ, F.lit(True).alias("inside")).distinct()
    start = seeds.select(*XYZ, F.lit(1).cast("long").alias("after")).distinct()
    known = inside.join(start, XYZ, "left")

    def kernel(b: Block) -> tuple[dict[str, np.ndarray], np.ndarray]:
        before = np.where(b["after"] > 0, b["after"] - 1, _FAR)
        d = _relax(b, b["inside"], before)
        d = np.where(d <= most, d, _FAR)
        return {"after": np.where(d < _FAR, d + 1, 0)}, d < before

    state = State(known, grid, {"inside": np.bool_, "after": np.int64})
    active = state.around(known.where("after > 0"), 1)
    while not active.isEmpty():
        woken = state.run(1, kernel, active, again=False)
        drop(active)
        active = woken
    return state


def geodesic(seeds: DataFrame, mask: DataFrame, grid: Grid, most: int = _FAR - 1) -> DataFrame:
    """Rows (x, y, z, d): chamfer distance (3, 4, 5 for faces, edges and corners) from the seeds within the mask, up to most; labels of the mask don't bound it.

    Each block relaxes to its own fixed point; only blocks whose neighbours' faces got nearer run again, and only they are written.
    """
    found = geodesic_state(seeds, mask, grid, most).rows(lambda a: a["after"] > 0, "x long, y long, z long, after long")
    return found.select(*XYZ, (F.col("after") - 1).alias("d"))
