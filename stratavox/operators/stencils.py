"""Neighbourhood operators: numpy kernels over blocks with halos, so a neighbourhood costs one exchange whatever its size."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lines import gaussian, gaussian_weights  # noqa: F401 - smoothing is a neighbourhood operator as well
from .volume import XYZ, Block, Grid, map_blocks, over_blocks, stencil, united

_LEAST = -(1 << 62)
FACES = "d2 = 1"
AROUND = "d2 > 0"
CORNERS = "d2 = 3"
#: Offsets of one half space, so that each pair of neighbours is met once.
HALF = "(dz > 0 or dz = 0 and (dy > 0 or dy = 0 and dx > 0))"


_AROUND = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) != (0, 0, 0)]


def exposed_faces(volume: DataFrame, grid: Grid, count_edge: bool = False, against_background: bool = False) -> DataFrame:
    """Rows (x, y, z, v, faces): faces towards another value, or only towards background.

    Faces on the volume's edge count only with count_edge.
    """

    def kernel(b: Block) -> dict[str, np.ndarray]:
        v, inside = b["v"], b.inside()
        faces = np.zeros(v.shape, np.int64)
        for step in (s for s in _AROUND if sum(map(abs, s)) == 1):
            other = b.moved(v, step)
            differs = other == 0 if against_background else other != v
            faces += differs if count_edge else differs & b.moved(inside, step, False)
        return b.rows(v > 0, v=v, faces=faces)

    return over_blocks(volume.where("v > 0").select(*XYZ, "v"), grid, 1, kernel, "x long, y long, z long, v long, faces long")


def surface(b: Block, v: np.ndarray) -> np.ndarray:
    """Which set voxels have a different value among the 26 neighbours in the volume."""
    inside, out = b.inside(), np.zeros(v.shape, bool)
    for step in _AROUND:
        out |= (b.moved(v, step) != v) & b.moved(inside, step, False)
    return out & (v > 0)


def surface_voxels(volume: DataFrame, grid: Grid) -> DataFrame:
    """Set voxels of which any of the 26 neighbours in the volume differs."""
    return over_blocks(volume.where("v > 0").select(*XYZ, "v"), grid, 1, lambda b: b.rows(surface(b, b["v"]), v=b["v"]), "x long, y long, z long, v long")


def touching_objects(volume: DataFrame, grid: Grid) -> DataFrame:
    """Rows (a, b), a < b: objects with voxels that are 26-neighbours."""

    def kernel(b: Block) -> dict[str, np.ndarray]:
        v, found = b["v"], []
        for step in _AROUND:
            own, other = v[b.core], b.moved(v, step)[b.core]
            met = (own > 0) & (own < other)
            found.append(np.column_stack([own[met], other[met]]))
        pairs = np.unique(np.concatenate(found), axis=0)
        return {"a": pairs[:, 0], "b": pairs[:, 1]}

    return over_blocks(volume.where("v > 0").select(*XYZ, "v"), grid, 1, kernel, "a long, b long").distinct()


def adjacent_kept(volume: DataFrame, kept: DataFrame, grid: Grid) -> DataFrame:
    """Rows (v, number): for objects not in kept (v), the smallest kept object at a corner neighbour."""
    mark = volume.where("v > 0").join(kept.select("v").distinct().withColumn("kept", F.lit(True)), "v", "left").select(*XYZ, "v", F.coalesce("kept", F.lit(False)).alias("kept"))

    def kernel(b: Block) -> dict[str, np.ndarray]:
        v, found = b["v"], []
        loose = ((v > 0) & ~b["kept"])[b.core]
        for step in (s for s in _AROUND if sum(map(abs, s)) == 3):
            met = loose & b.moved(b["kept"], step, False)[b.core]
            found.append(np.column_stack([v[b.core][met], b.moved(v, step)[b.core][met]]))
        pairs = np.unique(np.concatenate(found), axis=0)
        return {"v": pairs[:, 0], "number": pairs[:, 1]}

    return over_blocks(mark, grid, 1, kernel, "v long, number long").groupBy("v").agg(F.min("number").alias("number"))


def gradient(volume: DataFrame, axis: str, sigma: float = 1.0, central: bool = True) -> DataFrame:
    """Rows (x, y, z, g) where a difference of values along an axis isn't 0; places beyond the set voxels count as 0.

    Central: (f(x + 1) - f(x - 1)) * sigma / 2. Forward: f(x + 1) - f(x).
    """
    weights = [(-1, 0.5 * sigma), (1, -0.5 * sigma)] if central else [(-1, 1.0), (0, -1.0)]
    terms = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in weights))
    moved = volume.select(*XYZ, "v", F.explode(terms).alias("t")).withColumn(axis, F.col(axis) + F.col("t.d"))
    return moved.groupBy(*XYZ).agg(F.sum(F.col("v") * F.col("t.w")).alias("g")).where("g <> 0")


def ball_max(b: Block, a: np.ndarray, radius: int, low) -> np.ndarray:
    """The greatest value in the ball around each place: running maxima along z, then a shift for each column of the ball."""
    along, out = [a], np.full_like(a, low)
    for k in range(1, radius + 1):
        along.append(np.maximum(along[-1], np.maximum(b.moved(a, (0, 0, k), low), b.moved(a, (0, 0, -k), low))))
    for dx in range(-radius, radius + 1):
        for dy in range(-radius, radius + 1):
            rest = radius * radius - dx * dx - dy * dy
            if rest >= 0:
                out = np.maximum(out, b.moved(along[math.isqrt(rest)], (dx, dy, 0), low))
    return out


def local_maxima(volume: DataFrame, grid: Grid, radius: int) -> DataFrame:
    """Voxels with no strictly greater value within a ball."""

    def kernel(b: Block) -> dict[str, np.ndarray]:
        v = b["v"]
        return b.rows((v != 0) & (ball_max(b, np.where(v != 0, v, _LEAST), radius, _LEAST) <= v), v=v)

    return over_blocks(volume.select(*XYZ, "v"), grid, radius, kernel, "x long, y long, z long, v long")


def stamp_balls(points: DataFrame, grid: Grid, radius: int) -> DataFrame:
    """The union of balls around voxels; the greatest value wins."""

    def kernel(b: Block) -> dict[str, np.ndarray]:
        best = ball_max(b, np.where(b["v"] != 0, b["v"], _LEAST), radius, _LEAST)
        return b.rows((best > _LEAST) & b.inside(), v=best)

    return over_blocks(points.select(*XYZ, "v"), grid, radius, kernel, "x long, y long, z long, v long")


def internal_gradient(volume: DataFrame, grid: Grid, half: int) -> DataFrame:
    """Object voxels with background inside the cube of that half width."""

    def kernel(dense: np.ndarray, corner) -> np.ndarray:
        low = dense > 0
        for axis in range(3):
            padded = np.pad(low, [(half, half) if a == axis else (0, 0) for a in range(3)], constant_values=True)
            low = np.logical_and.reduce([np.take(padded, range(k, k + dense.shape[axis]), axis=axis) for k in range(2 * half + 1)])
        return np.where((dense > 0) & ~low, dense, 0)

    return map_blocks(volume, grid, half, kernel)


def sphereness(volume: DataFrame, centres: DataFrame, grid: Grid, radius: int, at_least: int = 127) -> DataFrame:
    """Rows (x, y, z, v, fraction, offset, score): how much of the ball around each centre is set and in its sight, and how far that part's centre of mass is off.

    A place is in sight if every voxel of the lattice line to it reaches at_least. Score: fraction + 1 - offset / radius. Places beyond the volume aren't set.
    """
    from .components import line_voxels

    span = range(-radius, radius + 1)
    ball = [(x, y, z) for x in span for y in span for z in span if x * x + y * y + z * z <= radius * radius]
    lines = np.array([(line + [line[-1]] * radius)[: radius + 1] for line in (line_voxels(*p) for p in ball)])  # [place, step, axis]

    def kernel(b: Block) -> dict[str, np.ndarray]:
        set_ = b["v"] >= at_least
        rows = b.rows(b["centre"] != 0, v=b["centre"])
        at = np.stack([rows[c] - o for c, o in zip(XYZ, b.corner, strict=True)], 1)
        n, moment = np.zeros(len(at), np.int64), np.zeros((len(at), 3), np.int64)
        for place, line in zip(np.array(ball), lines, strict=True):
            seen = np.logical_and.reduce([set_[tuple((at + step).T)] for step in np.unique(line, axis=0)])
            n += seen
            moment += seen[:, None] * place
        with np.errstate(divide="ignore", invalid="ignore"):
            offset = np.where(n > 0, np.sqrt((moment**2).sum(1)) / n, float(radius))
        fraction = n / len(ball)
        return rows | {"fraction": fraction, "offset": offset, "score": fraction + 1 - offset / radius}

    return over_blocks(united(v=volume, centre=centres), grid, radius, kernel, "x long, y long, z long, v long, fraction double, offset double, score double")


def nonoverlapping(points: DataFrame, grid: Grid, radius: float, separation: int) -> DataFrame:
    """Points chosen greedily by residue class of their coordinates (then by voxel id) so that all are farther apart than separation.

    A point is decided once no undecided point nearby comes before it, so each round decides many; the choice is that of the sequential greedy.
    """
    from stratavox.plans.checkpoints import cut

    k = round(radius) + 1
    order = F.struct((F.col("x") % k + F.col("y") % k * k + F.col("z") % k * k * k).alias("part"), grid.index().alias("id"))
    left = cut(points.select(*XYZ, "v").withColumn("rank", order))
    near = f"d2 > 0 and d2 <= {separation * separation}"
    chosen = left.limit(0)
    while not left.isEmpty():
        waits = stencil(left.select(*XYZ, "rank"), near, separation).join(left.select(*XYZ, F.col("rank").alias("other")), XYZ).where("other < rank")
        won = cut(left.join(waits.select(*(F.col(f"{c}0").alias(c) for c in XYZ)).distinct(), XYZ, "left_anti"))
        out = stencil(won.select(*XYZ, "rank"), f"d2 <= {separation * separation}", separation).select(*XYZ).distinct()
        left, chosen = cut(left.join(out, XYZ, "left_anti")), chosen.unionByName(won)
    return chosen.select(*XYZ, "v")


def surface_normals(volume: DataFrame, surface: DataFrame, grid: Grid, radius: int) -> DataFrame:
    """Rows (x, y, z, v, nx, ny, nz): the unit vector from each surface voxel to the centre of mass of its object within a cube.

    Sums over cubes are differences of running sums, so the work doesn't grow with the cube.
    """

    def box_sums(a: np.ndarray) -> np.ndarray:
        for axis in range(3):
            c = np.pad(np.cumsum(a, axis=axis), [(radius + 1, radius) if k == axis else (0, 0) for k in range(3)], mode="constant")
            n = a.shape[axis]
            c = np.moveaxis(c, axis, 0)
            c[n + radius + 1 :] = c[n + radius]
            a = np.moveaxis(c[2 * radius + 1 : 2 * radius + 1 + n] - c[:n], 0, axis)
        return a

    def kernel(b: Block) -> dict[str, np.ndarray]:
        rows = b.rows(b["on"] != 0, v=b["on"])
        at = np.stack([rows[c] - o for c, o in zip(XYZ, b.corner, strict=True)], 1)
        sums = np.zeros((len(at), 4), np.int64)
        place = np.indices(b.shape)
        for label in np.unique(rows["v"]):
            own, same = rows["v"] == label, (b["v"] == label).astype(np.int64)
            for k, a in enumerate([same, *(same * place[axis] for axis in range(3))]):
                sums[own, k] = box_sums(a)[tuple(at[own].T)]
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(sums[:, :1] > 0, (sums[:, 1:] - sums[:, :1] * at) / sums[:, :1], 0.0)
            length = np.sqrt((mean**2).sum(1))[:, None]
            unit = np.where(length > 0, mean / length, 0.0)
        return rows | {f"n{c}": unit[:, k] for k, c in enumerate(XYZ)}

    return over_blocks(united(v=volume, on=surface), grid, radius, kernel, "x long, y long, z long, v long, nx double, ny double, nz double")
