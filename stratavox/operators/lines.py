"""Separable smoothing over whole lines, for many scales at once.

Smoothing along one axis commutes with that along another, so all scales go through one pass an axis. A pass works on bundles of CELL x CELL whole lines and hands
its results on as dense pieces of CELL places along the axis, one row of bytes each; pieces that are all zero aren't sent. What moves between passes is the number of scales times the
places near objects, whatever the kernels' widths, and a task holds one bundle.

Lines are mirrored at the volume's edges without repeating the edge place. Such a line is one half of a period, so kernels act on its spectrum, and
kernels one after the other multiply there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .volume import XYZ, Grid

#: Lines in a bundle along each of the two other axes, and places of a piece along the lines.
CELL = 16
#: Values below this share of a bundle's greatest one are rounding errors of the spectrum.
TINY = 1e-14
PIECE = "k0 long, k1 long, ox long, oy long, oz long, dx int, dy int, dz int, data binary"


def gaussian_weights(sigma: float) -> list[float]:
    """A half kernel of 3 sigma, normalised."""
    half = max(2, int(3 * sigma + 0.5) + 1)
    w = [float(np.exp(-0.5 * (k / sigma) ** 2)) for k in range(half)]
    total = w[0] + 2 * sum(w[1:])
    return [x / total for x in w]


def responses(n: int, sigmas: list[float]) -> np.ndarray:
    """What each kernel and all before it do to the spectrum of a mirrored line of n places; a sigma of 0 does nothing."""
    out, product = [], np.ones(n)
    turn = np.pi * np.arange(n) / max(1, n - 1)
    for sigma in sigmas:
        if sigma:
            w = gaussian_weights(sigma)
            product = product * (w[0] + 2 * sum(x * np.cos(k * turn) for k, x in enumerate(w) if k))
        out.append(product)
    return np.array(out)


def smooth_lines(a: np.ndarray, response: np.ndarray) -> np.ndarray:
    """Lines along the last axis of [scale or 1, ..., n], by the responses [scale, n] of their scales."""
    n, low = a.shape[-1], TINY * np.abs(a).max(initial=0)
    if n > 1:
        a = np.fft.irfft(np.fft.rfft(np.concatenate([a, a[..., -2:0:-1]], -1)) * response[:, None, None, :], 2 * n - 2)[..., :n]
    else:
        a = np.broadcast_to(a, (len(response), *a.shape[1:])).copy()
    a[np.abs(a) <= low] = 0
    return a


def others(axis: int) -> list[int]:
    return [k for k in range(3) if k != axis]


class Bundle:
    """Whole lines along an axis: values [scale, x, y, z] from a corner, with a halo of lines around."""

    def __init__(self, t: pa.Table, grid: Grid, axis: int, halo: int):
        col = {c: t.column(c).combine_chunks() for c in t.column_names}
        number = lambda c: np.asarray(col[c])
        keys = [int(number(k)[0]) for k in ("k0", "k1")]
        self.axis, self.dim, self.keys = axis, grid.dim, keys
        self.corner, size = [0, 0, 0], list(grid.dim)
        for k, at in zip(others(axis), keys, strict=True):
            self.corner[k], size[k] = at * CELL - halo, CELL + 2 * halo
        self.values = None
        origin, extent = (np.stack([number(f"{p}{c}") for c in XYZ], 1) for p in "od")
        dense = np.asarray(col["data"].is_valid())
        for i in np.flatnonzero(dense):
            piece = np.frombuffer(col["data"][i].as_buffer(), np.float64).reshape(-1, *extent[i])
            if self.values is None:
                self.values = np.zeros((len(piece), *size))
            o = origin[i] - self.corner
            self.values[(slice(None), *(slice(p, p + d) for p, d in zip(o, extent[i], strict=True)))] = piece
        #: Places that came as rows of their own.
        self.places = origin[~dense]

    def inside(self) -> tuple[np.ndarray, list[int]]:
        """The values within the volume, and their corner."""
        low = [max(0, -c) for c in self.corner]
        high = [min(n, d - c) for n, c, d in zip(self.values.shape[1:], self.corner, self.dim, strict=True)]
        return self.values[(slice(None), *(slice(p, q) for p, q in zip(low, high, strict=True)))], [c + p for c, p in zip(self.corner, low, strict=True)]

    def along(self, response: np.ndarray) -> np.ndarray:
        """The values smoothed along the bundle's lines."""
        moved = np.moveaxis(self.values, self.axis + 1, -1)
        return np.moveaxis(smooth_lines(moved, response), -1, self.axis + 1)


def _pieces(values: np.ndarray, corner: list[int], dim: tuple[int, ...], axis: int, to: int, halo: int) -> pa.Table:
    """Rows of PIECE: values in pieces along an axis, each for the bundle along the next axis that it is in, and its margins for those that it is within the halo of."""
    rows = []
    values = values[(slice(None), *(slice(0, d - c) for c, d in zip(corner, dim, strict=True)))]
    for s in range(0, dim[axis], CELL):
        part = np.take(values, range(s, min(s + CELL, dim[axis])), axis + 1)
        if not part.any():
            continue
        start = list(corner)
        start[axis] = s
        for step in [(0, 0)] if not halo else [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
            cut, origin, keys = [slice(None)] * 4, list(start), []
            for k, d in zip(others(to), step, strict=True):
                keys.append(start[k] // CELL + d)
                if d < 0:
                    cut[k + 1] = slice(0, halo)
                elif d > 0:
                    cut[k + 1] = slice(CELL - halo, CELL)
                    origin[k] += CELL - halo
            own = part[tuple(cut)]
            if own.size and own.any() and all(0 <= q * CELL < dim[k] for q, k in zip(keys, others(to), strict=True)):
                rows.append((*keys, *origin, *own.shape[1:], np.ascontiguousarray(own).tobytes()))
    types = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.binary()]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[f.split()[0] for f in PIECE.split(", ")])


def _places(rows: DataFrame, axis: int) -> DataFrame:
    """Rows of PIECE without data: places, each for its bundle along an axis."""
    keys = [F.floor(F.col(XYZ[k]) / CELL).alias(f"k{i}") for i, k in enumerate(others(axis))]
    return rows.select(*keys, *(F.col(c).alias(f"o{c}") for c in XYZ), *(F.lit(0).alias(f"d{c}") for c in XYZ), F.lit(None).cast("binary").alias("data"))


def smoothed(volume: DataFrame, grid: Grid, sigmas: list[float], last: Callable[[np.ndarray, Bundle], dict[str, np.ndarray]], schema: str, at: DataFrame | None = None, halo: int = 0) -> DataFrame:
    """Runs last(values, bundle) on the volume (x, y, z, v) smoothed by each sigma and all before it: dense values [sigma, x, y, z] of bundles along x, with a halo of lines.

    at names places (x, y, z) that their bundles get; without it bundles get none.
    """
    first = volume.select(*(F.floor(F.col(XYZ[k]) / CELL).alias(f"k{i}") for i, k in enumerate(others(2))), *XYZ, F.col("v").cast("double").alias("v"))
    answer = [responses(n, sigmas) for n in grid.dim]

    def along_z(t: pa.Table) -> pa.Table:
        col = {c: np.asarray(t.column(c).combine_chunks()) for c in t.column_names}
        corner = [int(col["k0"][0]) * CELL, int(col["k1"][0]) * CELL, 0]
        dense = np.zeros((1, CELL, CELL, grid.dim[2]))
        dense[(0, *(col[c] - o for c, o in zip(XYZ, corner, strict=True)))] = col["v"]
        return _pieces(smooth_lines(dense, answer[2]), corner, grid.dim, 2, 1, 0)

    def along_y(t: pa.Table) -> pa.Table:
        b = Bundle(t, grid, 1, 0)
        return _pieces(b.along(answer[1]), b.corner, grid.dim, 1, 0, halo)

    def along_x(t: pa.Table) -> pa.Table:
        b = Bundle(t, grid, 0, halo)
        if b.values is None:
            b.values = np.zeros((len(sigmas), grid.dim[0], CELL + 2 * halo, CELL + 2 * halo))
        return pa.table(last(b.along(answer[0]), b))

    pieces = first.groupBy("k0", "k1").applyInArrow(along_z, PIECE).groupBy("k0", "k1").applyInArrow(along_y, PIECE)
    if at is not None:
        pieces = pieces.unionByName(_places(at, 0))
    return pieces.groupBy("k0", "k1").applyInArrow(along_x, schema)


def gaussian(volume: DataFrame, grid: Grid, sigma: float) -> DataFrame:
    """Rows (x, y, z, v double): separable smoothing with the volume mirrored at its edges (the edge voxel isn't repeated)."""

    def last(values: np.ndarray, b: Bundle) -> dict[str, np.ndarray]:
        b.values = values
        own, corner = b.inside()
        at = np.nonzero(own[0])
        return {c: p + o for c, p, o in zip(XYZ, at, corner, strict=True)} | {"v": own[0][at]}

    return smoothed(volume, grid, [sigma], last, "x long, y long, z long, v double")
