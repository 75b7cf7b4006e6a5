"""Planarity and sphereness from Hessian eigenvalues over scales, and Gaussian and mean curvature at surfaces: of the smoothed level set, and by fundamental forms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.plans.checkpoints import cut

from .lines import Bundle, gaussian_weights, smoothed
from .stencils import surface_normals
from .volume import XYZ, Block, Grid, map_blocks, over_blocks

#: Measures up to this are rounding errors.
LEAST = 1e-12


def sigma_series(scales: int = 12, per_octave: int = 2) -> list[float]:
    """0.5, growing by an octave each per_octave scales."""
    return [0.5 * 2 ** (k / per_octave) for k in range(scales)]


def smooth(dense: np.ndarray, sigma: float) -> np.ndarray:
    w = gaussian_weights(sigma)
    for axis in range(3):
        moved = np.moveaxis(dense, axis, -1)
        padded = np.pad(moved, [(0, 0), (0, 0), (len(w) - 1,) * 2], mode="reflect" if moved.shape[-1] > 1 else "edge")
        n = moved.shape[-1]
        out = w[0] * padded[..., len(w) - 1 : len(w) - 1 + n]
        for k in range(1, len(w)):
            out = out + w[k] * (padded[..., len(w) - 1 - k : len(w) - 1 - k + n] + padded[..., len(w) - 1 + k : len(w) - 1 + k + n])
        dense = np.moveaxis(out, -1, axis)
    return dense


def shape_measures(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(planarity, sphereness) of bright structures: plates have one large negative eigenvalue, blobs three."""
    l1, l2, l3 = (np.abs(values[..., k]) for k in range(3))
    with np.errstate(divide="ignore", invalid="ignore"):
        blob = np.abs(2 * l3 - l2 - l1) / l3
        noise = np.sqrt(l1**2 + l2**2 + l3**2)
        planarity = np.exp(-((l2 / l3) ** 2) / 0.5) * (1 - np.exp(-(blob**2) / 0.5)) * (1 - np.exp(-(noise**2) / 0.5))
        sphere = np.exp(-(blob**2) / 0.5)
    ok = values[..., 2] < 0
    return np.where(ok, np.nan_to_num(planarity), 0), np.where(ok, np.nan_to_num(sphere), 0)


def increments(sigmas: list[float]) -> list[float]:
    """What each scale adds to the smoothing before it, so that scales accumulate; the image itself has the first one's sharpness."""
    return [0.0] + [math.sqrt(b * b - a * a) for a, b in zip(sigmas, sigmas[1:])]


def eigenvalues_at(dense: np.ndarray, sigma: float, at: np.ndarray) -> np.ndarray:
    """Eigenvalues, by absolute value, of the scale-normalised Hessian at some places; differences are central and the edge repeats.

    They are rounded, and of two with the same absolute value the negative one is last, so that rounding errors don't choose between them.
    """
    f = np.pad(dense, 2, mode="edge")
    p = at + 2

    def value(*steps):
        return f[tuple((p + np.array(steps)).T)]

    h = np.zeros((len(at), 3, 3))
    for i in range(3):
        for j in range(i + 1):
            ei, ej = np.eye(3, dtype=int)[[i, j]]
            h[:, i, j] = h[:, j, i] = sigma * sigma * sum(s * t * value(*(s * ei + t * ej)) for s in (-1, 1) for t in (-1, 1)) / 4
    values = np.round(np.linalg.eigvalsh(h)[..., ::-1], 12)
    return np.take_along_axis(values, np.abs(values).argsort(-1, kind="stable"), -1)


def planarity(volume: DataFrame, grid: Grid, scales: int = 12, measure: str = "planarity", at: DataFrame | None = None) -> DataFrame:
    """Rows (x, y, z, v double): the greatest measure over scales at object voxels, or at those of another volume (a medial surface) only.

    Smoothing accumulates from scale to scale over whole lines, mirrored at the volume's edges. The Hessian is made only where it is asked for.
    """
    sigmas = sigma_series(scales)
    objects = volume.where("v > 0").select(*XYZ)
    places = objects if at is None else at.where("v > 0").select(*XYZ).join(objects, XYZ, "left_semi")

    def last(values: np.ndarray, b: Bundle) -> dict[str, np.ndarray]:
        b.values = values
        own, corner = b.inside()
        best = np.zeros(len(b.places))
        for f, sigma in zip(own, sigmas, strict=True):
            if len(best):
                best = np.maximum(best, shape_measures(eigenvalues_at(f, sigma, b.places - corner))[measure != "planarity"])
        some = best > LEAST
        return {c: b.places[some, k] for k, c in enumerate(XYZ)} | {"v": best[some]}

    # a central difference of central differences reaches two places
    return smoothed(objects.withColumn("v", F.lit(1)), grid, increments(sigmas), last, "x long, y long, z long, v double", at=places, halo=2)


def surface_curvature(volume: DataFrame, grid: Grid, sigma: float = 2.0, kind: str = "mean") -> DataFrame:
    """Rows (x, y, z, v double): curvature of the smoothed level set at object voxels with a background face.

    Mean: half the divergence of the unit normal. Gaussian: the bordered Hessian's determinant over the gradient's fourth power.
    """
    halo = int(3 * sigma) + 4

    def kernel(dense: np.ndarray, corner) -> np.ndarray:
        f = smooth((dense > 0).astype(float), sigma)
        g = np.stack([np.gradient(f, axis=a) for a in range(3)], -1)
        h = np.stack([np.stack([np.gradient(g[..., a], axis=b) for b in range(3)], -1) for a in range(3)], -2)
        size2 = (g**2).sum(-1)
        with np.errstate(divide="ignore", invalid="ignore"):
            if kind == "mean":
                out = (np.einsum("...i,...ij,...j->...", g, h, g) - size2 * np.trace(h, axis1=-2, axis2=-1)) / (2 * size2**1.5)
            else:
                adjugate = np.stack([np.cross(h[..., 1, :], h[..., 2, :]), np.cross(h[..., 2, :], h[..., 0, :]), np.cross(h[..., 0, :], h[..., 1, :])], -2)
                out = np.einsum("...i,...ij,...j->...", g, adjugate, g) / size2**2
        inner = np.pad(dense > 0, 1)
        covered = np.logical_and.reduce([inner[tuple(slice(1 + a, n - 1 + a) for a, n in zip(d, inner.shape, strict=True))] for d in [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]])
        return np.where((dense > 0) & ~covered, np.nan_to_num(out), 0)

    return map_blocks(volume, grid, halo, kernel, "double")


# Curvature by fundamental forms

_AROUND = np.array([(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])


def tangents(normal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two unit vectors in the plane of each normal: the projections of the axes that lie most and second most across it; the first axis on ties."""
    order = np.abs(normal).argsort(-1, kind="stable")
    out = []
    for k in (0, 1):
        axis = order[:, k]
        t = np.eye(3)[axis] - np.take_along_axis(normal, axis[:, None], 1) * normal
        out.append(t / np.sqrt((t * t).sum(1))[:, None])
    return out[0], out[1]


def _step(n: np.ndarray, at: np.ndarray, own: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(X, N): how place and normal change from surface voxels to a step t along a tangent; NaN where no other surface voxel is near.

    The step ends on the plane of the nearest surface voxel around, and the normal there is the mean of those around that one, by their nearness to the step. n: normals [x, y, z, 3], 0 elsewhere.
    """
    there = lambda p: n[tuple(p.T)]
    square = lambda v: (v * v).sum(-1, keepdims=True)
    best, o = np.full(len(at), np.inf), np.zeros((len(at), 3), np.int64)
    for step in _AROUND:
        if step.any():
            d2 = np.where(square(there(at + step))[:, 0] > 0, square(step - t)[:, 0], np.inf)
            nearer = d2 < best - 1e-9
            best, o = np.where(nearer, d2, best), np.where(nearer[:, None], step, o)
    plane = there(at + o)
    x = t - ((t - o) * plane).sum(1)[:, None] * plane
    total, exact = np.zeros_like(t), np.zeros_like(t)
    for step in _AROUND:
        near = there(at + o + step)
        far = np.sqrt(square(o + step - t))
        same = (far < 1e-9) & (square(near) > 0)
        exact = np.where(same, near, exact)
        total += np.where(square(near) > 0, near / np.where(far < 1e-9, 1, far), 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(square(exact) > 0, exact, total / np.sqrt(square(total)))
    turn = own - mean
    out = turn - (turn * plane).sum(1)[:, None] * plane
    return x, np.where(np.isfinite(best)[:, None], out, np.nan)


def forms(n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Gaussian, mean) curvature at places of an array of normals [x, y, z, 3], from the first and second fundamental forms; NaN where they aren't defined."""
    own = n[tuple(at.T)]
    (xu, nu), (xv, nv) = (_step(n, at, own, t) for t in tangents(own))
    dot = lambda a, b: (a * b).sum(1)
    e, f, g = dot(xu, xu), dot(xu, xv), dot(xv, xv)
    l, m1, m2, k = -dot(xu, nu), -dot(xu, nv), -dot(xv, nu), -dot(xv, nv)  # noqa: E741 - the usual names; the two mixed terms needn't be equal
    area = e * g - f * f
    with np.errstate(divide="ignore", invalid="ignore"):
        gaussian, mean = (l * k - m1 * m2) / area, 0.5 * (l * g - (m1 + m2) * f + k * e) / area
    ok = np.isfinite(gaussian) & np.isfinite(mean) & (area > 1e-9)
    return np.where(ok, gaussian, np.nan), np.where(ok, mean, np.nan)


def curvature_forms(volume: DataFrame, grid: Grid, shell: int = 10, window: int = 35) -> DataFrame:
    """Rows (x, y, z, v, gaussian, mean): curvature of objects at their surface voxels, those with another value or the volume's outside among the 26 neighbours.

    A surface voxel's normal points to the centre of mass of its object's shell, the voxels with background within shell places, in a cube of half width window. Tangents, steps
    along them and changes of the normal give the two fundamental forms. A sphere of radius r has Gaussian curvature near r ** -2 and mean curvature near -1 / r,
    negative where the surface curves around the object. Voxels whose normal or forms aren't defined have no row: no other surface voxel around, or a shell that is
    even on all sides.

    Three exchanges: shells, with a halo of shell places; normals, of shell and surface voxels alone with a halo of the window, so that blocks should be no smaller than it; and
    the normals themselves, with a halo of two.
    """
    objects = volume.where("v > 0").select(*XYZ, "v")

    def skin(b: Block) -> dict[str, np.ndarray]:
        v = b["v"]
        low = v > 0
        for axis in range(3):
            least = low
            for k in range(1, shell + 1):
                step = tuple(k * (a == axis) for a in range(3))
                back = tuple(-s for s in step)
                least = least & b.moved(low, step, False) & b.moved(low, back, False)
            low = least
        edge = np.zeros(v.shape, bool)
        for step in _AROUND:
            edge |= b.moved(v, tuple(step)) != v
        kinds = np.where(~low, 1, 0) + np.where(edge, 2, 0)
        return b.rows((v > 0) & (kinds > 0), v=v, kind=kinds.astype(np.int64))

    skins = cut(over_blocks(objects, grid, max(shell, 1), skin, "x long, y long, z long, v long, kind long"))
    normals = surface_normals(skins.where("kind & 1 = 1"), skins.where("kind & 2 = 2"), grid, window).where("nx <> 0 or ny <> 0 or nz <> 0")

    def kernel(b: Block) -> dict[str, np.ndarray]:
        n = np.stack([b[f"n{c}"] for c in XYZ], -1)
        rows = b.rows(b["v"] > 0, v=b["v"])
        at = np.stack([rows[c] - o for c, o in zip(XYZ, b.corner, strict=True)], 1)
        gaussian, mean = forms(n, at)
        ok = np.isfinite(mean)
        return {c: a[ok] for c, a in (rows | {"gaussian": gaussian, "mean": mean}).items()}

    return over_blocks(cut(normals), grid, 2, kernel, "x long, y long, z long, v long, gaussian double, mean double")
