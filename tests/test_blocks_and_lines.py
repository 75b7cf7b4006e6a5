"""Block states, smoothing over lines and curvature by fundamental forms against whole arrays and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.operators import curvature, distance, lines, objects, thinning
from stratavox.operators.blockstate import State, roomy
from stratavox.operators.volume import Grid

from .test_volumes import SMALL, dense, sparse


@pytest.fixture(scope="module")
def noise():
    return (np.random.default_rng(3).random((12, 12, 12)) < 0.3).astype(int)


# Lines


@pytest.mark.parametrize(("dim", "share"), [((37, 21, 18), 0.3), ((20, 1, 33), 0.5), ((5, 6, 7), 0.02)])
def test_smoothing_equals_whole_arrays(spark, dim, share):
    a = (np.random.default_rng(1).random(dim) < share).astype(int)
    a[0, 0, 0] = 3
    got = dense(lines.gaussian(sparse(spark, a), Grid(dim, (8, 8, 8)), 2.0), dim)
    assert np.allclose(got, curvature.smooth(a.astype(float), 2.0), atol=1e-12)


@pytest.mark.parametrize("measure", ["planarity", "sphereness"])
def test_measures_equal_whole_arrays(spark, measure):
    """All twelve scales, whose kernels are wider than the volume."""
    dim = (37, 21, 18)
    a = (np.random.default_rng(1).random(dim) < 0.3).astype(int)
    at = np.argwhere(a)
    f, best, sigmas = a.astype(float), np.zeros(len(at)), curvature.sigma_series(12)
    for sigma, more in zip(sigmas, curvature.increments(sigmas), strict=True):
        f = curvature.smooth(f, more) if more else f
        best = np.maximum(best, curvature.shape_measures(curvature.eigenvalues_at(f, sigma, at))[measure != "planarity"])
    want = np.zeros(dim)
    want[tuple(at.T)] = best
    grid = Grid(dim, (16, 16, 16))
    assert np.allclose(dense(curvature.planarity(sparse(spark, a), grid, measure=measure), dim), want, atol=1e-9)
    some = sparse(spark, a * (np.indices(dim).sum(0) % 5 == 0))
    assert np.allclose(dense(curvature.planarity(sparse(spark, a), grid, measure=measure, at=some), dim), np.where(np.indices(dim).sum(0) % 5 == 0, want, 0), atol=1e-9)


def test_no_voxels(spark):
    empty = spark.createDataFrame([], "x long, y long, z long, v long")
    assert lines.gaussian(empty, SMALL, 1.0).count() == curvature.planarity(empty, SMALL).count() == curvature.curvature_forms(empty, SMALL, 2, 3).count() == 0
    assert objects.path_weighted(empty, spark.createDataFrame([], "x long, y long, z long, value double"), SMALL).count() == 0


# Fundamental forms


def forms_by_force(a, shell, window):
    """(Gaussian, mean) by place, from the definition, place by place."""
    dim = np.array(a.shape)
    at = lambda p: a[tuple(p)] if all(0 <= c < d for c, d in zip(p, dim)) else 0
    cube = lambda k: [np.array(p) - k for p in np.ndindex(*[2 * k + 1] * 3)]
    mask, normals = np.zeros_like(a), {}
    for p in np.argwhere(a):
        if any(at(p + s) == 0 for s in cube(shell)):
            mask[tuple(p)] = a[tuple(p)]
    where = np.argwhere(mask)
    for p in np.argwhere(a):
        if any(at(p + s) != at(p) for s in cube(1)):
            near = where[(abs(where - p).max(1) <= window) & (mask[tuple(where.T)] == at(p))]
            n = (near - p).mean(0) if len(near) else np.zeros(3)
            if (n**2).sum() > 0:
                normals[tuple(int(c) for c in p)] = n / np.sqrt((n**2).sum())
    out = {}
    for p, n in normals.items():
        axes = sorted(range(3), key=lambda k: (abs(n[k]), k))[:2]
        forms = []
        for k in axes:
            t = np.eye(3)[k] - n[k] * n
            t /= np.sqrt((t**2).sum())
            around = [tuple(s + p) for s in cube(1) if s.any() and tuple(s + p) in normals]
            if not around:
                break
            d = [((np.array(q) - p - t) ** 2).sum() for q in around]
            q = next(q for q, x in zip(around, d) if x < min(d) + 1e-9)
            plane, end = normals[q], p + t
            end = end - ((end - q) @ plane) * plane
            weights = [(tuple(s + q), np.sqrt(((np.array(p) + t - q - s) ** 2).sum())) for s in cube(1) if tuple(s + q) in normals]
            exact = [normals[r] for r, far in weights if far < 1e-9]
            mean = exact[0] if exact else sum(normals[r] / far for r, far in weights)
            mean = mean / np.sqrt((mean**2).sum())
            turn = n - mean
            forms.append((end - p, turn - (turn @ plane) * plane))
        if len(forms) == 2:
            (xu, nu), (xv, nv) = forms
            e, f, g, ll, m1, m2, k = xu @ xu, xu @ xv, xv @ xv, -xu @ nu, -xu @ nv, -xv @ nu, -xv @ nv
            if e * g - f * f > 1e-9:
                out[p] = ((ll * k - m1 * m2) / (e * g - f * f), 0.5 * (ll * g - (m1 + m2) * f + k * e) / (e * g - f * f))
    return out


def test_forms_by_force(spark, noise):
    """Two touching objects with ragged surfaces, at the volume's edge, over blocks of five; and noise with lone voxels."""
    a = np.zeros((12, 12, 12), int)
    a[0:7, 2:10, 1:11] = 1
    a[7:11, 3:9, 2:9] = 2
    a *= 1 - noise * (np.indices(a.shape).sum(0) % 3 == 0)
    for volume, shell, window in ((a, 2, 4), (noise, 1, 2)):
        got = {(r.x, r.y, r.z): (r.gaussian, r.mean) for r in curvature.curvature_forms(sparse(spark, volume), SMALL, shell, window).collect()}
        want = forms_by_force(volume, shell, window)
        assert set(got) == set(want) and len(got) > 50
        for p, (gaussian, mean) in want.items():
            assert got[p] == pytest.approx((gaussian, mean), rel=1e-6, abs=1e-8)


def test_forms_of_known_surfaces(spark):
    """A sphere, a cylinder and a saddle, by the medians over their surfaces away from the volume's edge."""
    n = 48
    grid = Grid((n, n, n), (24, 24, 24))
    x, y, z = np.indices((n, n, n)) - (n - 1) / 2
    shapes = {"sphere": (x**2 + y**2 + z**2 <= 18**2), "cylinder": (x**2 + y**2 <= 18**2), "saddle": (z <= (x**2 - y**2) / 40)}
    median = {}
    for name, inside in shapes.items():
        within = " and ".join(f"{c} between 12 and {n - 13}" for c in ("xyz" if name == "saddle" else "z"))
        rows = curvature.curvature_forms(sparse(spark, inside.astype(int)), grid, 3, 6).where(within).toPandas()
        median[name] = rows.gaussian.median(), rows["mean"].median()
    assert median["sphere"][0] == pytest.approx(18**-2, rel=0.5) and median["sphere"][1] == pytest.approx(-1 / 18, rel=0.35)
    assert abs(median["cylinder"][0]) < 18**-2 / 3 and -0.05 < median["cylinder"][1] < -0.015  # -1 / 36, on a coarse lattice
    assert median["saddle"][0] < 0 and abs(median["saddle"][1]) < 0.02


# Block states


def test_state_keeps_and_changes_blocks(spark):
    a = np.arange(12**3).reshape(12, 12, 12) % 7
    state = State(sparse(spark, a), SMALL, {"v": np.int64})
    read = lambda: dense(state.rows(lambda b: b["v"] > 0, "x long, y long, z long, v long"))
    assert np.array_equal(read(), a)
    corner = spark.createDataFrame([(0, 0, 0)], "bx long, by long, bz long")
    woken = state.run(2, lambda b: ({"v": b["v"] + 10}, np.ones(b.shape, bool)), corner)
    want = a.copy()
    want[:5, :5, :5] += 10
    assert np.array_equal(read(), want) and state.passes == [1] and woken.count() == 8
    for _ in range(14):  # more passes than tables are kept
        woken = state.run(2, lambda b: ({"v": b["v"]}, np.zeros(b.shape, bool)), corner)
    assert np.array_equal(read(), want) and woken.count() == 0
    with pytest.raises(ValueError, match="halo"):
        state.run(6, None, corner)
    assert roomy(SMALL, 12).block == (15, 15, 15)


def test_finished_blocks_lie_still(spark):
    """A long bar with a thick end: passes over its thin part end sooner, and the skeleton is that of one block."""
    a = np.zeros((72, 12, 12), int)
    a[:60, 5:7, 5:7] = 1
    a[60:71, 1:11, 1:11] = 1
    grid = Grid((72, 12, 12), (12, 12, 12))
    state = thinning.thinned(sparse(spark, a), grid)
    assert state.passes[0] == 6 and state.passes[-1] <= 2 and state.passes == sorted(state.passes, reverse=True) and len(state.passes) > 2
    whole = dense(thinning.thin(sparse(spark, a), Grid((72, 12, 12), (72, 12, 12))), (72, 12, 12))
    assert np.array_equal(dense(state.rows(lambda b: b["v"] > 0, "x long, y long, z long, v long"), (72, 12, 12)), whole)


def test_path_weighted_values_by_force(spark, noise):
    mask = 1 - noise
    r = np.random.default_rng(9)
    medial = {tuple(map(int, p)): float(r.random()) for p in np.argwhere(mask)[::97]}
    d = {(q.x, q.y, q.z): q.d for q in distance.geodesic(spark.createDataFrame(list(medial), "x long, y long, z long"), sparse(spark, mask), SMALL).collect()}
    want = {}
    for p in sorted(d, key=d.get):
        if d[p] == 0:
            want[p] = (medial[p], 1)
            continue
        before = [want[q] for s in np.ndindex(3, 3, 3) if (q := tuple(a + b - 1 for a, b in zip(p, s))) in want and q != p and d[q] == d[p] - 2 - sum(abs(b - 1) for b in s)]
        n = sum(c for _, c in before)
        want[p] = (sum(m * c for m, c in before) / n, n)
    rows = spark.createDataFrame([(*p, v) for p, v in medial.items()], "x long, y long, z long, value double")
    got = {(q.x, q.y, q.z): q.value for q in objects.path_weighted(sparse(spark, mask), rows.withColumn("extra", F.lit(1)), SMALL).collect()}
    assert set(got) == set(want) and max(n for _, n in want.values()) > 10
    for p, (mean, _) in want.items():
        assert got[p] == pytest.approx(mean)
