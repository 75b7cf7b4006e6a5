"""Parts of blocks: pairs of objects, small components, tubes with open ends, workflow options and sheetness tables by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.operators import components as cc
from stratavox.operators import curvature, distance, objects, volume
from stratavox.operators.volume import XYZ

from .test_volumes import SMALL, dense, flood, sparse


@pytest.fixture(scope="module")
def noise():
    return (np.random.default_rng(3).random((12, 12, 12)) < 0.3).astype(int)


@pytest.mark.parametrize("around", [False, True])
def test_pair_components_by_force(spark, around):
    """Places in several pairs; pairs that touch each other stay apart."""
    r = np.random.default_rng(6)
    pairs = {(1, 2): r.random((12, 12, 12)) < 0.3, (1, 3): r.random((12, 12, 12)) < 0.15, (4, 2): r.random((12, 12, 12)) < 0.05}
    rows = [(*map(int, p), a, b) for (a, b), where in pairs.items() for p in np.argwhere(where)]
    got = {(q.x, q.y, q.z, q.a, q.b): q.component for q in cc.pair_components(spark.createDataFrame(rows, "x long, y long, z long, a long, b long"), SMALL, around).collect()}
    assert set(got) == set(rows)
    for (a, b), where in pairs.items():
        label = flood(where.astype(int), around)
        least = {}
        for p in np.argwhere(where):
            i = int(144 * p[2] + 12 * p[1] + p[0] + 1)
            least[label[tuple(p)]] = min(least.get(label[tuple(p)], i), i)
        assert all(got[(*map(int, p), a, b)] == least[label[tuple(p)]] for p in np.argwhere(where))


@pytest.mark.parametrize("around", [False, True])
@pytest.mark.parametrize("more_than", [0, 1, 4, 30])
def test_small_components_go_within_blocks(spark, noise, around, more_than):
    """Sizes count over blocks: what is small in its block stays if it goes on in the next."""
    kept = cc.keep_sizes(cc.components(sparse(spark, noise), SMALL, around, more_than), more_than)
    label = flood(noise, around)
    size = np.bincount(label.ravel())
    assert np.array_equal(dense(kept.select(*XYZ, F.lit(1).alias("v"))), ((label > 0) & (size[label] > more_than)).astype(int))
    early = cc._contracted(sparse(spark, noise), SMALL, around, more_than).count()
    assert early < noise.sum() if more_than > 1 else early <= noise.sum()


def tubes_by_force(a, outer, inner):
    dim = a.shape
    reach = int(np.ceil(outer))
    ball = [np.array(p) - reach for p in np.ndindex(*[2 * reach + 1] * 3)]
    ball = [p for p in ball if (p**2).sum() <= outer**2]
    best = {}
    for own in np.unique(a[a > 0]):
        line = {tuple(map(int, p)) for p in np.argwhere(a == own)}
        tube = {}
        for p in line:
            for s in ball:
                q = tuple(int(c) for c in np.array(p) + s)
                tube[q] = min(tube.get(q, 99), int((s**2).sum()))
        tube = {q: d for q, d in tube.items() if not d < inner**2}
        for p in line:
            near = [np.array(s) - 1 for s in np.ndindex(3, 3, 3) if s != (1, 1, 1) and tuple(int(c) for c in np.array(p) + s - 1) in line]
            if len(near) == 2 and ((near[0] - near[1]) ** 2).sum() < 2:
                near = [min(near, key=lambda s: (s**2).sum())]
            if len(near) == 1:
                for s in ball:
                    if ((s + near[0]) ** 2).sum() <= (s**2).sum():
                        tube.pop(tuple(int(c) for c in np.array(p) + s), None)
        for q, d in tube.items():
            if all(0 <= c < n for c, n in zip(q, dim)):
                best[q] = min(best.get(q, (99, 0)), (d, int(own)))
    out = np.zeros(dim, int)
    for q, (_, own) in best.items():
        out[q] = own
    return out


def test_tubes_are_open_at_their_ends(spark):
    """A bent line with a stair at one end, a straight one that meets its tube and ends at the volume's edge, and a lone voxel."""
    a = np.zeros((12, 12, 12), int)
    for p in [(2, 2, 2), (3, 2, 2), (4, 2, 3), (5, 3, 4), (6, 4, 4), (6, 5, 4), (6, 6, 4), (7, 6, 4)]:
        a[p] = 5
    a[9, 3:12, 5] = 3
    a[1, 9, 9] = 7
    for outer_nm, inner_nm in ((12.5, 6.0), (8.0, 4.0)):
        got = dense(distance.trimmed_tubes(sparse(spark, a), SMALL, outer_nm, inner_nm)).astype(int)
        assert np.array_equal(got, tubes_by_force(a, outer_nm / 4, inner_nm / 4)) and len(np.unique(got)) == 4
    straight = np.zeros((12, 12, 12), int)
    straight[6, 3:9, 6] = 1
    tube = dense(distance.trimmed_tubes(sparse(spark, straight), SMALL))
    assert np.array_equal(np.unique(np.nonzero(tube)[1]), np.arange(3, 9))  # nothing beyond the ends


def test_workflow_options(spark, noise):
    values = noise * np.random.default_rng(2).integers(1, 200, noise.shape)
    mask = (np.random.default_rng(5).random((6, 6, 6)) < 0.6).astype(int)
    smooth = np.floor(curvature.smooth(values.astype(float), 1.5) + 0.5)
    wide = mask.repeat(2, 0).repeat(2, 1).repeat(2, 2)
    want = (smooth * wide >= 40).astype(int)
    got = dense(cc.segment(sparse(spark, values), SMALL, 40, 2 * 64.0, smooth_nm=6.0, mask=sparse(spark, mask)))
    label = flood(want, False)
    size = np.bincount(label.ravel())
    assert want.sum() > 40 and np.array_equal(got > 0, (label > 0) & (size[label] > 2))
    box = spark.createDataFrame([tuple(map(int, p)) for p in np.ndindex(12, 12, 12)], "x long, y long, z long")
    holes = dense(cc.segment(sparse(spark, values), SMALL, 40, 0.0, inside=box))
    assert np.array_equal(holes > 0, values == 0)
    grown = dense(distance.expand(sparse(spark, noise * 3), SMALL, 8.0, prediction=sparse(spark, values), at_least=100))
    assert np.array_equal(grown > 0, values >= 100)


def test_sheetness_tables(spark):
    r = np.random.default_rng(7)
    site, bins, organelle = r.integers(-2, 4, (12, 12, 12)).clip(0), r.integers(-1, 6, (12, 12, 12)).clip(0), r.integers(-3, 3, (12, 12, 12)).clip(0)
    found = {(q.kind, q.id): (q.sheetness, q.area) for q in objects.contact_sheetness_tables(sparse(spark, site).withColumnRenamed("v", "component"), sparse(spark, bins), sparse(spark, organelle), SMALL).collect()}
    want, both = {}, (site > 0) & (bins > 0)
    for kind, volume in (("organelle", organelle), ("site", site)):
        for i in np.unique(volume[both]):
            want[kind, int(i)] = ((bins[both & (volume == i)].mean() - 1) / 255 + 0.5 / 255, None)
    padded = np.pad(bins, 1, constant_values=99)
    faces = sum(np.roll(padded, s, k)[1:-1, 1:-1, 1:-1] == 0 for k in range(3) for s in (-1, 1))
    for i in np.unique(bins[both]):
        if faces[both & (bins == i)].sum():
            want["bin", int(i)] = ((i - 1) / 255 + 0.5 / 255, faces[both & (bins == i)].sum() * 16.0)
    assert set(found) == set(want)
    for k, (sheetness, area) in want.items():
        assert found[k][0] == pytest.approx(sheetness) and found[k][1] == (None if area is None else pytest.approx(area))


@pytest.mark.parametrize("most", [49, 200, 3000])
def test_reach_by_force(spark, most):
    """Over blocks of five: what bounds settle is right, and some blocks are settled either way."""
    a = np.zeros((31, 23, 18), int)
    for p in [(2, 3, 4), (3, 3, 4), (27, 20, 17), (14, 0, 9)]:
        a[p] = 1
    grid = volume.Grid(a.shape, (5, 5, 5))
    at = np.argwhere(a)
    d2 = ((np.indices(a.shape)[:, None] - at.T[:, :, None, None, None]) ** 2).sum(0).min(0)
    rows = distance.reach(sparse(spark, a), grid, most).collect()
    got = np.zeros(a.shape, bool)
    got[tuple(np.array([(r.x, r.y, r.z) for r in rows]).T)] = True
    assert np.array_equal(got, d2 <= most) and len(rows) == got.sum()
    _, blocks = distance.reached_blocks(sparse(spark, a), grid, most)
    full = {(r.bx, r.by, r.bz): r.full for r in blocks.collect()}
    assert any(full.values()) if most > 100 else not all(full.values())
    for b in np.ndindex(7, 5, 4):
        part = d2[tuple(slice(5 * k, 5 * k + 5) for k in b)]
        assert part.min() > most if b not in full else (part.max() <= most if full[b] else True)
    assert distance.reach(sparse(spark, a).where("false"), grid, most).count() == 0
