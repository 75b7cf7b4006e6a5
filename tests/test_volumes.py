"""Operators against small volumes with known answers, and numpy kernels against brute force."""

import gzip
import json

import numpy as np
import pytest

from stratavox.operators import components as cc
from stratavox.operators import curvature, distance, objects, pointwise, renumber, skeletons, stencils, thinning, volume
from stratavox.operators.volume import XYZ, Grid
from stratavox.sources import chunks, datasets

from . import small_graphs

SMALL = Grid((12, 12, 12), (5, 5, 5))


def sparse(spark, dense):
    at = np.argwhere(dense)
    return spark.createDataFrame([(*map(int, p), int(dense[tuple(p)])) for p in at], "x long, y long, z long, v long")


def dense(df, shape=(12, 12, 12), value="v"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.x, r.y, r.z] = r[value]
    return out


@pytest.fixture(scope="module")
def noise():
    return (np.random.default_rng(3).random((12, 12, 12)) < 0.3).astype(int)


def flood(a, around):
    label, n = np.zeros(a.shape, int), 0
    for p in np.argwhere(a):
        if label[tuple(p)]:
            continue
        n += 1
        edge = [tuple(p)]
        label[tuple(p)] = n
        while edge:
            q = edge.pop()
            for d in np.ndindex(3, 3, 3):
                d = np.array(d) - 1
                if 0 < (abs(d).sum() if not around else 1) <= 1 and d.any():
                    r = tuple(q + d)
                    if all(0 <= c < s for c, s in zip(r, a.shape)) and a[r] and not label[r]:
                        label[r] = n
                        edge.append(r)
    return label


@pytest.mark.parametrize("around", [False, True])
def test_components_equal_flood_fill(spark, noise, around):
    got = dense(cc.components(sparse(spark, noise), SMALL, around), value="component")
    want = flood(noise, around)
    pairs = {(a, b) for a, b in zip(got.ravel(), want.ravel())}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_known_object_table(spark):
    """A sphere and a slab of a 150-voxel fixture, with values worked out by hand."""
    grid = Grid((150, 150, 150), (64, 64, 64))
    i = np.arange(145, 148)
    slab = np.zeros((20, 20, 150), int)
    slab[2:18, 2:18, i] = 255
    info = objects.object_info(cc.segment(sparse(spark, slab), grid, 127, 64.0), grid).collect()
    assert len(info) == 1
    row = info[0]
    assert row.volume == 16 * 16 * 3 * 64 and row.area == (2 * 256 + 4 * 48) * 16
    assert (row.min_x, row.max_x, row.min_z, row.max_z) == (8.0, 68.0, 580.0, 588.0)
    assert row.com_z == pytest.approx(4 * 146)


def test_empty_volume(spark):
    empty = spark.createDataFrame([], "x long, y long, z long, v long")
    assert cc.segment(empty, SMALL, 1).count() == 0
    assert objects.object_info(empty, SMALL).count() == 0
    assert distance.expand(empty, SMALL, 8.0).count() == 0
    assert thinning.thin(empty, SMALL).count() == 0


def test_edt_kernel_and_depth(spark, noise):
    inside = noise == 0
    at = np.argwhere(~inside)
    want = np.array([((at - p) ** 2).sum(1).min() for p in np.ndindex(inside.shape)]).reshape(inside.shape)
    assert np.array_equal(distance.edt_kernel(inside), want)
    got = dense(distance.edt_bounded(sparse(spark, noise), SMALL, 4), value="d2")
    assert np.array_equal(got, np.where(want <= 4, want, 0))


def test_depth_is_exact_at_any_depth(spark):
    """A full cube over many blocks, deeper than half a block; anisotropic voxels; and no background at all."""
    grid = Grid((40, 40, 40), (5, 5, 5))
    cube = sparse(spark, np.ones((40, 40, 40), int))
    got = dense(distance.depth(cube, grid), (40, 40, 40), "d2")
    i = np.arange(40)
    edge = np.minimum(i + 1, 40 - i)
    assert np.array_equal(got, np.minimum(np.minimum(edge[:, None, None], edge[:, None]), edge) ** 2) and got.max() == 400
    a = (np.random.default_rng(8).random((12, 12, 12)) < 0.95).astype(int)
    weights = (1.0, 2.0, 3.0)
    hole = np.argwhere(a == 0)
    want = np.array([(((hole - p) * weights) ** 2).sum(1).min() for p in np.ndindex(a.shape)]).reshape(a.shape) * a
    assert np.allclose(dense(distance.depth(sparse(spark, a), SMALL, weights, False), value="d2"), want)
    assert distance.depth(sparse(spark, np.ones((12, 12, 12), int)), SMALL, beyond_is_background=False).where("d2 < 1e300").count() == 0


@pytest.mark.parametrize("most", [4, 30, 400])
def test_nearest_labels_by_force(spark, most):
    """In blocks and over lines, with ties, and the second label."""
    a = np.random.default_rng(5).integers(-60, 5, (12, 12, 12)).clip(0)
    at = np.argwhere(a)
    v = a[tuple(at.T)]
    one = {(r.x, r.y, r.z): (r.v, r.d2) for r in distance.nearest_labels(sparse(spark, a), SMALL, most).collect()}
    two = {(r.x, r.y, r.z): (r.v, r.d2, r.v2, r.d22) for r in distance.nearest_labels(sparse(spark, a), SMALL, most, second=True).collect()}
    for p in np.ndindex(a.shape):
        best = sorted((int(((at[v == k] - p) ** 2).sum(1).min()), int(k)) for k in np.unique(v))
        near = [(k, d) for d, k in best if d <= most]
        assert one.get(p) == (near[0] if near else None)
        assert (two[p][:2] if p in two else None) == (near[0] if near else None)
        if p in two:
            assert two[p][2:] == (near[1] if len(near) > 1 else (0, most + 1))


def test_expansion_beyond_blocks(spark):
    """A radius of 40 over blocks of 5."""
    a = np.zeros((60, 12, 12), int)
    a[2, 3, 4], a[58, 1, 1] = 3, 9
    got = dense(distance.expand(sparse(spark, a), Grid((60, 12, 12), (5, 5, 5)), 160.0), (60, 12, 12))
    at = np.stack(np.indices(a.shape), -1)
    d = [((at - p) ** 2).sum(-1) for p in ((2, 3, 4), (58, 1, 1))]
    assert np.array_equal(got, np.where(np.minimum(*d) > 1600, 0, np.where(d[0] <= d[1], 3, 9)))


def test_geodesic_by_force(spark, noise):
    import heapq

    mask = 1 - noise
    seeds = np.zeros_like(mask)
    seeds[0, 0, :2], seeds[11, 5, 5] = 1, 1
    got = {(r.x, r.y, r.z): r.d for r in distance.geodesic(sparse(spark, seeds), sparse(spark, mask), SMALL).collect()}
    want, heap = {}, [(0, *map(int, p)) for p in np.argwhere(seeds & mask)]
    while heap:
        d, *p = heapq.heappop(heap)
        if tuple(p) in want:
            continue
        want[tuple(p)] = d
        for q in np.ndindex(3, 3, 3):
            q = np.array(q) - 1
            r = tuple(int(c) for c in np.array(p) + q)
            if q.any() and all(0 <= c < 12 for c in r) and mask[r] and r not in want:
                heapq.heappush(heap, (d + 2 + int((q**2).sum()), *r))
    assert got == want
    near = {(r.x, r.y, r.z): r.d for r in distance.geodesic(sparse(spark, seeds), sparse(spark, mask), SMALL, 9).collect()}
    assert near == {p: d for p, d in want.items() if d <= 9}


def test_nearest_medial_voxels_by_force(spark, noise):
    """The mean over the medial voxels that are nearest by chamfer steps within the objects; no object but the whole volume here."""
    mask = np.ones_like(noise) * 2
    rows = [(1, 2, 3, 0.2), (9, 2, 3, 0.8), (5, 10, 6, 0.5)]
    medial = spark.createDataFrame(rows, "x long, y long, z long, value double")
    got = {(r.x, r.y, r.z): r.value for r in objects.nearest_medial(sparse(spark, mask), medial, SMALL).collect()}

    def chamfer(p, q):
        c = sorted(abs(a - b) for a, b in zip(p, q))
        return 5 * c[0] + 4 * (c[1] - c[0]) + 3 * (c[2] - c[1])

    for p in np.ndindex(12, 12, 12):
        d = [chamfer(p, r[:3]) for r in rows]
        assert got[p] == pytest.approx(np.mean([r[3] for r, own in zip(rows, d) if own == min(d)]))


def test_sphereness_by_force(spark, noise):
    centres = np.zeros_like(noise)
    centres[5, 5, 5], centres[0, 3, 11] = 1, 4
    noisy = noise | (np.random.default_rng(1).random(noise.shape) < 0.5)
    got = {(r.x, r.y, r.z): r for r in stencils.sphereness(sparse(spark, noisy * 200), sparse(spark, centres), SMALL, 3).collect()}
    for p in np.argwhere(centres):
        seen = []
        total = 0
        for q in np.ndindex(7, 7, 7):
            q = np.array(q) - 3
            if (q**2).sum() <= 9:
                total += 1
                line = [p + s for s in cc.line_voxels(*map(int, q))]
                if all((c >= 0).all() and (c < 12).all() and noisy[tuple(c)] for c in line):
                    seen.append(q)
        r = got[tuple(map(int, p))]
        off = np.linalg.norm(np.mean(seen, 0)) if seen else 3
        assert r.fraction == pytest.approx(len(seen) / total) and r.offset == pytest.approx(off) and r.score == pytest.approx(len(seen) / total + 1 - off / 3)


def test_sight_by_force(spark):
    r = np.random.default_rng(9)
    a, b = ((r.random((12, 12, 12)) < 0.04).astype(int) * k for k in (1, 2))
    b[a > 0] = 0
    most, want = 9, set()
    for p in np.argwhere(a):
        for q in np.argwhere(b):
            line = [tuple(int(c) for c in p + s) for s in cc.line_voxels(*map(int, q - p))]
            if ((p - q) ** 2).sum() <= most and not any(a[c] or b[c] for c in line[1:-1]):
                want |= set(line)
    assert {(x.x, x.y, x.z) for x in cc.contacts_sight(sparse(spark, a), sparse(spark, b), SMALL, 8.0).collect()} == want
    both = cc.contact_sites({"a": sparse(spark, a), "b": sparse(spark, b)}, SMALL, 8.0, self_pairs=True)
    assert {x.contact for x in both.select("contact").distinct().collect()} <= {"a_to_a", "a_to_b", "b_to_b"}
    assert {(x.x, x.y, x.z) for x in both.where("contact = 'a_to_b'").collect()} == want


def test_geodesic_goes_around_walls(spark):
    mask = np.ones((7, 7, 1), int)
    mask[3, :6] = 0
    grid_df = sparse(spark, mask)
    d = {(r.x, r.y): r.d for r in distance.geodesic(grid_df.where("x = 0 and y = 0"), grid_df, SMALL).collect()}
    assert d[(0, 3)] == 9 and d[(2, 2)] == 8 and d[(6, 0)] > 18 and (3, 0) not in d


def test_fill_holes_leaves_edge_cavities(spark):
    a = np.zeros((12, 12, 12), int)
    a[2:9, 2:9, 2:9] = 4
    a[5, 5, 5] = 0
    a[2, 4, 4] = 0  # open to the outside
    grid_box = sparse(spark, np.ones((12, 12, 12), int)).select(*XYZ)
    filled = dense(cc.fill_holes(sparse(spark, a), grid_box, SMALL))
    assert filled[5, 5, 5] == 4 and filled[2, 4, 4] == 0 and filled.sum() == a.sum() + 4


def test_chunks_round_trip(spark, noise, tmp_path):
    chunks.write_volume(sparse(spark, noise), SMALL, str(tmp_path / "store"), "noise", "uint8")
    assert np.array_equal(dense(chunks.read_volume(spark, str(tmp_path / "store"), "noise")), noise)


def test_reads_n5_and_zarr(spark, noise, tmp_path):
    root = tmp_path / "a.n5" / "vol"
    root.mkdir(parents=True)
    (root / "attributes.json").write_text(json.dumps({"dimensions": [12, 12, 12], "blockSize": [5, 5, 5], "dataType": "uint16", "compression": {"type": "gzip"}, "pixelResolution": {"dimensions": [8, 8, 8], "unit": "nm"}}))
    for b in np.ndindex(3, 3, 3):
        part = noise[tuple(slice(5 * k, 5 * k + 5) for k in b)]
        head = np.array([0, 3], ">u2").tobytes() + np.array(part.shape, ">u4").tobytes()
        at = root / str(b[0]) / str(b[1])
        at.mkdir(parents=True, exist_ok=True)
        (at / str(b[2])).write_bytes(head + gzip.compress(part.transpose(2, 1, 0).astype(">u2").tobytes()))
    got, grid = chunks.read_n5(spark, str(tmp_path / "a.n5"), "vol")
    assert np.array_equal(dense(got), noise) and grid.resolution == (8.0, 8.0, 8.0)
    root = tmp_path / "a.zarr" / "vol"
    root.mkdir(parents=True)
    (root / ".zarray").write_text(json.dumps({"shape": [12, 12, 12], "chunks": [5, 5, 5], "dtype": "<u2", "compressor": None, "fill_value": 0, "order": "C", "filters": None, "zarr_format": 2}))
    zyx = np.pad(noise.transpose(2, 1, 0), (0, 3))
    for b in np.ndindex(3, 3, 3):
        (root / ".".join(map(str, b))).write_bytes(zyx[tuple(slice(5 * k, 5 * k + 5) for k in b)].astype("<u2").tobytes())
    got, _ = chunks.read_zarr(spark, str(tmp_path / "a.zarr"), "vol")
    assert np.array_equal(dense(got), noise)


def test_typed_values_and_codecs(spark, tmp_path):
    """Floats stay floats, values that don't fit and codecs without a reader raise errors."""
    rows = spark.createDataFrame([(0, 0, 0, 0.5), (11, 3, 4, 2.25)], "x long, y long, z long, v double")
    chunks.write_volume(rows, SMALL, str(tmp_path / "s"), "f", "float32")
    assert sorted(r.v for r in chunks.read_volume(spark, str(tmp_path / "s"), "f").collect()) == [0.5, 2.25]
    root = tmp_path / "z" / "v"
    root.mkdir(parents=True)
    about = {"shape": [2, 2, 2], "chunks": [2, 2, 2], "dtype": "<u8", "compressor": {"id": "blosc"}, "fill_value": 0, "order": "C", "filters": None}
    (root / ".zarray").write_text(json.dumps(about))
    (root / "0.0.0").write_bytes(np.full(8, 2**64 - 1, "<u8").tobytes())
    with pytest.raises(Exception, match="blosc"):
        chunks.read_zarr(spark, str(tmp_path / "z"), "v")[0].collect()
    (root / ".zarray").write_text(json.dumps(about | {"compressor": None}))
    with pytest.raises(Exception, match="fit a long"):
        chunks.read_zarr(spark, str(tmp_path / "z"), "v")[0].collect()


def test_writes_n5(spark, noise, tmp_path):
    for values, kind in ((noise * 7, "uint16"), (noise * 3, "uint8")):  # the second replaces the first
        chunks.write_n5(sparse(spark, values), SMALL, str(tmp_path / "out.n5"), "vol", kind)
        got, grid = chunks.read_n5(spark, str(tmp_path / "out.n5"), "vol")
        assert np.array_equal(dense(got), values) and grid == SMALL
    real = sparse(spark, noise).withColumn("v", __import__("pyspark").sql.functions.col("v") / 4)
    chunks.write_n5(real, SMALL, str(tmp_path / "out.n5"), "real", "float32")
    assert np.array_equal(dense(chunks.read_n5(spark, str(tmp_path / "out.n5"), "real")[0]), noise / 4)


def test_dataset_catalogue(spark, noise, tmp_path):
    store = datasets.Store(spark, str(tmp_path / "store"))
    assert store.names() == []
    store.create("a", Grid((12, 12, 12), (5, 5, 5), (8.0, 8.0, 8.0)), "uint8")
    grid, kind = store.create("b", like="a", dtype="float32", block=(6, 6, 6))
    assert store.names() == ["a", "b"] and grid == Grid((12, 12, 12), (6, 6, 6), (8.0, 8.0, 8.0)) and kind == "float32" and store.describe("b") == (grid, kind)
    store.write("b", sparse(spark, noise).selectExpr("x", "y", "z", "v * 2.5D as v"))
    store.copy("b", "c")
    assert np.array_equal(dense(store.read("b")), noise * 2.5) and np.array_equal(dense(store.read("c")), noise * 2) and store.describe("c")[1] == "uint64"
    with pytest.raises(KeyError):
        store.describe("d")


def test_csv_tables(spark, tmp_path):
    chunks.write_table(spark.createDataFrame([(1, 2.5)], "id long, area double"), str(tmp_path / "t"))
    assert chunks.read_table(spark, str(tmp_path / "t"), "a long, b double").collect() == [(1, 2.5)]
    assert chunks.parse_numbers("1,2, 3") == [1, 2, 3]


def test_unknown_id_raises(spark, noise):
    with pytest.raises(Exception, match="no number for object"):
        renumber.apply_numbers(sparse(spark, noise), spark.createDataFrame([(9, 1)], "v long, number long")).collect()


def test_thinning_keeps_topology(spark):
    a = np.zeros((12, 12, 12), int)
    a[1:11, 1:11, 4:8] = 1
    a[4:8, 4:8, :] = 0  # a ring
    line = dense(thinning.thin(sparse(spark, a), SMALL))
    assert 0 < line.sum() < 60 and flood(line, True).max() == 1
    solid = np.zeros((12, 12, 12), int)
    solid[1:11, 1:11, 4:8] = 1
    sheet = dense(thinning.thin(sparse(spark, solid), SMALL, surface=True))
    assert line.sum() < sheet.sum() < solid.sum() / 2
    background = np.pad(1 - line.astype(int), 1, constant_values=1)
    assert flood(background, False).max() == 1


def test_thinning_pass_is_the_same_in_blocks(spark):
    a = np.zeros((12, 12, 12), int)
    a[2:10, 2:9, 1:11] = 1
    whole, parts = Grid((12, 12, 12), (12, 12, 12)), SMALL
    assert np.array_equal(dense(thinning.thin(sparse(spark, a), whole)), dense(thinning.thin(sparse(spark, a), parts)))


def test_curvature_tells_sheets_from_balls(spark):
    at = np.stack(np.meshgrid(*[np.arange(24)] * 3, indexing="ij"), -1) - 11.5
    grid = Grid((24, 24, 24), (24, 24, 24))
    ball = ((at**2).sum(-1) < 64).astype(int)
    plate = (abs(at[..., 0]) < 1.6).astype(int)
    most = lambda a, m: dense(curvature.planarity(sparse(spark, a), grid, 5, m), (24, 24, 24))[12, 12, 12]
    assert most(plate, "planarity") > 5 * most(ball, "planarity")
    assert most(ball, "sphereness") > most(plate, "sphereness")
    mean = dense(curvature.surface_curvature(sparse(spark, ball), grid), (24, 24, 24))
    assert np.median(mean[mean != 0]) == pytest.approx(1 / 8, rel=0.35)


def all_pairs(n, u, v, w):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, c in zip(u, v, w):
        d[a, b] = d[b, a] = min(d[a, b], c)
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    return d


def test_pruning_and_longest_path():
    """A path 0..10 with a branch 8-11-12-13-14: node 8 is the branch point; a least length of 3 removes 9 and 10."""
    edges = [(k, k + 1) for k in range(10)] + [(8, 11), (11, 12), (12, 13), (13, 14)]
    u, v = (np.array(x) for x in zip(*edges))
    nodes, u, v, w = small_graphs.prune(np.arange(15), u, v, np.ones(len(u)), 3)
    assert set(range(15)) - set(nodes.tolist()) == {9, 10}
    graph = small_graphs.Graph(nodes, u, v, w)
    a, b, length = graph.longest()
    assert length == 12 and graph.nodes[small_graphs.path(graph.distances([b])[1], a)].tolist() == [14, 13, 12, 11, 8, 7, 6, 5, 4, 3, 2, 1, 0]


def test_longest_path_equals_all_pairs():
    r = np.random.default_rng(4)
    for _ in range(150):
        n = int(r.integers(2, 14))
        pairs = {(int(r.integers(k)), k) for k in range(1, n) if r.random() < 0.9} | {tuple(sorted(map(int, p))) for p in r.integers(0, n, (int(r.integers(0, 5)), 2)) if p[0] != p[1]}
        if pairs:
            u, v = (np.array(x) for x in zip(*sorted(pairs)))
            w = r.choice([1.0, 2**0.5, 3**0.5], len(u))
            low = np.tril(np.nan_to_num(all_pairs(n, u, v, w), posinf=-1))
            start, end, length = small_graphs.Graph(np.arange(n), u, v, w).longest()
            assert length == pytest.approx(low.max()) and [start, end] == np.argwhere(low >= low.max() - 1e-9)[0].tolist()


def test_length_and_thickness(spark):
    """Two objects, one of a single node, and painting of what is left."""
    vertices = [(1, k, 2.0 + k % 2) for k in range(1, 16)] + [(2, 50, 1.0)]
    edges = [(1, k, k + 1, 1.0) for k in range(1, 11)] + [(1, 9, 12, 1.0), (1, 12, 13, 1.0), (1, 13, 14, 1.0), (1, 14, 15, 1.0)]
    got = skeletons.length_and_thickness(spark.createDataFrame(vertices, "obj long, node long, radius double"), spark.createDataFrame(edges, "obj long, u long, v long, w double"), 4.0, 3.0)
    rows = {r.obj: r for r in got.collect()}
    assert rows[1].length_nm == 48.0 and rows[1].path[0] == 15 and rows[1].path[-1] == 1 and set(range(1, 16)) - set(rows[1].pruned) == {10, 11}
    assert rows[2].length_nm == 0 and rows[2].path == [50] and rows[2].radius_mean_nm == 4.0
    assert skeletons.paint(got, SMALL).count() == 14 and skeletons.paint(got, SMALL, "pruned").count() == 14


def test_lines_and_sight(spark):
    assert cc.line_voxels(3, 3, 3) == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, 3)]
    a, b = np.zeros((12, 12, 12), int), np.zeros((12, 12, 12), int)
    a[2, 3:6, 3:6], b[5, 3:6, 3:6] = 1, 2
    seen = cc.contacts_sight(sparse(spark, a), sparse(spark, b), SMALL, 8.0)
    assert {r.x for r in seen.collect()} == {2, 3, 4, 5} and seen.select("component").distinct().count() == 1
    wall = a.copy()
    wall[3, :, :] = 7
    blocked = cc.contacts_sight(sparse(spark, wall), sparse(spark, b), SMALL, 8.0).where("a = 1")
    assert blocked.count() == 0


def test_internal_gradient_and_compare(spark):
    a = np.zeros((12, 12, 12), int)
    a[1:11, 1:11, 1:11] = 3
    shell = dense(stencils.internal_gradient(sparse(spark, a), SMALL, 2))
    assert shell[1, 5, 5] == 3 and shell[2, 5, 5] == 3 and shell[3, 5, 5] == 0
    assert pointwise.compare(sparse(spark, a), sparse(spark, a * 2), nonzero_only=True).first().equal
    assert not pointwise.compare(sparse(spark, a), sparse(spark, a * 2)).first().equal


def test_blocks_cover_the_grid(spark):
    rows = volume.blocks(spark, SMALL).collect()
    assert len(rows) == 27 and sum(r.dx * r.dy * r.dz for r in rows) == 12**3


def test_nonoverlapping_equals_sequential_greedy(spark, noise):
    k, separation = 3, 3
    order = sorted(map(tuple, np.argwhere(noise).tolist()), key=lambda p: (p[0] % k + p[1] % k * k + p[2] % k * k * k, p[0] + 12 * p[1] + 144 * p[2]))
    chosen = []
    for p in order:
        if all(sum((a - b) ** 2 for a, b in zip(p, q)) > separation**2 for q in chosen):
            chosen.append(p)
    got = stencils.nonoverlapping(sparse(spark, noise), SMALL, 2.0, separation)
    assert sorted((r.x, r.y, r.z) for r in got.collect()) == sorted(chosen)


def test_workflows(spark, noise):
    """Cell volume, filling with a size filter, and light-microscopy contacts, against the same steps done plainly."""
    r = np.random.default_rng(6)
    membrane, outside, mask = ((r.random((12, 12, 12)) < p).astype(int) for p in (0.2, 0.01, 0.9))
    every = sparse(spark, np.ones((12, 12, 12), int)).select(*XYZ)
    got = dense(cc.cell_volume(every, sparse(spark, membrane), sparse(spark, outside), sparse(spark, mask), SMALL, 2.0, 64.0))
    at = np.argwhere(outside)
    far = np.array([((at - p) ** 2).sum(1).min() > 4 for p in np.ndindex(outside.shape)]).reshape(outside.shape)
    label = flood(((membrane == 0) & (mask > 0) & far).astype(int), False)
    size = np.bincount(label.ravel())
    want = np.where((label > 0) & (size[label] > 1), label, 0)
    assert ((got > 0) == (want > 0)).all() and len(set(zip(got.ravel(), want.ravel()))) == len(set(want.ravel()))
    a = np.zeros((12, 12, 12), int)
    a[1:6, 1:6, 1:6], a[8:10, 8:10, 8:10] = 4, 9
    a[3, 3, 3] = 0
    kept = dense(cc.fill_and_filter(sparse(spark, a), every, SMALL, 50 * 64.0))
    assert kept[3, 3, 3] == 1 and (kept > 0).sum() == 125 and kept.max() == 1
    red, green = np.zeros((12, 12, 12)), np.zeros((12, 12, 12))
    red[2:4, 2:9, 2], green[4:6, 2:9, 2] = 0.9, 0.8
    rows = lambda f: spark.createDataFrame([(*map(int, p), float(f[tuple(p)])) for p in np.argwhere(f)], "x long, y long, z long, v double")
    met = cc.light_contacts({"red": rows(red), "green": rows(green)}, SMALL, {"red": 0.5, "green": 0.5})
    assert {x.contact for x in met.collect()} == {"red_to_green"} and met.select("component").distinct().count() == 1
