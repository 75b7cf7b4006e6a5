"""The voxels format: what a box opens, and what it doesn't."""

import json

import numpy as np
import pytest

from stratavox.operators.volume import Grid
from stratavox.sources import chunks, datasets, voxels

from .test_volumes import SMALL, dense, sparse


@pytest.fixture(scope="module")
def noise():
    return (np.random.default_rng(3).random((12, 12, 12)) < 0.3).astype(int)


def spoil(root, keep):
    """Files whose path doesn't pass are no chunks any more."""
    n = 0
    for f in root.rglob("*"):
        if f.is_file() and f.name[0].isdigit() and not keep(f.relative_to(root)):
            f.write_bytes(b"spoilt")
            n += 1
    return n


def test_a_box_opens_its_chunks_only(spark, noise, tmp_path):
    chunks.write_n5(sparse(spark, noise * 7), SMALL, str(tmp_path / "a.n5"), "vol", "uint16")
    read = lambda box=None: voxels.read(spark, str(tmp_path / "a.n5"), "vol", box=box)
    whole, grid = read()
    assert grid == SMALL and np.array_equal(dense(whole), noise * 7)
    assert whole.where("x > 9").count() == np.count_nonzero(noise[10:]) and whole.count() == np.count_nonzero(noise)
    # x in the second chunk, y in the second and third, z in the first
    assert spoil(tmp_path / "a.n5" / "vol", lambda p: p.parts[0] == "1" and p.parts[1] in "12" and p.parts[2] == "0") == 25
    want = np.zeros_like(noise)
    want[6:9, 5:12, 1:4] = noise[6:9, 5:12, 1:4] * 7
    assert np.array_equal(dense(read(((6, 5, 1), (3, 7, 3)))[0]), want)
    assert read(((6, 5, -4), (1, 90, 6)))[0].count() == np.count_nonzero(noise[6, 5:, :2])
    assert read(((40, 0, 0), (5, 5, 5)))[0].count() == 0
    assert voxels.existing_chunks(spark, str(tmp_path / "a.n5"), "vol", box=((6, 5, 1), (3, 7, 3))).count() == 2
    with pytest.raises(Exception, match="buffer"):
        whole.count()


@pytest.mark.parametrize("sep", [".", "/"])
def test_zarr_boxes(spark, noise, tmp_path, sep):
    root = tmp_path / "a.zarr" / "vol"
    root.mkdir(parents=True)
    (root / ".zarray").write_text(json.dumps({"shape": [12, 12, 12], "chunks": [5, 4, 6], "dtype": "<f4", "compressor": None, "fill_value": 0, "order": "C", "filters": None, "dimension_separator": sep}))
    zyx = np.pad(noise.transpose(2, 1, 0), ((0, 3), (0, 0), (0, 0))) / 2
    for b in np.ndindex(3, 3, 2):
        f = root / sep.join(map(str, b))
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(zyx[tuple(slice(n * k, n * k + n) for n, k in zip((5, 4, 6), b))].astype("<f4").tobytes())
    df, grid = voxels.read(spark, str(tmp_path / "a.zarr"), "vol", "zarr")
    assert grid == Grid((12, 12, 12), (6, 4, 5)) and np.array_equal(dense(df), noise / 2)
    spoil(root, lambda p: str(p).split(sep) == ["2", "0", "1"])
    want = np.zeros((12, 12, 12))
    want[6:, :4, 10:] = noise[6:, :4, 10:] / 2
    assert np.array_equal(dense(voxels.read(spark, str(tmp_path / "a.zarr"), "vol", "zarr", ((6, 0, 10), (6, 4, 2)))[0]), want)


def test_chunk_files_are_the_block_plan(spark, noise, tmp_path):
    a = noise.copy()
    a[:5] = 0
    chunks.write_n5(sparse(spark, a), SMALL, str(tmp_path / "a.n5"), "vol", "uint8")
    spoil(tmp_path / "a.n5" / "vol", lambda p: False)
    rows = {tuple(r) for r in voxels.existing_chunks(spark, str(tmp_path / "a.n5"), "vol").collect()}
    want = {(*(int(k) for k in b), *(int(5 * k) for k in b), *(min(5, 12 - 5 * int(k)) for k in b)) for b in np.ndindex(3, 3, 3) if a[tuple(slice(5 * k, 5 * k + 5) for k in b)].any()}
    assert rows == want and len(want) == 18
    with pytest.raises(ValueError, match="layout"):
        voxels.layout(str(tmp_path / "a.n5" / "vol"), "hdf5")


def test_store_windows(spark, noise, tmp_path):
    store = datasets.Store(spark, str(tmp_path / "s"))
    store.create("a", SMALL, "uint8")
    store.write("a", sparse(spark, noise))
    want = np.zeros_like(noise)
    want[4:6, :12, 9:11] = noise[4:6, :12, 9:11]
    assert np.array_equal(dense(store.window("a", (4, 0, 9), (2, 12, 2))), want)
    met = chunks.stored_chunks(spark, f"{store.path}/chunks", "a", SMALL, (4, 0, 9), (2, 12, 2)).select("gx", "gy", "gz")
    assert {tuple(r) for r in met.collect()} == {(x, y, z) for x in (0, 1) for y in (0, 1, 2) for z in (1, 2)}
    plan = store.blocks("a", 2).collect()
    assert len(plan) == 27 and {(r.ox, r.dx) for r in plan if r.bx == 2} == {(8, 6)}
