"""Dense chunk rows and array containers.

A chunk row (dataset, gx, gy, gz, ox, oy, oz, dx, dy, dz, dtype, data) holds a block's bytes, little-endian, x fastest. Containers of
the n5 and zarr (version 2) layouts are read with Spark's binary file source, so any store that Spark can open will do; the chunk's place comes
from its path.
"""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.operators.volume import XYZ, Grid

SCHEMA = "dataset string, gx int, gy int, gz int, ox long, oy long, oz long, dx int, dy int, dz int, dtype string, data binary"


def to_chunks(volume: DataFrame, grid: Grid, dataset: str, dtype: str = "uint64") -> DataFrame:
    """A chunk row for each block with a voxel."""
    block, dim = grid.block, grid.dim

    def run(t: pa.Table) -> pa.Table:
        col = lambda c: np.asarray(t.column(c).combine_chunks())
        at = [int(col(f"b{c}")[0]) for c in XYZ]
        corner = [a * b for a, b in zip(at, block, strict=True)]
        size = [min(b, d - o) for b, d, o in zip(block, dim, corner, strict=True)]
        dense = np.zeros(size[::-1], dtype=np.dtype(dtype).newbyteorder("<"))
        dense[tuple(col(c) - o for c, o in zip(XYZ[::-1], corner[::-1], strict=True))] = col("v")
        row = {"dataset": [dataset], **{f"g{c}": [a] for c, a in zip(XYZ, at, strict=True)}, **{f"o{c}": [o] for c, o in zip(XYZ, corner, strict=True)}, **{f"d{c}": [s] for c, s in zip(XYZ, size, strict=True)}, "dtype": [dtype], "data": [dense.tobytes()]}
        return pa.Table.from_pydict(row).cast(pa.schema([("dataset", pa.string()), *((f"g{c}", pa.int32()) for c in XYZ), *((f"o{c}", pa.int64()) for c in XYZ), *((f"d{c}", pa.int32()) for c in XYZ), ("dtype", pa.string()), ("data", pa.binary())]))

    return volume.select(*XYZ, "v", *grid.block_key()).groupBy("bx", "by", "bz").applyInArrow(run, SCHEMA)


def _voxel_schema(dtype: np.dtype) -> str:
    return "x long, y long, z long, v " + ("double" if dtype.kind == "f" else "long")


def voxel_batch(dense: np.ndarray, origin: list[int]) -> pa.RecordBatch:
    """The non-zero places of an array [z, y, x]; floats stay floats, and integers must fit a long."""
    z, y, x = np.nonzero(dense)
    v = dense[z, y, x]
    if v.dtype.kind == "u" and v.dtype.itemsize == 8 and len(v) and v.max() > np.iinfo(np.int64).max:
        raise ValueError("a value above 2**63 - 1 doesn't fit a long")
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64) + o) for a, o in zip((x, y, z), origin, strict=True)] + [pa.array(v.astype(np.float64 if v.dtype.kind == "f" else np.int64))], names=[*XYZ, "v"])


def from_chunks(chunks: DataFrame, dtype: str = "uint64") -> DataFrame:
    """The non-zero voxels of the chunk rows of a type's kind (floats have double values, others longs)."""
    kind = np.dtype(dtype)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                dense = np.frombuffer(r["data"], dtype=np.dtype(r["dtype"]).newbyteorder("<")).reshape(r["dz"], r["dy"], r["dx"])
                if (dense.dtype.kind == "f") != (kind.kind == "f"):
                    raise ValueError(f"chunks of {r['dtype']} read as {dtype}")
                yield voxel_batch(dense, [r[f"o{c}"] for c in XYZ])

    return chunks.select("ox", "oy", "oz", "dx", "dy", "dz", "dtype", "data").mapInArrow(run, _voxel_schema(kind))


def write_volume(volume: DataFrame, grid: Grid, path: str, dataset: str, dtype: str = "uint64") -> None:
    """Chunk rows in Parquet by dataset; a dataset that is there already is replaced."""
    to_chunks(volume, grid, dataset, dtype).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)


def stored_chunks(spark: SparkSession, path: str, dataset: str, grid: Grid | None = None, offset: tuple[int, int, int] | None = None, dim: tuple[int, int, int] | None = None) -> DataFrame:
    """The chunk rows of one dataset; with a grid and a box, those that meet the box, by conditions on the origin that reach the files' statistics.

    Without its data column the table is the dataset's block plan, and no chunk is read.
    """
    rows = spark.read.schema(SCHEMA).parquet(path).where(F.col("dataset") == dataset)
    if offset is not None:
        for c, o, d, b in zip(XYZ, offset, dim, grid.block, strict=True):
            rows = rows.where((F.col(f"o{c}") > o - b) & (F.col(f"o{c}") < o + d))
    return rows


def read_volume(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """The voxels of one dataset, floats as doubles; other datasets' files aren't read."""
    own = stored_chunks(spark, path, dataset)
    kind = own.select("dtype").first()
    return from_chunks(own, kind.dtype if kind else "uint64")


def _decompress(codec: str | None, raw: bytes) -> bytes:
    """A block's bytes; codecs that Python doesn't have are refused."""
    known = {None: bytes, "raw": bytes, "zlib": zlib.decompress, "gzip": gzip.decompress, "bzip2": bz2.decompress, "bz2": bz2.decompress, "xz": lzma.decompress, "lzma": lzma.decompress}
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if codec not in known:
        raise ValueError(f"no reader for blocks of codec {codec}")
    return known[codec](raw)


def _attributes(spark: SparkSession, path: str, name: str) -> dict:
    """A small metadata file, through Spark's file systems; its readers skip names that begin with a dot."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def grid_of(attributes: dict) -> Grid:
    """Resolution keys in the order resolution, pixelResolution, element_size_um, transform; 4 nm if none is there."""
    for key in ("resolution", "pixelResolution", "element_size_um", "transform"):
        if key in attributes:
            r = attributes[key]
            r = r.get("dimensions", r.get("scale")) if isinstance(r, dict) else r
            break
    else:
        r = [4.0, 4.0, 4.0]
    return Grid(tuple(attributes["dimensions"]), tuple(attributes["blockSize"]), tuple(map(float, r)), tuple(map(float, attributes.get("offset", (0, 0, 0)))))


def n5_block(content: bytes, dtype: np.dtype, codec: str | None) -> np.ndarray:
    """The values [z, y, x] of an n5 block."""
    mode, axes = np.frombuffer(content[:4], ">u2")
    size = np.frombuffer(content[4 : 4 + 4 * int(axes)], ">u4").astype(int)
    raw = content[4 + 4 * int(axes) + (4 if mode else 0) :]
    return np.frombuffer(_decompress(codec, raw), dtype)[: size.prod()].reshape(size[::-1]).astype(dtype.newbyteorder("="))


def zarr_block(content: bytes, dtype: np.dtype, codec: str | None, chunk: tuple[int, ...]) -> np.ndarray:
    """The values [z, y, x] of a zarr chunk, which is never cropped."""
    return np.frombuffer(_decompress(codec, content), dtype).reshape(chunk).astype(dtype.newbyteorder("="))


def read_n5(spark: SparkSession, container: str, dataset: str) -> tuple[DataFrame, Grid]:
    """(voxels, grid) of an n5 dataset with raw, gzip, bzip2, xz or zstd blocks; blocks that aren't there are background."""
    root = f"{container.rstrip('/')}/{dataset.strip('/')}"
    attributes = _attributes(spark, root, "attributes.json")
    grid, dtype = grid_of(attributes), np.dtype(attributes["dataType"]).newbyteorder(">")
    kind = attributes.get("compression", {"type": attributes.get("compressionType", "raw")})["type"]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("path").rlike(r"/\d+/\d+/\d+$")).select("path", "content")
    block = grid.block

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                at = [int(s) for s in re.search(r"/(\d+)/(\d+)/(\d+)$", path).groups()]
                yield voxel_batch(n5_block(content, dtype, kind), [o * n for o, n in zip(at, block, strict=True)])

    return files.mapInArrow(run, _voxel_schema(dtype)), grid


def write_n5(volume: DataFrame, grid: Grid, container: str, dataset: str, dtype: str = "uint64") -> None:
    """An n5 dataset with gzip blocks, in any store that pyarrow opens by its address; a block's file is replaced as a whole, so tasks may run again.

    Blocks without voxels have no file; files of an earlier dataset in that place are deleted first.
    """
    from .voxels import opened

    root = f"{container.rstrip('/')}/{dataset.strip('/')}"
    store, base = opened(root)
    store.create_dir(base)
    store.delete_dir_contents(base)
    about = {"dimensions": list(grid.dim), "blockSize": list(grid.block), "dataType": dtype, "compression": {"type": "gzip", "level": -1}, "pixelResolution": {"dimensions": list(grid.resolution), "unit": "nm"}, "offset": list(grid.offset)}
    with store.open_output_stream(f"{base}/attributes.json", compression=None) as out:
        out.write(json.dumps(about).encode())

    def run(batches):
        own, at = opened(root)
        for b in batches:
            for r in b.to_pylist():
                dense = np.frombuffer(r["data"], np.dtype(dtype).newbyteorder("<")).astype(np.dtype(dtype).newbyteorder(">"))
                head = np.array([0, 3], ">u2").tobytes() + np.array([r["dx"], r["dy"], r["dz"]], ">u4").tobytes()
                own.create_dir(f"{at}/{r['gx']}/{r['gy']}")
                part = f"{at}/{r['gx']}/{r['gy']}/.{r['gz']}-{uuid.uuid4().hex}"
                with own.open_output_stream(part, compression=None) as out:
                    out.write(head + gzip.compress(dense.tobytes()))
                own.move(part, f"{at}/{r['gx']}/{r['gy']}/{r['gz']}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    to_chunks(volume, grid, dataset, dtype).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read_zarr(spark: SparkSession, container: str, dataset: str) -> tuple[DataFrame, Grid]:
    """(voxels, grid) of a zarr dataset (version 2, axes z, y, x) with raw, zlib, gzip, bz2, lzma or zstd chunks; other codecs, filters and fill values raise an error."""
    root = f"{container.rstrip('/')}/{dataset.strip('/')}"
    meta = _attributes(spark, root, ".zarray")
    sep, kind, dtype = meta.get("dimension_separator", "."), (meta.get("compressor") or {}).get("id"), np.dtype(meta["dtype"])
    grid = Grid(tuple(meta["shape"][::-1]), tuple(meta["chunks"][::-1]))
    chunk, dim, fill = meta["chunks"], meta["shape"], meta.get("fill_value") or 0
    if meta.get("filters") or meta.get("order", "C") != "C":
        raise ValueError("filters and other orders than C aren't read")
    pattern = rf"/(\d+){re.escape(sep)}(\d+){re.escape(sep)}(\d+)$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("path").rlike(pattern)).select("path", "content")
    if fill:
        raise ValueError("a fill value other than 0 has no sparse form")

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                at = [int(s) * n for s, n in zip(re.search(pattern, path).groups(), chunk, strict=True)]
                dense = zarr_block(content, dtype, kind, chunk)[tuple(slice(0, d - o) for d, o in zip(dim, at, strict=True))]
                yield voxel_batch(dense, at[::-1])

    return files.mapInArrow(run, _voxel_schema(dtype)), grid


def write_table(df: DataFrame, path: str) -> None:
    """A table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table by position; the header is skipped."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def parse_numbers(text: str, kind: type = int) -> list:
    """A comma-separated list; "1,2,3" or "4"."""
    return [kind(s) for s in text.split(",") if s.strip()]
