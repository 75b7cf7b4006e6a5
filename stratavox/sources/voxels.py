"""The "voxels" format: voxels of n5 and zarr (version 2) datasets by Spark's Python data source API, with boxes that choose chunk files.

A box chooses the directories that are listed and the files that are opened; what lies in an opened chunk outside it is dropped before it becomes rows. A partition is one of the container's
innermost directories, or some files of a flat one; the driver lists the levels above. With the option chunks, rows are those of the chunk files themselves, none of
which is opened: the blocks of a dataset that exist.

The box is an option of the reader, not a pushed filter: in Spark 4.1.2 a filter that such a source accepts stays with the frame, and a later query of the same frame without the filter gets
the first one's rows.

Files are opened through pyarrow, so the container's address must be one that pyarrow knows; ``chunks.read_n5`` and ``read_zarr`` go through Spark's own file systems.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stratavox.operators.volume import XYZ, Grid

from .chunks import grid_of, n5_block, voxel_batch, zarr_block

#: Files of a flat directory in a partition.
FILES = 64
CHUNKS = "gx long, gy long, gz long, ox long, oy long, oz long, dx long, dy long, dz long"


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """The store and the path of an address; a plain path or file: is a local file."""
    address = re.sub(r"^file:/*", "/", address.rstrip("/"))
    return fs.FileSystem.from_uri(address if "://" in address else f"file://{address}")


@dataclass(frozen=True)
class Layout:
    """What a dataset's metadata says, and where its chunks are: names by axis in the order of the path."""

    grid: Grid
    dtype: str
    codec: str | None
    axes: str
    sep: str

    @property
    def schema(self) -> str:
        return "x long, y long, z long, v " + ("double" if np.dtype(self.dtype).kind == "f" else "long")

    def decode(self, content: bytes) -> np.ndarray:
        """A chunk's values [z, y, x]."""
        if self.axes == "xyz":
            return n5_block(content, np.dtype(self.dtype), self.codec)
        return zarr_block(content, np.dtype(self.dtype), self.codec, self.grid.block[::-1])


def layout(address: str, kind: str) -> Layout:
    store, root = opened(address)
    name = {"n5": "attributes.json", "zarr": ".zarray"}.get(kind)
    if name is None:
        raise ValueError(f"no layout {kind}; there are n5 and zarr")
    with store.open_input_stream(f"{root}/{name}", compression=None) as f:
        about = json.loads(f.read())
    if kind == "n5":
        codec = about.get("compression", {"type": about.get("compressionType", "raw")})["type"]
        return Layout(grid_of(about), np.dtype(about["dataType"]).newbyteorder(">").str, codec, "xyz", "/")
    if about.get("filters") or about.get("order", "C") != "C" or about.get("fill_value"):
        raise ValueError("filters, other orders than C and fill values other than 0 aren't read")
    return Layout(Grid(tuple(about["shape"][::-1]), tuple(about["chunks"][::-1])), about["dtype"], (about.get("compressor") or {}).get("id"), "zyx", about.get("dimension_separator", "."))


@dataclass
class Files(InputPartition):
    """Chunk files by their places, or the directory that holds them, by the places of its two levels."""

    parts: list[tuple[int, ...]]


class Reader(DataSourceReader):
    def __init__(self, address: str, kind: str, listing: bool, box: list[int] | None):
        self.address, self.listing, self.layout = address, listing, layout(address, kind)
        dim = self.layout.grid.dim
        offset, extent = (box[:3], box[3:]) if box else ((0, 0, 0), dim)
        self.low = {c: max(0, o) for c, o in zip(XYZ, offset, strict=True)}
        self.high = {c: min(d, o + n) - 1 for c, o, n, d in zip(XYZ, offset, extent, dim, strict=True)}

    def _span(self, axis: str) -> range:
        b = self.layout.grid.block["xyz".index(axis)]
        return range(max(0, self.low[axis] // b), self.high[axis] // b + 1)

    def _numbers(self, store: fs.FileSystem, path: str, axis: str) -> list[int]:
        """The entries of a directory that are numbers within an axis's span."""
        span = self._span(axis)
        names = (i.base_name for i in store.get_file_info(fs.FileSelector(path, allow_not_found=True)))
        return sorted(int(n) for n in names if n.isdigit() and int(n) in span)

    def partitions(self) -> list[InputPartition]:
        store, root = opened(self.address)
        a, b, _ = self.layout.axes
        if self.layout.sep == "/":
            return [Files([(i, j)]) for i in self._numbers(store, root, a) for j in self._numbers(store, f"{root}/{i}", b)] or [Files([])]
        spans, found = [self._span(c) for c in self.layout.axes], []
        for info in store.get_file_info(fs.FileSelector(root)):
            m = re.fullmatch(rf"(\d+){re.escape(self.layout.sep)}(\d+){re.escape(self.layout.sep)}(\d+)", info.base_name)
            if m and all(int(g) in s for g, s in zip(m.groups(), spans, strict=True)):
                found.append(tuple(map(int, m.groups())))
        found.sort()
        return [Files(found[i : i + FILES]) for i in range(0, len(found), FILES)] or [Files([])]

    def read(self, partition: Files):
        store, root = opened(self.address)
        grid, axes = self.layout.grid, self.layout.axes
        places = []
        for p in partition.parts:
            places += [p] if len(p) == 3 else [(*p, k) for k in self._numbers(store, f"{root}/{p[0]}/{p[1]}", axes[2])]
        at = [dict(zip(axes, p, strict=True)) for p in places]
        origin = [[p[c] * b for c, b in zip(XYZ, grid.block, strict=True)] for p in at]
        size = [[min(b, d - o) for o, b, d in zip(q, grid.block, grid.dim, strict=True)] for q in origin]
        if self.listing:
            rows = [[*(p[c] for c in XYZ), *q, *s] for p, q, s in zip(at, origin, size, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[f.split()[0] for f in CHUNKS.split(", ")])
            return
        for p, q, s in zip(places, origin, size, strict=True):
            with store.open_input_stream(f"{root}/{self.layout.sep.join(map(str, p))}", compression=None) as f:
                dense = self.layout.decode(f.read())
            cut = [slice(max(0, self.low[c] - o), max(0, min(n, self.high[c] + 1 - o))) for c, o, n in zip(XYZ, q, s, strict=True)]
            yield voxel_batch(dense[tuple(cut[::-1])], [o + k.start for o, k in zip(q, cut, strict=True)])


class Voxels(DataSource):
    """Options: path of the dataset, layout (n5 or zarr), box ("x,y,z,dx,dy,dz"), and chunks ("true" for a row of each chunk file that meets the box instead of voxels)."""

    @classmethod
    def name(cls) -> str:
        return "voxels"

    def _listing(self) -> bool:
        return self.options.get("chunks", "false") == "true"

    def schema(self) -> str:
        return CHUNKS if self._listing() else layout(self.options["path"], self.options.get("layout", "n5")).schema

    def reader(self, schema) -> Reader:
        box = [int(n) for n in self.options["box"].split(",")] if "box" in self.options else None
        return Reader(self.options["path"], self.options.get("layout", "n5"), self._listing(), box)


def _load(spark: SparkSession, container: str, dataset: str, kind: str, box, listing: bool) -> tuple[DataFrame, str]:
    spark.dataSource.register(Voxels)
    address = f"{container.rstrip('/')}/{dataset.strip('/')}"
    reader = spark.read.format("voxels").option("layout", kind).option("chunks", str(listing).lower())
    if box is not None:
        reader = reader.option("box", ",".join(str(int(n)) for part in box for n in part))
    return reader.load(address), address


def read(spark: SparkSession, container: str, dataset: str, kind: str = "n5", box: tuple[tuple[int, int, int], tuple[int, int, int]] | None = None) -> tuple[DataFrame, Grid]:
    """(voxels, grid) of a dataset, or of its part in a box (offset, dim); only chunk files that meet the box are opened."""
    df, address = _load(spark, container, dataset, kind, box, False)
    return df, layout(address, kind).grid


def existing_chunks(spark: SparkSession, container: str, dataset: str, kind: str = "n5", box: tuple[tuple[int, int, int], tuple[int, int, int]] | None = None) -> DataFrame:
    """Rows (gx, gy, gz, ox, oy, oz, dx, dy, dz) of the chunk files that are there, cropped at the volume's end."""
    return _load(spark, container, dataset, kind, box, True)[0]
