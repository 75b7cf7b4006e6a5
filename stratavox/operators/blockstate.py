"""Iterations over dense blocks in which only what changed is read and written.

A state has a row of bytes for each block of a grid that isn't empty: its channels as dense arrays. A pass runs a kernel on the active blocks; each gets itself and, from the 26
blocks around, the margins that its halo covers, cut out before they move. The pass writes rows of the active blocks alone, and a table of a row a block says
in which pass each was written last. A kernel also says how deep from each side of the block its changes reach, so that a block runs again only if a neighbour changed something
that it can see, and finished blocks lie still.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.plans.checkpoints import cut, drop

from .volume import XYZ, Block, Grid, spread_to_blocks

KEY = ["bx", "by", "bz"]
#: After so many passes the tables are made one again.
TABLES = 12
_ROW = "bx long, by long, bz long, data binary"


def roomy(grid: Grid, halo: int) -> Grid:
    """The grid with blocks of whole multiples that are no smaller than the halo."""
    return replace(grid, block=tuple(b * -(-halo // b) for b in grid.block))


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values()), 1)


def _unpack(data: bytes, kinds: dict[str, np.dtype], shape: tuple[int, ...]) -> dict[str, np.ndarray]:
    raw, out, at = zlib.decompress(data), {}, 0
    n = int(np.prod(shape))
    for name, kind in kinds.items():
        out[name] = np.frombuffer(raw, kind, n, at).reshape(shape)
        at += n * kind.itemsize
    return out


def _shape(grid: Grid, key: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(b, d - k * b) for k, b, d in zip(key, grid.block, grid.dim, strict=True))


class State:
    """Blocks of a grid with the channels named in kinds; blocks without a row are zero."""

    def __init__(self, rows: DataFrame, grid: Grid, kinds: dict[str, np.dtype | type]):
        """rows: (x, y, z, channel, ...); channels without a column, and null values, are zero."""
        self.grid, self.kinds = grid, {c: np.dtype(k) for c, k in kinds.items()}
        #: How many blocks each pass has written.
        self.passes: list[int] = []
        names, kinds_ = [c for c in self.kinds if c in rows.columns], self.kinds

        def make(t: pa.Table) -> pa.Table:
            col = {c: np.asarray(t.column(c).combine_chunks().fill_null(False if kinds_.get(c) == np.bool_ else 0)) for c in [*XYZ, *names, *KEY]}
            key = tuple(int(col[k][0]) for k in KEY)
            at = tuple(col[c] - k * b for c, k, b in zip(XYZ, key, grid.block, strict=True))
            arrays = {c: np.zeros(_shape(grid, key), k) for c, k in kinds_.items()}
            for c in names:
                np.maximum.at(arrays[c], at, col[c].astype(kinds_[c]))
            return pa.table({**{k: [v] for k, v in zip(KEY, key, strict=True)}, "data": [_pack(arrays)]})

        made = rows.select(*XYZ, *names, *grid.block_key()).groupBy(*KEY).applyInArrow(make, _ROW)
        self.tables = [cut(made)]
        self.index = cut(self.tables[0].select(*KEY, F.lit(0).alias("table")))

    def blocks(self) -> DataFrame:
        """Rows (bx, by, bz, data): each block as it was written last."""
        return self._latest(self.index)

    def _latest(self, wanted: DataFrame) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [t.select(*KEY, "data", F.lit(i).alias("table")) for i, t in enumerate(self.tables)])
        return rows.join(wanted, [*KEY, "table"]).drop("table")

    def all_keys(self) -> DataFrame:
        return self.index.select(*KEY)

    def around(self, rows: DataFrame, halo: int) -> DataFrame:
        """The blocks that rows (x, y, z) are in or within the halo of, a cut."""
        near = spread_to_blocks(rows.select(*XYZ), self.grid, halo).select(*KEY).distinct()
        return cut(near.join(self.all_keys(), KEY, "left_semi"))

    def run(self, halo: int, kernel: Callable[[Block], tuple[dict[str, np.ndarray], np.ndarray]], active: DataFrame, again: bool = True) -> DataFrame:
        """One pass over the active blocks (bx, by, bz); returns the blocks that it makes active, a cut.

        kernel(block) gives the new channels of the padded array, of which the block's own part is kept, and where something changed. A neighbour becomes active if a change lies within
        the halo of it, and with again the block itself if anything changed at all. Blocks must be no smaller than the halo (``roomy``).
        """
        if halo > min(self.grid.block):
            raise ValueError("the halo is wider than a block")
        grid, kinds = self.grid, self.kinds
        steps = F.array(*(F.struct(*(F.lit(d).alias(f"d{c}") for d, c in zip(s, XYZ, strict=True))) for s in np.ndindex(3, 3, 3)))
        pairs = active.select(*(F.col(k).alias(f"t{k}") for k in KEY), F.explode(steps).alias("s"))
        pairs = pairs.select(*(f"t{k}" for k in KEY), *((F.col(f"t{k}") + F.col(f"s.d{c}") - 1).alias(k) for k, c in zip(KEY, XYZ, strict=True)))
        # a block has at most 27 targets
        pairs = pairs.groupBy(*KEY).agg(F.collect_list(F.struct(*(f"t{k}" for k in KEY))).alias("targets"))
        seen = self._latest(self.index.join(pairs, KEY))

        def margins(batches):
            # what a target sees of a block: all of itself, and a slab of the halo's width of a neighbour
            for batch in batches:
                for r in batch.to_pylist():
                    key, out = tuple(r[k] for k in KEY), []
                    shape = _shape(grid, key)
                    whole = _unpack(r["data"], kinds, shape)
                    for to in (tuple(t[f"t{k}"] for k in KEY) for t in r["targets"]):
                        part = tuple(slice(0, min(halo, n)) if k > t else slice(max(0, n - halo), n) if k < t else slice(0, n) for k, t, n in zip(key, to, shape, strict=True))
                        arrays = {c: a[part] for c, a in whole.items()}
                        origin = [k * b + p.start for k, b, p in zip(key, grid.block, part, strict=True)]
                        if key == to or any(a.any() for a in arrays.values()):
                            out.append((*to, *origin, *next(iter(arrays.values())).shape, r["data"] if key == to else _pack(arrays)))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*KEY, *(f"{p}{c}" for p in "od" for c in XYZ), "data"])

        def work(t: pa.Table) -> pa.Table:
            rows = t.to_pylist()
            key = tuple(rows[0][k] for k in KEY)
            corner = tuple(k * b - halo for k, b in zip(key, grid.block, strict=True))
            own = _shape(grid, key)
            arrays = {c: np.zeros([n + 2 * halo for n in own], k) for c, k in kinds.items()}
            for r in rows:
                shape = tuple(r[f"d{c}"] for c in XYZ)
                part = tuple(slice(r[f"o{c}"] - o, r[f"o{c}"] - o + n) for c, o, n in zip(XYZ, corner, shape, strict=True))
                for c, a in _unpack(r["data"], kinds, shape).items():
                    arrays[c][part] = a
            b = Block(arrays, corner, grid.dim, halo)
            done, changed = kernel(b)
            changed = changed[b.core]
            wakes = []
            for step in np.ndindex(3, 3, 3):
                near = tuple(slice(0, min(halo, n)) if s == 0 else slice(max(0, n - halo), n) if s == 2 else slice(0, n) for s, n in zip(step, own, strict=True))
                if (again or step != (1, 1, 1)) and changed[near].any():
                    wakes.append([k + s - 1 for k, s in zip(key, step, strict=True)])
            kept = {c: done[c][b.core].astype(k) if c in done else arrays[c][b.core] for c, k in kinds.items()}
            return pa.table({**{k: [v] for k, v in zip(KEY, key, strict=True)}, "data": [_pack(kept)], "wakes": pa.array([wakes], pa.list_(pa.list_(pa.int64())))})

        pieces = seen.select(*KEY, "targets", "data").mapInArrow(margins, "bx long, by long, bz long, ox long, oy long, oz long, dx long, dy long, dz long, data binary")
        made = cut(pieces.groupBy(*KEY).applyInArrow(work, f"{_ROW}, wakes array<array<long>>"))
        woken = made.select(F.explode("wakes").alias("w")).select(*(F.col("w")[i].alias(k) for i, k in enumerate(KEY))).distinct()
        woken = cut(woken.join(self.all_keys(), KEY, "left_semi"))
        self.passes.append(made.count())
        self.tables.append(made)
        self._point(made)
        return woken

    def _point(self, made: DataFrame) -> None:
        """The index after a pass; many tables become one."""
        old = self.index
        new = made.select(*KEY, F.lit(len(self.tables) - 1).alias("table"))
        self.index = cut(old.join(new.select(*KEY), KEY, "left_anti").unionByName(new))
        drop(old)
        if len(self.tables) > TABLES:
            whole = cut(self.blocks())
            for t in self.tables:
                drop(t)
            drop(self.index)
            self.tables, self.index = [whole], cut(whole.select(*KEY, F.lit(0).alias("table")))

    def rows(self, where: Callable[[dict[str, np.ndarray]], np.ndarray], schema: str) -> DataFrame:
        """Rows (x, y, z, channels of the schema) of the places where a condition holds."""
        kinds, grid = self.kinds, self.grid
        names = [f.split()[0] for f in schema.split(", ")]

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    key = tuple(r[k] for k in KEY)
                    arrays = _unpack(r["data"], kinds, _shape(grid, key))
                    at = np.nonzero(where(arrays))
                    if len(at[0]):
                        out = {c: a + k * b for c, a, k, b in zip(XYZ, at, key, grid.block, strict=True)} | {c: a[at] for c, a in arrays.items()}
                        yield pa.RecordBatch.from_arrays([pa.array(out[c]) for c in names], names=names)

        return self.blocks().select(*KEY, "data").mapInArrow(run, schema)
