"""Suffix-array dedup: removal of bytes in 100-byte strings that also start earlier.

The order of all suffixes is never needed whole; what decides is, for each start, whether an earlier suffix shares a prefix of
``LENGTH`` bytes. As in induced sorting, only sampled suffixes are sorted: those at local minima of a hash of ``K`` bytes, the least within
each string's own bytes, so equal strings hold the same sampled suffix at the same place. Strings that fall to one sample
follow each other and form a run. Spark's shuffle sort on disk is the external queue that brings equal samples together, each with its
run's place and a common-content value; the strings of a run are induced from it.

1. A scan samples runs. Equal runs within a pack keep their first; the rest are removed at once, so a frequent passage sends one run a pack.
2. By range of sample hashes, equal runs keep their first; samples that have several different runs ask for bytes.
3. The bytes of those runs, from the texts, meet by sample; every string in them keeps its first occurrence.
4. Removed ranges are united by document and cut from its text.

A sample with very many different runs would be a large group. Such frequent samples, found in a pack or in a range, go another way with the same results: their
runs are compared by content, and their strings meet by the strings' own hashes, after each task has kept its firsts.

Copies of whole texts are found by digest; only the smallest doc_id of a digest takes part, any other is removed whole. Tasks work on packs of bounded
size and never hold the texts of a shard at once.

Long texts are sampled in pieces of ``SLICE`` bytes, which overlap so that each string is whole in one.

Equality is that of 64-bit hashes twice over (the sample's and the run's or string's). Defined results: a null text is empty; texts under
100 bytes lose nothing; a null doc_id stands before all others; rows that share a doc_id and text are one document with equal results, and
rows that share a doc_id with different texts are ordered by a checksum of the text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.plans.checkpoints import cut
from .textbatch import BYTE_VALUE, flat, mix, powers, slices

LENGTH, K = 100, 24
PACK_BYTES, SLICE = 16 << 20, 3 << 20
#: About how many bytes of text one range of sample hashes stands for.
RANGE_BYTES = 48 << 20
NULL_ID = -(1 << 63)
#: A sample with more different runs than this in a range is frequent.
FREQUENT = 1 << 14
#: Strings that a task holds before it sends their firsts.
HELD_STRINGS = 1 << 20
#: Bytes of runs that are hashed at once.
HASHED_BYTES = 4 << 20
#: Marks runs of frequent samples, beside a number of strings.
_HEAVY = 128
#: Stands for the range of a whole text.
ALL = b"*"
_PLACE = np.uint64((1 << 28) - 1)

#: at is a range of sample hashes, or from the number of ranges on one of contents; a place of 0 says that a sample is frequent.
#: At -1 - k stand ranges of part k of the documents: start in sample, tie in place, end in content.
RUNS = "at long, sample binary, doc binary, place binary, content binary"
#: Bytes of runs by range of samples; from the number of ranges on packed strings (hash, sample, document, place); at -1 - k packed ranges (document, tie, start, end).
BYTES = "at long, sample long, doc long, place long, bytes binary"
#: By part of the documents: ranges (a to b), or wanted runs (a is the start, b the number of strings and the mark of frequent samples), in packed columns.
PARTS = "part long, doc binary, tie binary, a binary, b binary, sample binary"
RANGES = "doc long, tie int, ranges binary"


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for hashes of any bytes of data, and what brings them to one place."""
    up, down = powers(len(data) + 1)
    p = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=p[1:])
    return p, down


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, strings, sample, content) of each run; start counts within the text.

    content is a hash of all the bytes of the run's strings.
    """
    n, width = len(data), LENGTH - K + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    p, down = prefix_hash(data)
    h = mix((p[K:] - p[:-K]) * down[: n - K + 1])
    m = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    if reach < width:
        m = np.minimum(m[: len(m) - (width - reach)], m[width - reach :])
    sampled = (m & _PLACE).astype(np.int64)
    edge = np.zeros(n + 1, np.int64)  # strings that would cross the end of a text
    np.add.at(edge, np.maximum(off[1:] - LENGTH + 1, off[:-1]), 1)
    np.add.at(edge, off[1:], -1)
    inside = np.cumsum(edge)[: n - LENGTH + 1] == 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (sampled[1:] != sampled[:-1])
    new[off[:-1][off[:-1] < len(new)]] &= True
    start = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.r_[~inside[1:] | new[1:], True]) + 1
    text = np.searchsorted(off, start, side="right") - 1
    end = stop + LENGTH - 1
    content = mix((p[end] - p[start]) * down[start])
    return text, start - off[text], stop - start, h[sampled[start]], content


def pieces(text: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(start, bytes) of a long text's parts; each string is whole in just one, so a run that is parted counts as two."""
    for at in range(0, max(len(text) - LENGTH + 1, 1), SLICE):
        yield at, text[at : at + SLICE + LENGTH - 1]


def _join_ranges(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unites overlapping or touching ranges of each text."""
    if not len(text):
        return text, start, end
    order = np.lexsort((start, text))
    text, start, end = text[order], start[order], end[order]
    far = int(max(end.max(), start.max())) + 2
    reach = np.maximum.accumulate(end + text * far) - text * far
    new = np.r_[True, (text[1:] != text[:-1]) | (start[1:] > reach[:-1])]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(text) - 1]
    return text[new], start[new], reach[last]


def _range_rows(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Rows (doc, tie, ranges): the united ranges of each document."""
    if not len(doc):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary())], names=["doc", "tie", "ranges"])
    order = np.lexsort((tie, doc))
    doc, tie, start, end = doc[order], tie[order], start[order], end[order]
    number = np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])])
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    own, a, b = _join_ranges(number, start, end)
    edge = np.searchsorted(own, np.arange(len(first) + 1))
    both = np.column_stack([a, b]).astype("<i8")
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[first]), pa.array(tie[first].astype(np.int32)), pa.array([both[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], names=["doc", "tie", "ranges"]
    )


def _united(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, tie, start, end) of each document's united ranges."""
    order = np.lexsort((tie, doc))
    doc, tie, start, end = doc[order], tie[order], start[order], end[order]
    number = np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])]) if len(doc) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(doc) else np.zeros(0, np.int64)
    own, a, b = _join_ranges(number, start, end)
    return doc[first][own], tie[first][own], a, b


def _part_of(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _by_part(parts: int, doc: np.ndarray, *cols: np.ndarray) -> list[list]:
    """Lists of parts, and of the bytes of doc and cols by part."""
    part = _part_of(doc, parts)
    order = np.argsort(part, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True]) if len(doc) else np.zeros(1, np.int64)
    packed = [[np.asarray(c)[order][i:j].astype("<i8").tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)] for c in (doc, *cols)]
    return [part[order][edge[:-1]].tolist(), *packed]


def _place(start: np.ndarray, strings: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """start, strings and tie in one long; starts may have 33 bits."""
    return (start.astype(np.int64) << 31) | (strings.astype(np.int64) << 24) | tie.astype(np.int64)


def _placed(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 31, (place >> 24) & 127, place & 0xFFFFFF


def _firsts(keys: tuple[np.ndarray, ...], doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first of their keys by document order, and which are later; a repeated row of the first place is neither."""
    order = np.lexsort((start, tie, doc, *keys))
    new = np.zeros(len(doc), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    other = np.zeros(len(doc), dtype=bool)
    for c in (doc, tie, start):
        other |= c[order] != c[order][lead]
    first, late = np.zeros(len(doc), dtype=bool), np.zeros(len(doc), dtype=bool)
    first[order], late[order] = new, other
    return first, late


def _edges(at: np.ndarray) -> np.ndarray:
    """Where the values of a sorted array begin, and its end."""
    return np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]) if len(at) else np.zeros(1, np.int64)


def string_hashes(data: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place in its run) of each string of runs whose bytes follow each other."""
    within = np.arange(int(strings.sum())) - np.repeat(np.cumsum(strings) - strings, strings)
    at = np.repeat(np.r_[0, np.cumsum(strings + LENGTH - 1)][:-1], strings) + within
    p, down = prefix_hash(data)
    return mix((p[at + LENGTH] - p[at]) * down[at]), within


def sampled_runs(docs: DataFrame, ranges: int, most: int = FREQUENT) -> DataFrame:
    """Packed runs by range of samples; at -1 - k stand ranges that the pack already knows to be repeats.

    Runs of a sample that has more than ``most`` different ones in the pack stand by content instead, and a row says so where the sample's others are.
    """

    def out(held: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"".join(t for _, _, t in held), dtype=np.uint8)
        off = np.r_[0, np.cumsum([len(t) for _, _, t in held])].astype(np.int64)
        doc, tie = np.array([d for d, _, _ in held], np.int64), np.array([t for _, t, _ in held], np.int64)
        found = []
        for i, j in slices(off, SLICE):
            for at, piece in pieces(data[off[i] : off[j]]) if j == i + 1 else [(0, data[off[i] : off[j]])]:
                text, start, strings, sample, content = runs(piece, off[i : j + 1] - off[i] if j > i + 1 else np.array([0, len(piece)]))
                found.append((doc[text + i], tie[text + i], start + at, strings, sample, content))
        d, t, start, strings, sample, content = (np.concatenate(x) for x in zip(*found, strict=True))
        first, late = _firsts((content, sample), d, t, start)
        again_doc, *again = _united(d[late], t[late], start[late], (start + strings + LENGTH - 1)[late])
        part, own, tied, a, z = _by_part(ranges, again_doc, *again)
        yield pa.RecordBatch.from_arrays([pa.array([-1 - k for k in part], pa.int64()), *(pa.array(c, pa.binary()) for c in (a, own, tied, z))], names=["at", "sample", "doc", "place", "content"])
        known, which, n = np.unique(sample[first], return_inverse=True, return_counts=True)
        told = known[n > most]
        nothing = np.zeros(len(told), np.int64)
        at = np.where((n > most)[which], ranges + (content[first] % np.uint64(ranges)).astype(np.int64), (sample[first] % np.uint64(ranges)).astype(np.int64))
        at = np.r_[at, (told % np.uint64(ranges)).astype(np.int64)]
        cols = [np.concatenate(x) for x in ((sample[first], told), (d[first], nothing), (_place(start, strings, t)[first], nothing), (content[first], nothing.astype(np.uint64)))]
        order = np.argsort(at, kind="stable")
        edge = _edges(at[order])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at[order][edge[:-1]]), *(pa.array([c[order][i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary()) for c in cols)], names=["at", "sample", "doc", "place", "content"])

    def run(batches):
        held: dict[bytes, tuple[int, int, bytes]] = {}
        size = 0
        for b in batches:
            data, off = flat(b.column("text"))
            for k, d in enumerate(b.column("doc").to_pylist()):
                raw = data[off[k] : off[k + 1]].tobytes()
                if len(raw) < LENGTH:
                    continue
                key = hashlib.md5(raw).digest()
                if key not in held:
                    size += len(raw)
                    held[key] = (d, zlib.crc32(raw) & 0xFFFFFF, raw)
                elif d < held[key][0]:  # the smallest doc_id stands for its copies; step 0 removes the others
                    held[key] = (d, *held[key][1:])
                if size >= PACK_BYTES:
                    yield from out(list(held.values()))
                    held, size = {}, 0
        if held:
            yield from out(list(held.values()))

    return docs.select("doc", "text").mapInArrow(run, RUNS)


def repeated_runs(packed: DataFrame, ranges: int, frequent: int = FREQUENT) -> DataFrame:
    """Packed rows by part of the documents: with an empty sample, ranges of runs that occur earlier as they are; else the runs whose bytes are wanted."""

    def meet(t: pa.Table) -> pa.Table:
        join = lambda c, kind="<i8": np.frombuffer(b"".join(t.column(c).to_pylist()), dtype=kind)
        at = t.column("at")[0].as_py()
        if at < 0:  # ranges that packs knew
            out = [[-1 - at], *([c.tobytes()] for c in _united(join("doc"), join("place"), join("sample"), join("content")))]
            return pa.table(dict(zip(["part", "doc", "tie", "a", "b", "sample"], [pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in [*out[1:], [b""]])], strict=True)))
        place = join("place")
        told = np.unique(join("sample", "<u8")[place == 0])
        sample, doc, content, place = (x[place != 0] for x in (join("sample", "<u8"), join("doc"), join("content", "<u8"), place))
        start, strings, tie = _placed(place)
        first, late = _firsts((content, sample), doc, tie, start)
        again_doc, *again = _united(doc[late], tie[late], start[late], (start + strings + LENGTH - 1)[late])
        rows = [x + [[b""] * len(x[0])] for x in [_by_part(ranges, again_doc, *again)]][0]
        sample, doc, start, strings, tie = (x[first] for x in (sample, doc, start, strings, tie))
        _, which, n = np.unique(sample, return_inverse=True, return_counts=True)
        heavy = (n[which] > frequent) | np.isin(sample, told) | (at >= ranges)
        keep = heavy | (n[which] > 1)
        wanted = _by_part(ranges, doc[keep], tie[keep], start[keep], (strings + _HEAVY * heavy)[keep], sample[keep].view(np.int64))
        return pa.table(dict(zip(["part", "doc", "tie", "a", "b", "sample"], [pa.array(x + y, pa.int64() if k == 0 else pa.binary()) for k, (x, y) in enumerate(zip(rows, wanted, strict=True))], strict=True)))

    return packed.groupBy("at").applyInArrow(meet, PARTS)


def ranges_by_document(parted: DataFrame) -> DataFrame:
    """Rows (doc, tie, ranges), one a document, from packed ranges."""

    def unite(t: pa.Table) -> pa.Table:
        join = lambda c: np.frombuffer(b"".join(t.column(c).to_pylist()), dtype="<i8")
        return pa.Table.from_batches([_range_rows(join("doc"), join("tie"), join("a"), join("b"))])

    return parted.groupBy("part").applyInArrow(unite, RANGES)


def wanted_by_document(parted: DataFrame) -> DataFrame:
    """Rows (doc, tie, wanted), one a document: (sample, start, strings) of each wanted run."""

    def gather(t: pa.Table) -> pa.Table:
        join = lambda c: np.frombuffer(b"".join(t.column(c).to_pylist()), dtype="<i8")
        doc, tie = join("doc"), join("tie")
        order = np.lexsort((join("a"), tie, doc))
        doc, tie = doc[order], tie[order]
        rows = np.column_stack([join("sample"), join("a"), join("b")])[order]
        edge = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]), True]) if len(doc) else np.zeros(1, np.int64)
        return pa.table({"doc": pa.array(doc[edge[:-1]]), "tie": pa.array(tie[edge[:-1]].astype(np.int32)), "wanted": pa.array([rows[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary())})

    return parted.groupBy("part").applyInArrow(gather, "doc long, tie int, wanted binary")


def run_bytes(docs: DataFrame, wanted: DataFrame, ranges: int) -> DataFrame:
    """The bytes of wanted runs by range of samples, and packed strings of frequent samples by range of their hashes."""
    joined = docs.join(wanted, ["doc", "tie"])
    names = ["at", "sample", "doc", "place", "bytes"]

    def hashed(heavy: list[tuple]) -> list[np.ndarray]:
        """Arrays (hash, sample, doc, start, tie) of the strings of some runs (sample, doc, start, strings, tie, bytes)."""
        sample, doc, start, strings, tie = (np.array(x, np.int64) for x in list(zip(*heavy, strict=True))[:5])
        h, within = string_hashes(np.frombuffer(b"".join(x[5] for x in heavy), np.uint8), strings)
        sample, doc, start, tie = (np.repeat(x, strings) for x in (sample, doc, start, tie))
        return [h, sample, doc, start + within, tie]

    def packed(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, sample, doc, start, tie = (np.concatenate(x) for x in zip(*held, strict=True))
        first, late = _firsts((h, sample), doc, tie, start)
        part, *known = _by_part(ranges, *_united(doc[late], tie[late], start[late], start[late] + LENGTH))
        at = ranges + (h[first] % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        edge = _edges(at[order])
        rows = np.stack([h.view(np.int64), sample, doc, _place(start, np.ones_like(start), tie)])[:, first][:, order].astype("<i8")
        ats = [*(-1 - k for k in part), *at[order][edge[:-1]].tolist()]
        blobs = [*map(b"".join, zip(*known, strict=True)), *(rows[:, i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True))]
        none = pa.array(np.zeros(len(ats), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ats, pa.int64()), none, none, none, pa.array(blobs, pa.binary())], names=names)

    def run(batches):
        held: list[list[np.ndarray]] = []
        for b in batches:
            data, off = flat(b.column("text"))
            docs_, ties = b.column("doc").to_pylist(), b.column("tie").to_pylist()
            cols: list[list] = [[], [], [], []]
            heavy: list[tuple] = []
            size = 0
            for k, blob in enumerate(b.column("wanted").to_pylist()):
                raw = data[off[k] : off[k + 1]].tobytes()
                rows = np.frombuffer(blob, dtype="<i8").reshape(-1, 3)
                for sample, s, m in rows[rows[:, 2] >= _HEAVY].tolist():
                    m -= _HEAVY
                    heavy.append((sample, docs_[k], s, m, ties[k], raw[s : s + m + LENGTH - 1]))
                    size += m + LENGTH - 1
                    if size >= HASHED_BYTES:
                        held.append(hashed(heavy))
                        heavy, size = [], 0
                    if sum(len(x[0]) for x in held) >= HELD_STRINGS:
                        yield from packed(held)
                        held = []
                rows = rows[rows[:, 2] < _HEAVY]
                cols[0] += rows[:, 0].tolist()
                cols[1] += [docs_[k]] * len(rows)
                cols[2] += _place(rows[:, 1], rows[:, 2], np.full(len(rows), ties[k])).tolist()
                cols[3] += [raw[s : s + m + LENGTH - 1] for s, m in rows[:, 1:].tolist()]
            if heavy:
                held.append(hashed(heavy))
            sample = np.array(cols[0], dtype=np.int64)
            at = (sample.view(np.uint64) // np.uint64(7) % np.uint64(ranges)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sample), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=names)
        if held:
            yield from packed(held)

    return joined.select("doc", "tie", "text", "wanted").mapInArrow(run, BYTES)


def repeated_strings(contexts: DataFrame, ranges: int) -> DataFrame:
    """Packed ranges by part of the documents: the strings in the runs' bytes that start earlier in document order."""

    def meet(t: pa.Table) -> pa.Table:
        range_ = t.column("at")[0].as_py()
        data, off = flat(t.column("bytes"))
        if range_ < 0 or range_ >= ranges:
            rows = np.concatenate([np.frombuffer(data[i:j].tobytes(), "<i8").reshape(4, -1) for i, j in zip(off[:-1], off[1:], strict=True)], axis=1)
        if range_ < 0:  # ranges that tasks knew
            d, ti, a, b = rows
        elif range_ >= ranges:
            start, _, tie = _placed(rows[3])
            _, late = _firsts((rows[0], rows[1]), rows[2], tie, start)
            d, ti, a, b = rows[2][late], tie[late], start[late], start[late] + LENGTH
        else:
            sample, doc = np.asarray(t.column("sample").combine_chunks()).view(np.uint64), np.asarray(t.column("doc").combine_chunks())
            start, strings, tie = _placed(np.asarray(t.column("place").combine_chunks()))
            order = np.argsort(sample, kind="stable")
            out, i = [], 0
            cost = np.cumsum(strings[order] + LENGTH - 1)
            while i < len(order):  # some samples at a time
                j = int(np.searchsorted(cost, (cost[i - 1] if i else 0) + HASHED_BYTES, side="right"))
                j = max(j, i + 1)
                while j < len(order) and sample[order[j]] == sample[order[j - 1]]:  # a sample here has at most FREQUENT runs
                    j += 1
                own = order[i:j]
                m = strings[own]
                h, within = string_hashes(np.concatenate([data[off[k] : off[k + 1]] for k in own]), m)
                d, ti, st = np.repeat(doc[own], m), np.repeat(tie[own], m), np.repeat(start[own], m) + within
                _, late = _firsts((h, np.repeat(sample[own], m)), d, ti, st)
                out.append((d[late], ti[late], st[late], st[late] + LENGTH))
                i = j
            d, ti, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        again, *rest = _united(d, ti, a, b)
        out = _by_part(ranges, again, *rest)
        return pa.table(dict(zip(["part", "doc", "tie", "a", "b", "sample"], [pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in [*out[1:], [b""] * len(out[0])])], strict=True)))

    return contexts.groupBy("at").applyInArrow(meet, PARTS)


def removed_ranges(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Rows (doc, tie, ranges) from docs (doc long, tie int, text): several rows a document, to be united.

    Packs tell a frequent sample so early that what they send of others stays near ``frequent`` runs a sample.
    """
    digests = cut(docs.select("doc", "tie", F.md5(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").cast("long").alias("bytes")))
    total = digests.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    ranges = 1 + total // RANGE_BYTES
    least = cut(digests.groupBy("digest").agg(F.min("doc").alias("least"), F.count("*").alias("copies")).where("copies > 1"))
    copies = digests.where(F.col("bytes") >= LENGTH).join(least, "digest").where(F.col("doc") > F.col("least"))
    whole = copies.select("doc", "tie", F.lit(bytearray(ALL)).alias("ranges"))
    most = max(min(frequent, 8), 4 * frequent // (1 + total // PACK_BYTES))
    met = cut(repeated_runs(sampled_runs(docs, ranges, most), ranges, frequent))
    wanted = wanted_by_document(met.where(F.octet_length("sample") > 0))
    strings = repeated_strings(run_bytes(docs, wanted, ranges), ranges)
    return whole.unionByName(ranges_by_document(met.where(F.octet_length("sample") == 0).unionByName(strings)))


def remove_repeats(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept binary, kept_sha256), one for each row of docs (doc_id, text).

    ``frequent`` says which way samples go; the results don't depend on it.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.crc32(F.col("text").cast("binary")).bitwiseAND(F.lit(0xFFFFFF)).cast("int"))
    cuts = removed_ranges(rows, frequent).groupBy("doc", "tie").agg(F.collect_list("ranges").alias("ranges"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            data, off = flat(b.column("text"))
            cols: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")}
            for k, blobs in enumerate(b.column("ranges").to_pylist()):
                raw = data[off[k] : off[k + 1]].tobytes()
                if ALL in (blobs or []):
                    blobs = [np.array([0, len(raw)], dtype="<i8").tobytes()]
                r = np.frombuffer(b"".join(blobs or []), dtype="<i8").reshape(-1, 2)
                _, start, end = _join_ranges(np.zeros(len(r), np.int64), r[:, 0], r[:, 1])
                kept = b"".join(raw[a:z] for a, z in zip([0, *end.tolist()], [*start.tolist(), len(raw)], strict=True))
                for name, v in (("n_bytes", len(raw)), ("n_removed", len(raw) - len(kept)), ("n_spans", len(start)), ("kept", kept), ("kept_sha256", hashlib.sha256(kept).hexdigest())):
                    cols[name].append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(cols[n], kind) for n, kind in (("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())))], names=["doc_id", *cols])

    joined = rows.join(cuts, ["doc", "tie"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("kept")


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}

ORACLE_SQL = {
    "op1_suffix_dedup": r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, s, md5(substring(h, 2 * s + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(generate_series(0, n - 100)) AS s FROM d WHERE n >= 100)
), late AS (
  SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1
), marked AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS opens FROM late
), numbered AS (
  SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked
), spans AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS z FROM numbered GROUP BY doc_id, run
), pieces AS (
  SELECT doc_id, z AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM (SELECT * FROM spans UNION ALL SELECT doc_id, -1, 0 FROM d)
), kept AS (
  SELECT d.doc_id, any_value(n) AS n, string_agg(substring(h, 2 * p.a + 1, 2 * (coalesce(p.z, n) - p.a)), '' ORDER BY p.a) AS kept, count(*) - 1 AS n_spans
  FROM d JOIN pieces p ON p.doc_id = d.doc_id GROUP BY d.doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n - length(kept) // 2 AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM kept
"""
}
