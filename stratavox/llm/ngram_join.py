"""N-gram Jaccard join by signature trees.

Texts become sets of distinct word n-grams. Equal sets are one class from the start, so copies cost nothing further. Candidate
buckets come from the necessary prefix of each class: a partner that reaches the threshold shares one of its
``n - ceil(t n) + 1`` rarest n-grams. How many classes have an n-gram is counted over the whole corpus; n-grams of one class open the prefix
and make no bucket, so few classes are left. Buckets with the same members are merged.

In a bucket, classes sorted by size are the leaves of a signature tree whose nodes hold OR-combined bitmaps and size ranges. Pairs of nodes
are walked from the roots down and dropped when their sizes, or the greatest overlap that their bitmaps allow, can't reach the
threshold, or when all below is linked already; what is left is compared by whole sets. A bucket of more than ``BLOCK`` classes is
split by size into blocks, and each pair of blocks with matching sizes is a task's work of its own, so no task holds an unbounded group.

First each class is looked at in one bucket only; then, once linked classes are components, buckets within one component are dropped and
the others are walked whole. Every link between different texts is found or implied by others. The first walk looks only at neighbouring blocks, so its work is linear in a bucket's
size; the second leaves out pairs of blocks that are one component already.

Words and n-grams are compared by 64-bit hashes. While n-grams are counted and buckets made, the lower 48 bits stand for them, which can only add candidates.
n-grams travel from the counting scan packed, grouped by class, in binary rows by hash range. Classes are named by a 64-bit sum over their n-grams.

Defined results: a null or empty text, or one without words, has an empty set and links with nothing; a text with fewer words than an
n-gram is one n-gram of all its words; rows that share a doc_id are one document with several texts, which joins their classes;
a null doc_id takes the least doc_id of its component, or null; texts without a doc_id link others like any text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavox.plans.checkpoints import cut
from stratavox.plans.graph import connected_components
from stratavox.plans.skew import attach
from .textbatch import IS_SPACE, SMALL_SLICE, flat, gram_hash, mix, slices, span_hash, spans

WIDTH, PERCENT = 4, 85
#: Classes of a block of a bucket, n-grams of a block of that many classes (a larger class is a block of its own), and about how many n-grams one range of hashes has.
BLOCK, BLOCK_GRAMS, RANGE_GRAMS = 1000, 2_000_000, 2_000_000
#: Bytes of text that the counting scan packs together.
PACK_BYTES = 10 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_sets(data: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text of a slice."""
    data = _LOWER[data]
    start, end, first = spans(~IS_SPACE[data], off)
    words = span_hash(data, start, end)
    grams = gram_hash(words, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            x = np.sort(grams[a : b - width + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif b > a:
            out.append(mix(gram_hash(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(grams[:0])
    return out


def six_bytes(grams: np.ndarray) -> bytes:
    """48-bit hashes in six bytes each."""
    return np.ascontiguousarray(grams.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def class_key(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set, as signed longs."""
    keys = np.array([mix(grams).sum(dtype=np.uint64), mix(grams * _ODD + np.uint64(1)).sum(dtype=np.uint64)], dtype=np.uint64)
    return tuple(keys.view(np.int64).tolist())


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, off = flat(batch.column("text"))
    for i, j in slices(off, SMALL_SLICE):
        yield i, j, gram_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], width)


def keyed(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, t, n, f1, f2): the text's hash, and the set's size and key, for each row of docs (doc_id, t, text)."""

    def run(batches):
        for b in batches:
            for i, j, sets in _sets(b, width):
                keys = np.array([class_key(x) for x in sets], dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("t").slice(i, j - i), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["doc_id", "t", "n", "f1", "f2"])

    return docs.mapInArrow(run, "doc_id long, t long, n long, f1 long, f2 long")


# Packed n-grams: each row has a key (a range of hashes, or of classes) and, grouped by class, the class keys, sizes, counts and hashes.

PACKED = "at long, f binary, n binary, count binary, hash binary, df binary"


def _pack(at: np.ndarray, f: np.ndarray, n: np.ndarray, h: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
    """One row for each value of at, n-grams grouped by class in it."""
    order = np.lexsort((f, at))
    at, f, n, h, df = at[order], f[order], n[order], h[order], df[order]
    cols = {k: [] for k in ("at", "f", "n", "count", "hash", "df")}
    edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]) if len(at) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        own = np.flatnonzero(np.r_[True, f[a + 1 : b] != f[a : b - 1], True])
        cols["at"].append(int(at[a]))
        cols["f"].append(f[a:b][own[:-1]].tobytes())
        cols["n"].append(n[a:b][own[:-1]].astype("<u4").tobytes())
        cols["count"].append(np.diff(own).astype("<u4").tobytes())
        cols["hash"].append(six_bytes(h[a:b]))
        cols["df"].append(df[a:b].astype("<u2").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(cols["at"], pa.int64()), *(pa.array(cols[k], pa.binary()) for k in ("f", "n", "count", "hash", "df"))], names=list(cols))


def _unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    join = lambda k, kind: np.frombuffer(b"".join(t.column(k).to_pylist()), dtype=kind)
    count = join("count", "<u4").astype(np.int64)
    return np.repeat(join("f", "<u8"), count), np.repeat(join("n", "<u4"), count), from_six_bytes(b"".join(t.column("hash").to_pylist())), join("df", "<u2")


def packed_grams(docs: DataFrame, width: int, ranges: int) -> DataFrame:
    """The n-grams of all texts by range of hashes; copies within a pack go once."""

    def run(batches):
        held, size, known = [], 0, set()

        def out():
            n = np.array([len(x) for _, x in held])
            f = np.repeat(np.array([k for k, _ in held], dtype=np.int64).view(np.uint64), n)
            h = np.concatenate([x for _, x in held])
            held.clear()
            packed = _pack((h % np.uint64(ranges)).astype(np.int64), f, np.repeat(n.astype("<u4"), n), h, np.zeros(len(h), "<u2"))
            return packed.set_column(5, "df", pa.array([b""] * packed.num_rows, pa.binary()))

        for b in batches:
            for _, _, sets in _sets(b, width):
                for x in sets:
                    if len(x):
                        key = class_key(x)
                        if key not in known:
                            known.add(key)
                            held.append((key[0], x))
                            size += 8 * len(x)
                if size >= PACK_BYTES:
                    yield out()
                    held, size, known = [], 0, set()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, PACKED)


def shared_grams(packed: DataFrame, parts: int) -> DataFrame:
    """The n-grams that several classes have, with the number of classes, packed by range of classes."""

    def count(t: pa.Table) -> pa.Table:
        f, n, h, _ = _unpack(t)
        order = np.lexsort((f, h))
        f, n, h = f[order], n[order], h[order]
        once = np.r_[True, (h[1:] != h[:-1]) | (f[1:] != f[:-1])]
        f, n, h = f[once], n[once], h[once]
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
        df = np.repeat(np.minimum(np.diff(edge), 65535).astype("<u2"), np.diff(edge))
        keep = df > 1
        f, n, h, df = f[keep], n[keep], h[keep], df[keep]
        return pa.Table.from_batches([_pack((f % np.uint64(parts)).astype(np.int64), f, n, h, df)])

    return packed.groupBy("at").applyInArrow(count, PACKED)


def prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """Rows (s, f, n): the shared n-grams among each class's necessary prefix, rarest first."""

    def choose(t: pa.Table) -> pa.Table:
        f, n, h, df = _unpack(t)
        order = np.lexsort((h, df, f))
        f, n, h = f[order], n[order].astype(np.int64), h[order]
        edge = np.flatnonzero(np.r_[True, f[1:] != f[:-1], True])
        own = np.diff(edge)
        rank = np.arange(len(f)) - np.repeat(edge[:-1], own)
        alone = n - np.repeat(own, own)  # n-grams that no other class has come first
        keep = alone + rank < n + (-percent * n // 100) + 1
        return pa.table({"s": h[keep].view(np.int64), "f": f[keep].view(np.int64), "n": n[keep]})

    return shared.groupBy("at").applyInArrow(choose, "s long, f long, n long")


# Signature trees


def bitmap(grams: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 64, dtype=np.uint64)
    b = (grams % np.uint64(bits)).astype(np.int64)
    np.bitwise_or.at(out, b >> 6, np.uint64(1) << (b & 63).astype(np.uint64))
    return out


def width_of(n: int, times: int) -> int:
    """Bits of a bitmap for n n-grams: a power of two, at least times as many."""
    return 1 << max(8, math.ceil(math.log2(max(1, times * n))))


def folded(maps: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps (one a row) brought to fewer bits."""
    return np.bitwise_or.reduce(maps.reshape(len(maps), -1, bits // 64), axis=1)


class Tree:
    """Classes sorted by size; each level ORs the bitmaps of FAN nodes below and keeps their size range."""

    FAN = 8

    def __init__(self, sizes: np.ndarray, maps: np.ndarray):
        self.sizes = sizes
        slack = sizes - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, slack)]
        while len(self.levels[-1][0]) > 1:
            m, least, most, slack = self.levels[-1]
            cuts = np.arange(0, len(m), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(m, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts), np.maximum.reduceat(slack, cuts)))

    def below(self, level: int, k: int) -> np.ndarray:
        return np.arange(k * self.FAN, min((k + 1) * self.FAN, len(self.levels[level - 1][0])))

    def leaves(self, level: int, k: int) -> tuple[int, int]:
        w = self.FAN**level
        return k * w, min((k + 1) * w, len(self.sizes))


def _may_link(a: Tree, la: int, i: np.ndarray, b: Tree, lb: int, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes can hold a pair of classes that reaches the threshold, [i, j]."""
    ma, min_a, max_a, slack_a = (x[i] for x in a.levels[la])
    mb, min_b, max_b, slack_b = (x[j] for x in b.levels[lb])
    common = np.bitwise_count(ma[:, None] & mb[None]).sum(2).astype(np.int64) + np.minimum(slack_a[:, None], slack_b[None])
    most = np.minimum(common, np.minimum(max_a[:, None], max_b[None]))
    fits = (100 * max_b[None] >= percent * min_a[:, None]) & (100 * max_a[:, None] >= percent * min_b[None])
    return fits & ((100 + percent) * most >= percent * (min_a[:, None] + min_b[None]))


def walk(ta: Tree, tb: Tree, percent: int, done, meet) -> None:
    """Visits the pairs of leaves that may link, within one tree (tb is ta) or between two.

    done(a0, a1, b0, b1) tells that nothing is to be found between leaves a0 to a1 and b0 to b1; meet(i, j) gets each pair left.
    """
    stack = [(len(ta.levels) - 1, 0, len(tb.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        if done(*ta.leaves(la, i), *tb.leaves(lb, j)):
            continue
        if la == 0 and lb == 0:
            meet(i, j)
            continue
        down_a, down_b = la >= lb and la > 0, lb >= la and lb > 0
        ia = ta.below(la, i) if down_a else np.array([i])
        jb = tb.below(lb, j) if down_b else np.array([j])
        ok = _may_link(ta, la - down_a, ia, tb, lb - down_b, jb, percent)
        if tb is ta and la == lb and i == j and down_a:
            ok &= (ia[:, None] < jb[None]) if la == 1 else (ia[:, None] <= jb[None])
        stack += [(la - down_a, int(ia[p]), lb - down_b, int(jb[q])) for p, q in zip(*np.nonzero(ok), strict=True)]


def links(a: list[np.ndarray], label_a: np.ndarray, b: list[np.ndarray] | None, label_b: np.ndarray | None, percent: int) -> np.ndarray:
    """Labels after all links within a (b None) or between a and b are united; sets must be sorted by size."""
    both = [*a, *(b or [])]
    labels = np.concatenate([label_a, label_b]) if b else label_a.copy()
    bits = width_of(max(len(x) for x in both), 4)
    tree = lambda sets: Tree(np.array([len(x) for x in sets]), np.stack([bitmap(x, bits) for x in sets]))
    ta = tree(a)
    tb, shift = (tree(b), len(a)) if b else (ta, 0)

    def done(a0, a1, b0, b1):
        here = labels[a0:a1]
        return (here == here[0]).all() and (labels[b0 + shift : b1 + shift] == here[0]).all()

    def meet(i, j):
        x, y = both[i], both[j + shift]
        small, large = (x, y) if len(x) < len(y) else (y, x)
        at = np.searchsorted(large, small)
        common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
        if 100 * common >= percent * (len(x) + len(y) - common):
            p, q = labels[i], labels[j + shift]
            labels[labels == max(p, q)] = min(p, q)

    walk(ta, tb, percent, done, meet)
    return labels


def candidates(sizes: np.ndarray, maps: list[np.ndarray], labels: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Which classes may link with one of another label (and, if there are two sides, of the other side), by bitmaps alone.

    There is a tree for each width of bitmaps; between widths the larger is folded.
    """
    found = np.zeros(len(sizes), dtype=bool)
    groups = {}
    for k in np.lexsort((sizes, side)):
        groups.setdefault((int(side[k]), 64 * len(maps[k])), []).append(int(k))
    keys = sorted(groups)
    two = len({s for s, _ in keys}) == 2
    for p, ka in enumerate(keys):
        for kb in keys[p:]:
            if two and ka[0] == kb[0]:
                continue
            bits, own, other = min(ka[1], kb[1]), np.array(groups[ka]), np.array(groups[kb])
            ta = Tree(sizes[own], folded(np.stack([maps[k] for k in own]), bits))
            tb = ta if ka == kb else Tree(sizes[other], folded(np.stack([maps[k] for k in other]), bits))

            def done(a0, a1, b0, b1, own=own, other=other):
                x, y = own[a0:a1], other[b0:b1]
                return (found[x].all() and found[y].all()) or ((labels[x] == labels[x[0]]).all() and (labels[y] == labels[x[0]]).all())

            def meet(i, j, own=own, other=other):
                found[[own[i], other[j]]] = True

            walk(ta, tb, percent, done, meet)
    return found


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows (g, n, f, ...) with their block b: ascending by size n within a bucket g, of about BLOCK rows, or fewer if they have over BLOCK_GRAMS n-grams.

    Places come from counts by bucket and size; rows of one size are dealt to blocks by hash, so no task sorts a bucket.
    """
    room = max(1, BLOCK_GRAMS // BLOCK)  # of a class in a full block of small ones
    weight = F.greatest(F.col("n").cast("long"), F.lit(room))
    before = Window.partitionBy("g").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    cells = cut(rows.groupBy("g", "n").agg(F.count("*").alias("own")).withColumn("start", F.coalesce(F.sum(F.col("own") * weight).over(before), F.lit(0))))
    placed = attach(rows, cells, ["g", "n"], "own")
    return placed.withColumn("b", F.floor(F.col("start") / (BLOCK * room)) + F.pmod(F.xxhash64("f"), F.ceil(F.col("own") * weight / (BLOCK * room)))).drop("own", "start")


def walk_buckets(rows: DataFrame, store: DataFrame, percent: int, all_blocks: bool) -> DataFrame:
    """Edges (u, v) between components, from rows (g, f, label, n), a cut; store has (f, bitmap, grams).

    Buckets of more than one block become pairs of blocks of sizes that can match: each with itself and the next, or all that aren't one component.
    Bitmaps alone go to every bucket first; whole sets follow only for the classes that may have a partner there.
    """
    blocked = cut(in_blocks(rows))
    ranges = cut(blocked.groupBy("g", "b").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("label").alias("lo"), F.max("label").alias("hi")))
    other = ranges.select("g", *(F.col(c).alias(f"{c}2") for c in ("b", "least", "lo", "hi")))
    if all_blocks:
        met = ranges.join(other, "g").where("b <= b2 and not (lo = hi and lo2 = hi2 and lo = lo2)")
    else:
        met = ranges.withColumn("b2", F.explode(F.array("b", F.col("b") + 1))).join(other, ["g", "b2"])
    pairs = cut(met.where(100 * F.col("most") >= percent * F.col("least2")).select("g", F.col("b").alias("b1"), "b2"))
    first = blocked.join(pairs.withColumn("b", F.col("b1")), ["g", "b"]).withColumn("side", F.lit(0))
    second = blocked.join(pairs.where("b1 < b2").withColumn("b", F.col("b2")), ["g", "b"]).withColumn("side", F.lit(1))
    task = first.unionByName(second).select("g", "b1", "b2", "side", "f", "label", "n")

    def sift(t: pa.Table) -> pa.Table:
        size, label, side = (np.asarray(t.column(k).combine_chunks()) for k in ("n", "label", "side"))
        maps = [np.frombuffer(x, dtype="<u8") for x in t.column("bitmap").to_pylist()]
        return t.filter(pa.array(candidates(size, maps, label, side, percent))).select(["g", "b1", "b2", "side", "f", "label"])

    marked = task.join(store.select("f", "bitmap"), "f")
    task = marked.groupBy("g", "b1", "b2").applyInArrow(sift, "g long, b1 long, b2 long, side int, f long, label long").join(store.select("f", "grams"), "f")

    def run(t: pa.Table) -> pa.Table:
        side, f, label = (np.asarray(t.column(k).combine_chunks()) for k in ("side", "f", "label"))
        sets = [np.frombuffer(x, dtype="<u8") for x in t.column("grams").to_pylist()]
        order = sorted(range(len(sets)), key=lambda k: (side[k], len(sets[k]), f[k]))
        left, right = [k for k in order if side[k] == 0], [k for k in order if side[k] == 1]
        done = left + right
        if len(done) < 2:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        old = label[done]
        new = links([sets[k] for k in left], label[left], [sets[k] for k in right] or None, label[right] if right else None, percent)
        edges = np.unique(np.column_stack([old, new])[old != new], axis=0)
        return pa.table({"u": pa.array(edges[:, 0], pa.int64()), "v": pa.array(edges[:, 1], pa.int64())})

    return task.groupBy("g", "b1", "b2").applyInArrow(run, "u long, v long")


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of docs (doc_id long, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    keys = cut(keyed(docs, width))
    # a class is named by f; one of its texts stands for it, found by hash and doc_id (which may be null)
    classes = cut(keys.where("n > 0").groupBy(F.col("f1").alias("f"), "f2", "n").agg(F.min("doc_id").alias("least"), F.min(F.struct("t", "doc_id")).alias("own")))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = shared_grams(packed_grams(docs, width, 1 + total // RANGE_GRAMS), 1 + total // RANGE_GRAMS)
    prefix = cut(prefixes(shared, percent))
    member = lambda salt: F.bit_xor(F.xxhash64("f", F.lit(salt)))
    grams = prefix.groupBy("s").agg(member(1).alias("one"), member(2).alias("two"), F.count("*").alias("c")).where("c > 1")
    grams = cut(grams.select("s", F.xxhash64("one", "two", "c").alias("g"), "c"))  # buckets with the same members are one
    rows = cut(attach(prefix, grams, ["s"], "c").select("g", "c", "f", "n").distinct())
    wanted = rows.select("f").distinct().join(classes, "f").select("f", "f2", F.col("own.t").alias("own_t"), F.col("own.doc_id").alias("own_id"))

    def gather(batches):
        for b in batches:
            at, f = 0, np.asarray(b.column("f"))
            f2 = np.asarray(b.column("f2"))
            for _, _, sets in _sets(b, width):
                hit = [k for k, x in enumerate(sets) if class_key(x) == (f[at + k], f2[at + k])]
                rows_at = pa.array([at + k for k in hit], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("f").take(rows_at), pa.array([bitmap(sets[k], width_of(len(sets[k]), 2)).tobytes() for k in hit], pa.binary()), pa.array([sets[k].astype("<u8").tobytes() for k in hit], pa.binary())], names=["f", "bitmap", "grams"])
                at += len(sets)

    texts = docs.join(wanted, (F.col("t") == F.col("own_t")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).select("f", "f2", "text")
    store = cut(texts.mapInArrow(gather, "f long, bitmap binary, grams binary").dropDuplicates(["f"]))

    several = cut(keys.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("f1").alias("u"), F.max("f1").alias("most")).where("u < most").select("doc_id", "u"))
    same_doc = keys.where("n > 0").join(several, "doc_id").select("u", F.col("f1").alias("v")).where("u <> v").distinct()  # a doc_id of several classes
    largest = rows.join(rows.groupBy("f").agg(F.max_by("g", F.struct("c", "g")).alias("g")), ["f", "g"])
    edges = cut(walk_buckets(cut(largest.select("g", "f", "n", F.col("f").alias("label"))), store, percent, False).unionByName(same_doc))
    labels = cut(connected_components(edges))

    labelled = cut(rows.join(labels, F.col("f") == F.col("node"), "left").select("g", "f", "n", F.coalesce("component", "f").alias("label")))
    open_buckets = cut(labelled.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("own")).where("lo < hi").select("g", "own"))
    more = cut(walk_buckets(cut(attach(labelled, open_buckets, ["g"], "own").drop("own")), store, percent, True))
    labels = cut(connected_components(edges.unionByName(more)))

    named = cut(classes.join(labels, F.col("f") == F.col("node"), "left").select(F.col("f").alias("f1"), "f2", "n", "least", F.coalesce("component", "f").alias("label")))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = cut(named.join(least, "label").select("f1", "f2", "n", "component_id"))
    out = keys.join(of_class, ["f1", "f2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_ngram_jaccard_join": op9_ngram_jaccard_join}

ORACLE_SQL = {
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 4) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(len(w), 4) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id
"""
}
