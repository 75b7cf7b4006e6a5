"""Best-fit packing of token sequences with bound-certified repacking.

A text's ids are cut to pieces of at most ``capacity`` ids; full pieces are sequences of their own. The other pieces, rows of a
few integers, are packed by best fit decreasing within partitions. Dual-feasible functions give a lower bound of the bins that any packing
of a partition needs; a partition whose count equals its bound is certified and final. A partition with a gap gives back
its emptier bins, and the pieces in them are dealt anew over fewer partitions and packed again, until the last rounds, which see
only what is left of each earlier partition (a few bins of each), or until all are certified.

Tokens are counted once; the piece table goes to the checkpoint folder and all rounds read integers only.

Defined results: a null or empty text is the end id alone; repeated doc_ids are separate documents with pieces of their own; a null doc_id
stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.plans.checkpoints import cut

CAPACITY = 1024
END_ID = 2
#: Pieces that one task packs at a time, about.
PIECES_A_PARTITION = 100_000
#: In each round, partitions shrink by this factor.
SHRINK = 8

#: Fixed value: how the byte-level tokenizer splits a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Texts to ids. The vocabulary file's own tokenizer decides; texts of plain letters and signs take a faster byte-pair
    encoder built from the same vocabulary and merges, which gives the same ids there.

    Texts with characters whose class may differ between Unicode versions, or with a special token's string, go to
    the tokenizer itself, and so does everything if the merges aren't ranked by id.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = regex.compile(r"[\x00-\x1b\x20-\x84\x86-\u024f\u2010-\u2027]*+").fullmatch
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        vocab = model["vocab"]
        first = len(vocab) - len(merges) - sum(s in vocab for s in self.special)
        self.fast = None
        if all(vocab.get(m) == first + i for i, m in enumerate(merges)):
            known = {c: bytes([x]) for x in range(256) for c in [self._sign(x)]}
            ranks = {b"".join(known[c] for c in w): i for w, i in vocab.items() if w not in self.special}
            self.fast = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        assert set(pre_tokenizers.ByteLevel.alphabet()) == {self._sign(x) for x in range(256)}

    @staticmethod
    def _sign(x: int) -> str:
        """The printable sign that stands for a byte in byte-level vocabularies."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return chr(x) if x in shown else chr(256 + sum(y not in shown for y in range(x)))

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special) or not self.plain(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def pieces(docs: DataFrame, tokenizer: str | Callable[[], str], capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32); the first piece of a longer document takes the remainder."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(tokenizer() if callable(tokenizer) else tokenizer)
        for b in batches:
            own, number, start, length, crc = [], [], [], [], []
            for row, text in enumerate(b.column("text")):
                ids = encoder.encode(text.as_py() or "").tobytes() + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    m = min(n, n % capacity or capacity) if k == 0 and n > capacity else min(capacity, n - at)
                    own.append(row), number.append(k), start.append(at), length.append(m), crc.append(zlib.crc32(ids[4 * at : 4 * (at + m)]))
                    at, k = at + m, k + 1
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(own, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of the dual-feasible bounds: counts[s] pieces of size s need at least so many bins.

    For a threshold t up to half the capacity, sizes over capacity - t count a whole bin, sizes under t nothing, and others
    their share; the bound of rounded shares floor((k + 1) s / capacity) / k holds for each k as well.
    """
    size = np.arange(len(counts))
    if not counts.sum():
        return 0
    best = -(-int((counts * size).sum()) // capacity)
    total = np.cumsum((counts * size)[::-1])[::-1]
    number = np.cumsum(counts[::-1])[::-1]
    total, number = np.append(total, [0, 0]), np.append(number, [0, 0])
    for t in range(1, capacity // 2 + 1):
        whole = number[min(capacity - t + 1, len(counts))]
        middle = total[min(t, len(counts))] - total[min(capacity - t + 1, len(counts))]
        best = max(best, int(whole) + max(0, -(-int(middle) // capacity)))
    for k in range(2, 101):
        x = (k + 1) * size
        share = np.where(x % capacity == 0, size * k, (x // capacity) * capacity)
        best = max(best, -(-int((counts * share).sum()) // (k * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Best fit decreasing: bin and offset of each piece, and the number of bins."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # room sizes that some bin has, ascending
    n = 0
    for i in order.tolist():
        s = int(sizes[i])
        at = bisect_left(rooms, s)
        if at == len(rooms):
            b, room, n = n, capacity, n + 1
        else:
            room = rooms[at]
            b = open_at[room].pop()
            if not open_at[room]:
                del rooms[at]
        bins[i], offsets[i] = b, capacity - room
        if room > s:
            if not open_at[room - s]:
                insort(rooms, room - s)
            open_at[room - s].append(b)
    return bins, offsets, n


def _pack(part: int, rows: pd.DataFrame, capacity: int, base: int, last: bool) -> pd.DataFrame:
    """Pack one partition's rows; bins under the mean fill stay open if the bound is missed."""
    sizes = rows["length"].to_numpy()
    bins, offsets, n = best_fit(sizes, capacity)
    counts = np.bincount(sizes, minlength=capacity + 1)
    gap = n - lower_bound(counts, capacity)
    final = np.ones(len(rows), dtype=bool)
    if gap > 0 and not last:
        fill = np.bincount(bins, weights=sizes, minlength=n)
        final = (fill >= capacity)[bins]
    rows = rows.copy()
    rows["sequence_id"], rows["offset"], rows["final"] = base + bins, offsets, final
    return rows


def _round(left: DataFrame, parts: int, number: int, capacity: int, last: bool) -> DataFrame:
    """Deal the open pieces over parts tasks and pack each task's."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = left.select(*names).schema.add("sequence_id", "long").add("offset", "long").add("final", "boolean")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        base = (number << 56) + (part << 32)
        held, rows = [], 0
        for frame in frames:  # a partition is packed in lots, so that memory is bounded
            held.append(frame)
            rows += len(frame)
            if rows >= 4 * PIECES_A_PARTITION:
                yield _pack(part, pd.concat(held), capacity, base, last)[[f.name for f in schema.fields]]
                held, rows, base = [], 0, base + (1 << 24)
        if held:
            yield _pack(part, pd.concat(held), capacity, base, last)[[f.name for f in schema.fields]]

    spread = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32", F.lit(number))
    return left.select(*names).repartition(parts, spread).mapInPandas(run, schema)


def pack(docs: DataFrame, tokenizer: str | Callable[[], str], capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one a piece.

    tokenizer is a vocabulary file's path, or a function that finds it on the machine that it is called on.
    """
    left = cut(pieces(docs, tokenizer, capacity, end_id).withColumn("row", F.monotonically_increasing_id()))
    whole = left.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")}).drop("row")
    left = left.where(F.col("length") < capacity).drop("row")
    out, number = [whole], 0
    n = left.count()
    while n:
        parts = max(1, n // PIECES_A_PARTITION)
        last = number >= 1 and parts == 1
        packed = cut(_round(left, parts, number, capacity, last))
        out.append(packed.where("final").drop("final"))
        left = packed.where(~F.col("final"))
        before, n = n, left.count()
        number += 1
        if not last and n > before // 2:  # nothing much was certified: these pieces can't be packed tighter by dealing anew
            packed = cut(_round(left, max(1, n // PIECES_A_PARTITION), number, capacity, True))
            out.append(packed.where("final").drop("final"))
            break
        if last:
            break
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_vocabulary)


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
