"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Every text is a bag of hashed byte n-grams. Two smoothed multinomials over the same buckets, one counted on the
documents that ``labels`` marks as good and one on all documents, give each bucket a log ratio; a text's score
is the mean ratio over its n-grams, so length doesn't count, and a fixed threshold decides about every text.

All good labels count. They grow with the corpus, so texts and labels meet by a shuffle, whatever their sizes; only ids are held in memory.
Tasks count in numpy, Spark sums the buckets. The table of ratios has ``BUCKETS`` entries whatever
the corpus holds, so it may be sent to the tasks. The scan that scores has no shuffle.

Defined results: a null or empty text has no words, so ``base_failed`` is true and ``kept`` false; a text shorter than an
n-gram scores 0; repeated rows are judged alike; without any trusted text all scores are 0; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import IS_SPACE, SMALL_SLICE, flat, gram_hash, per_doc, slices, span_hash, spans

GRAM = 4
BUCKETS = 1 << 16
#: Mean log ratio below which a text is rejected.
THRESHOLD = -0.2
WINDOW = 8

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def _buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte but the last GRAM - 1."""
    m = len(data) - GRAM + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    h = np.zeros(m, dtype=np.uint32)
    for j in range(GRAM):
        h = (h << np.uint32(8)) | data[j : j + m]
    return ((h * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _inside(off: np.ndarray, m: int) -> np.ndarray:
    """Which n-grams lie in one document."""
    ok = np.ones(m, dtype=bool)
    for j in range(1, GRAM):
        at = off - j
        ok[at[(at >= 0) & (at < m)]] = False
    return ok


def count_grams(docs: DataFrame, flag: str = "trusted") -> DataFrame:
    """Rows (bucket, raw, target): n-grams of all texts and of those with the flag, one row a bucket that occurs."""

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            data, off = flat(b.column("text"))
            marked = np.asarray(b.column(flag).fill_null(False))
            for i, j in slices(off, SMALL_SLICE):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                h = _buckets(d)
                ok = _inside(o, len(h))
                raw += np.bincount(h[ok], minlength=BUCKETS)
                ok &= np.repeat(marked[i:j], np.diff(o))[: len(h)]
                target += np.bincount(h[ok], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, raw[seen], target[seen])], names=["bucket", "raw", "target"])

    counted = docs.select("text", flag).mapInArrow(count, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """The log ratio of each bucket; at most BUCKETS rows come to the driver."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(BUCKETS)
    # a bucket's prior follows the raw corpus, so unseen buckets are neutral and the weight of the prior is small
    prior = (raw + 1) / (raw.sum() + BUCKETS)
    weight = 0.001 * target.sum()
    return np.log((target + weight * prior) / (target.sum() + weight)) - np.log(prior)


def mark_trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (text, trusted): every text of docs, and whether labels has its doc_id as good. Rows without a doc_id need no partner and aren't shuffled."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    named = docs.where("doc_id is not null").select("doc_id", "text").join(good.hint("shuffle_hash"), "doc_id", "left").select("text", "trusted")
    return named.unionByName(docs.where("doc_id is null").select("text", F.lit(False).alias("trusted")))


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The contract's counts for each text of a slice."""
    n = len(off) - 1
    in_word = ~IS_SPACE[data]
    start, end, first = spans(in_word, off)
    n_words = np.diff(first)
    dup = np.zeros(n, np.int64)
    raw = data.tobytes()
    for i in range(n):
        lines = raw[off[i] : off[i + 1]].split(b"\n")
        if len(lines) > 1:
            lines = [x for x in lines if x.strip()]
            dup[i] = len(lines) - len(set(lines))
    repeat = np.zeros(n, np.int64)
    if len(start) >= WINDOW:
        doc = np.repeat(np.arange(n), n_words)
        g = gram_hash(span_hash(data, start, end), WINDOW)
        ok = np.flatnonzero(doc[: len(g)] == doc[WINDOW - 1 :])
        if len(ok):
            key = g[ok] + doc[ok].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(ok), dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(len(start) + 1, np.int64)
            at = ok[twice]
            edge[at] += 1
            np.add.at(edge, at + WINDOW, -1)
            repeat = per_doc((np.cumsum(edge[:-1]) > 0).astype(np.int64), first)
    return {
        "n_words": n_words,
        "word_chars": per_doc((in_word & ((data & 0xC0) != 0x80)).astype(np.int64), off),
        "n_symbols": per_doc(_SYMBOL[data], off),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with the counts, llr, base_failed and kept (columns of these names are replaced)."""
    from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

    new = [*COUNTS, "llr", "base_failed", "kept"]
    rest = [c for c in docs.columns if c not in new]
    docs = docs.select(*rest)
    schema = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in COUNTS), StructField("llr", DoubleType()), StructField("base_failed", BooleanType()), StructField("kept", BooleanType())])
    context = docs.sparkSession.sparkContext
    table = context.broadcast(ratios)

    def score(batches):
        ratio = table.value
        for b in batches:
            data, off = flat(b.column("text"))
            for i, j in slices(off, SMALL_SLICE):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                base = base_counts(d, o)
                h = _buckets(d)
                value = np.zeros(len(d))
                ok = _inside(o, len(h))
                value[: len(h)][ok] = ratio[h[ok]]
                grams = np.maximum(np.diff(o) - GRAM + 1, 0)
                llr = np.where(grams > 0, per_doc(value, o) / np.maximum(grams, 1), 0.0)
                failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
                kept = ~failed & (np.round(llr, 9) >= threshold)
                own = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(base[c]) for c in COUNTS), pa.array(llr), pa.array(failed), pa.array(kept)], names=[*own.schema.names, *new])

    return docs.mapInArrow(score, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, score and verdict for every row of ``docs`` (doc_id, text, ...)."""
    return judge(docs, log_ratios(count_grams(mark_trusted(docs, labels))), threshold)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")


def quality_rule_counts(spark, sf_dir: str) -> DataFrame:
    """The columns of op5_quality_rules that don't depend on the likelihood ratio."""
    return op5_quality_rules(spark, sf_dir).select("doc_id", *COUNTS, "base_failed")


QUERIES = {"op5_quality_rules": op5_quality_rules, "quality_rule_counts": quality_rule_counts}

ORACLE_SQL = {
    "quality_rule_counts": r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), win AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS win FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)
), twice AS (
  SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, win) > 1
), repeats AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(generate_series(i, i + 7)) AS p FROM twice) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(w) AS base_failed
FROM d LEFT JOIN lines ON d.r = lines.r LEFT JOIN repeats ON d.r = repeats.r
"""
}
