"""Benchmark decontamination: prefix-filtered join of document positions with benchmark windows.

A window is ten consecutive words of an item (a shorter item is one window). Containment of a whole window needs every one of its words,
so one necessary word is enough to find it: the rarest by corpus frequency. Document words join that prefix index; position and length
bounds place the window in the document, and the words there are compared exactly. Hit positions are
united per document.

Texts are never shuffled: two scans explode words within a task (frequencies, then candidates), and only matches and word counts move. The
index and the vocabulary are broadcast while they have at most ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes; beyond that words are joined by shuffle, one
by one without their texts, and the candidates meet the texts afterwards.

Everything is DataFrame operations. Defined results: null or empty texts have no words and no hits; null item texts have no
windows; a null item_id can be hit but isn't listed; repeated rows have equal results; an empty table on either side gives
no hits; other columns of the tables aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.plans.checkpoints import cut

WINDOW = 10
#: A table of at most so many rows and bytes is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Separators before A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, not yet lower-cased."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def lowered(text: Column) -> Column:
    """A-Z in lower case, and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Rows (item_id, window, length): the windows of each item, words joined by spaces."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(lowered(F.col("text"))).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("length", F.least(F.size("w"), F.lit(size)))
    starts = items.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)))
    return starts.select("item_id", F.array_join(F.slice("w", F.col("at"), F.col("length")), " ").alias("window"), "length").distinct()


def is_small(df: DataFrame) -> bool:
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    rows, size = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), size).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def sized(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is small enough."""
    return F.broadcast(df) if is_small(df) else df


def prefix_index(docs: DataFrame, distinct_windows: DataFrame) -> DataFrame:
    """Rows (token, at, window, length): each window under its rarest word and that word's place in it."""
    parts = distinct_windows.select("window", "length", F.posexplode(F.split("window", " ")).alias("at", "w")).withColumn("token", F.lower("w"))
    vocabulary = sized(parts.select("token").distinct())
    # full lower-casing joins at least the words that are equal by A-Z alone; the exact comparison comes later
    seen = docs.select(F.explode(words(F.col("text"))).alias("w")).select(F.lower("w").alias("token"))
    counts = seen.join(vocabulary, "token").groupBy("token").agg(F.count("*").alias("n"))
    ranked = parts.join(counts, "token", "left")
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at"))
    return ranked.groupBy("window", "length").agg(best.alias("best")).select(F.col("best.token").alias("token"), F.col("best.at").alias("at"), "window", "length")


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(rows (doc_id, key, start, length, window) of windows found in documents, rows (item_id, window)).

    key tells rows of one doc_id with different texts apart.
    """
    found = windows(benchmark, size)
    index = cut(prefix_index(docs, found.select("window", "length").distinct()))
    keyed = docs.select("doc_id", row_key().alias("key"), words(F.col("text")).alias("words"))
    places = [F.posexplode("words").alias("pos", "w")]
    if is_small(index):
        placed = keyed.select("doc_id", "key", "words", *places).join(F.broadcast(index), F.lower("w") == F.col("token"))
        candidates = placed.withColumn("start", F.col("pos") - F.col("at"))
    else:  # words are moved one by one without their text, and only candidates meet the texts again
        moved = keyed.select("doc_id", "key", *places).join(index, F.lower("w") == F.col("token"))
        asked = moved.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), (F.col("pos") - F.col("at")).alias("start"), "length", "window").distinct()
        candidates = keyed.join(asked, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    candidates = candidates.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.size("words")))
    exact = lowered(F.array_join(F.slice("words", F.col("start") + 1, F.col("length")), " ")) == F.col("window")
    return candidates.where(exact).select("doc_id", "key", "start", "length", "window"), found.select("item_id", "window")


def row_key() -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated, and key."""
    hits, items = occurrences(docs, benchmark, size)
    by_doc = hits.groupBy("doc_id", "key", "window", "length").agg(F.collect_set("start").alias("starts"))
    covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("length") - 1)))
    joined = by_doc.join(sized(items.groupBy("window").agg(F.collect_set("item_id").alias("item_ids"))), "window")
    per_doc = joined.select("doc_id", "key", covered.alias("at"), "item_ids").groupBy("doc_id", "key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("items")
    )
    hit = per_doc.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "n_hit", "items")
    counted = docs.select("doc_id", row_key().alias("key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(hit, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("items"), (n_hit > 0).alias("contaminated"), "key")


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op3_benchmark_decontamination": op3_benchmark_decontamination}

ORACLE_SQL = {
    "op3_benchmark_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
), placed AS (
  SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)
), hit AS (
  SELECT p.doc_id, p.i, p.m, win.item_id FROM placed p JOIN win ON p.win = win.win AND p.m = win.m
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id
"""
}
