"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives ``len(NAMES)`` statistics, transformed to bounded or logarithmic scales. Spark sums moments by class over
labelled rows; each class covariance is shrunk towards the pooled one and towards its diagonal, factored once by Cholesky, and every
text is scored by the difference of the two Mahalanobis log densities plus the log prior ratio.

Only the labelled rows for fitting are sampled, to about ``FIT_ROWS`` by a hash of the id; the model is a few hundred numbers. Scoring
is one scan without a shuffle.

Defined results: a null or empty text scores like any other from its statistics (zeros); a null doc_id counts as empty text for the
remainder; repeated rows score alike; where a class has no labelled rows every score is that of the prior (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .checksums import crc32_sql
from .quality_rules import base_counts
from .textbatch import IS_SPACE, flat, per_doc, slices, span_hash, spans

NAMES = [
    "log_words", "word_length", "word_length_sd", "symbols", "digits", "capitals", "marks", "bars", "stops_per_word",
    "echoes", "distinct", "repeats", "dup_lines", "short_words", "line_words", "non_ascii",
]
FIT_ROWS = 100_000
#: Weight of the pooled covariance, and then of the diagonal, in each class covariance.
POOLED, DIAGONAL = 0.1, 0.1
#: Added to each variance.
FLOOR = 2e-3
#: Added to the denominators of shares, so that short texts vary less.
PRIOR_CHARS, PRIOR_WORDS, PRIOR_LINES = 100, 20, 4
HELD_OUT, FOLDS = 2, 4

_KIND = {k: np.zeros(256, dtype=np.int64) for k in ("digit", "upper", "symbol", "mark", "bar", "stop")}
for _k, _s in (("digit", b"0123456789"), ("upper", bytes(range(65, 91))), ("symbol", b"#*$%&<>=~^_@{}[]\\"), ("mark", b"!?"), ("bar", b"|"), ("stop", b".,;:")):
    _KIND[_k][list(_s)] = 1


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each text."""
    base = base_counts(data, off)
    start, end, first = spans(~IS_SPACE[data], off)
    n_words = base["n_words"]
    words, chars = np.maximum(n_words, 1), np.maximum(base["word_chars"], 1)
    length = (end - start).astype(float)
    mean = per_doc(length, first) / words
    sd = np.sqrt(np.maximum(per_doc(length**2, first) / words - mean**2, 0))
    h = span_hash(data, start, end)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    echo = np.zeros(len(h))
    echo[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    by_doc = np.lexsort((h, doc))
    new = np.ones(len(h))
    new[1:] = (h[by_doc][1:] != h[by_doc][:-1]) | (doc[by_doc][1:] != doc[by_doc][:-1])
    share = lambda k: per_doc(_KIND[k][data], off) / (chars + PRIOR_CHARS)
    lines = per_doc((data == 10).astype(np.int64), off) + 1
    return np.column_stack([
        np.log1p(n_words), np.log1p(mean), np.log1p(sd), np.sqrt(share("symbol")), np.sqrt(share("digit")), np.sqrt(share("upper")),
        np.sqrt(share("mark")), np.sqrt(share("bar")), per_doc(_KIND["stop"][data], off) / words, np.sqrt(per_doc(echo, first) / (n_words + PRIOR_WORDS)),
        (per_doc(new, first) + PRIOR_WORDS) / (n_words + PRIOR_WORDS), base["n_repeat_words"] / (n_words + 2 * PRIOR_WORDS), base["n_dup_lines"] / (lines + PRIOR_LINES),
        per_doc((length <= 3).astype(float), first) / words, np.log1p(n_words / lines), per_doc((data >= 0xC0).astype(np.int64), off) / chars,
    ])


def moments(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of products by class of the rows (text, quality); two rows of moments come to the driver."""
    d = len(NAMES)

    def gather(batches):
        n, s, ss = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            data, off = flat(b.column("text"))
            y = np.asarray(b.column("quality")).astype(int)
            for i, j in slices(off):
                x = statistics(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for k in (0, 1):
                    own = x[y[i:j] == k]
                    n[k] += len(own)
                    s[k] += own.sum(0)
                    ss[k] += own.T @ own
        flat_all = np.concatenate([n, s.ravel(), ss.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat_all))), pa.array(flat_all)], names=["at", "value"])

    rows = docs.select("text", "quality").mapInArrow(gather, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(2 + 2 * d + 2 * d * d)
    for r in rows:
        out[r["at"]] = r["value"]
    return out[:2], out[2 : 2 + 2 * d].reshape(2, d), out[2 + 2 * d :].reshape(2, d, d)


def fit(n: np.ndarray, s: np.ndarray, ss: np.ndarray) -> dict:
    """Means, inverse Cholesky factors, log determinants and log priors."""
    if n.min() < 2:
        return {"prior": float((n[1] + 0.5) / (n.sum() + 1)) if n.sum() else 0.5}
    d = s.shape[1]
    mean = s / n[:, None]
    cov = [ss[k] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    factors, logdet = [], []
    for k in (0, 1):
        c = (1 - POOLED) * cov[k] + POOLED * pooled
        c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(c)) + FLOOR * np.eye(d)
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(lower))
        logdet.append(2 * np.log(np.diag(lower)).sum())
    return {"mean": mean, "factor": factors, "logdet": logdet, "log_prior": np.log(n / n.sum())}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """The probability of class 1, rounded to 6 digits."""
    if "prior" in model:
        return np.full(len(x), round(model["prior"], 6))
    logp = [-0.5 * ((((x - model["mean"][k]) @ model["factor"][k].T) ** 2).sum(1) + model["logdet"][k]) + model["log_prior"][k] for k in (0, 1)]
    return np.round(1 / (1 + np.exp(np.clip(logp[0] - logp[1], -500, 500))), 6)


def remainder(col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> dict:
    """The model from labelled rows outside the held-out fold, about ``most`` of them."""
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder() != HELD_OUT)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return fit(*moments(docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")))


def classify(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """The rows of docs with held_out, score and predicted (columns of these names are replaced)."""
    docs = docs.select(*(c for c in docs.columns if c not in ("score", "held_out", "predicted")))
    cached = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            data, off = flat(b.column("text"))
            for i, j in slices(off):
                own = b.slice(i, j - i)
                p = score(cached.value, statistics(data[off[i] : off[j]], off[i : j + 1] - off[i]))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(p)], names=[*own.schema.names, "score"])

    scored = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
    return scored.withColumns({"held_out": remainder() == HELD_OUT, "predicted": (F.col("score") >= threshold).cast("int")})


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select("doc_id", "held_out", "score", "predicted")


def quality_folds(spark, sf_dir: str) -> DataFrame:
    """Which rows op7_quality_classifier holds out."""
    return op7_quality_classifier(spark, sf_dir).select("doc_id", "held_out")


QUERIES = {"op7_quality_classifier": op7_quality_classifier, "quality_folds": quality_folds}

ORACLE_SQL = {"quality_folds": f"SELECT doc_id, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % {FOLDS} = {HELD_OUT} AS held_out FROM documents"}
