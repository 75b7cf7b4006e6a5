"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of docs.

Nulls and repeats: a text that is null or empty fails the quality rules. Rows that share a doc_id are one document and stay or go
together; rows without a doc_id can't be named by a link and pass the second stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm import decontaminate, ngram_join, packing, pii, quality_rules
from stratavox.plans import checkpoints


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratios = quality_rules.log_ratios(quality_rules.count_grams(quality_rules.mark_trusted(docs, labels)))
    named = docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c != "text"})
    kept = quality_rules.judge(named, ratios).where("kept")
    return kept.select(*(F.col("text") if c == "text" else F.col(f"own_{c}").alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingles of five words and a similarity of 0.8, the document with the smallest doc_id stays."""
    found = ngram_join.components(docs, width=5, percent=80)
    gone = checkpoints.cut(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    hits, _ = decontaminate.occurrences(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = checkpoints.cut(hits.select(F.col("key").alias("__key")).distinct())
    return docs.join(decontaminate.sized(bad), decontaminate.row_key() == F.col("__key"), "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in angle brackets."""
    named = docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c != "text"})
    masked = pii.find_pii(named, mask=True).select(*(F.col("text") if c == "text" else F.col(f"own_{c}").alias(c) for c in docs.columns))
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.public_vocabulary)


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: The personal data and packing stages aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoints.folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
