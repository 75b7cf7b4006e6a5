"""Lineage cuts: tables written to the folder that the session names in spark.checkpoint.dir, and read from there.

Tables keep their sizes, so later joins are planned by them. A cut that a loop no longer needs is dropped by its maker.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. It is never a local folder of this machine unless the session runs on this machine alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not named:
            import tempfile

            named = tempfile.mkdtemp(prefix="spark-ckpt-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there."""
    spark = df.sparkSession
    path = f"{folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the files of a cut that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
