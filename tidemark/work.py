"""Tables between jobs: written below spark.checkpoint.dir, so that lineage ends and lost executors cost nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; it lies in spark.checkpoint.dir, and in a temporary folder only where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tidemark/{uuid.uuid4().hex}"


def settled(df: DataFrame, path: str) -> DataFrame:
    """df, written to path and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
