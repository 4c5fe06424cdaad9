"""Tables that end a lineage, in storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session may go without one, and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("taskloom.scratch.dir", None)
    if not found:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name storage that all executors share")
        found = tempfile.mkdtemp(prefix="taskloom-")
        spark.conf.set("taskloom.scratch.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to shared storage and read back: its lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
