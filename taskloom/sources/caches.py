"""Caches of papers, embeddings and stage results: Parquet folders by key, with ages in a manifest column."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def papers_key(queries: list[str]) -> str:
    return hashlib.md5("|".join(sorted(queries)).encode()).hexdigest()[:12]


def embedding_key(ids: list[str]) -> str:
    """Depends on the order of the ids."""
    return hashlib.md5("".join(ids).encode()).hexdigest()[:12]


def stage_key(query: str, stage: str) -> str:
    return hashlib.sha256(f"{query.lower().strip()}::{stage}".encode()).hexdigest()[:16]


class Cache:
    """Tables under ``root`` by key.  ``ttl_hours``: None keeps for ever; ``strict``: an age equal to it has expired too."""

    def __init__(self, spark: SparkSession, root: str, ttl_hours: float | None = None, strict: bool = False, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.ttl, self.strict, self.clock = spark, root.rstrip("/"), ttl_hours, strict, clock

    def save(self, key: str, df: DataFrame) -> None:
        df.withColumn("_saved", F.lit(float(self.clock()))).write.mode("overwrite").parquet(f"{self.root}/{key}")

    def load(self, key: str) -> DataFrame | None:
        """The table, or None if it isn't there, is empty or too old."""
        try:
            df = self.spark.read.parquet(f"{self.root}/{key}")
        except AnalysisException:
            return None
        saved = df.agg(F.max("_saved")).first()[0]
        if saved is None:
            return None
        age = (self.clock() - saved) / 3600
        if self.ttl is not None and (age >= self.ttl if self.strict else age > self.ttl):
            return None
        return df.drop("_saved")

    def invalidate(self, key: str | None = None) -> None:
        """Deletes one entry; without a key all of them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The cached table, or what ``make`` gives, saved and read back."""
        found = self.load(key)
        if found is None:
            self.save(key, make())
            found = self.load(key)
        return found


def paper_cache(spark: SparkSession, root: str, **options) -> Cache:
    """A hit is younger than 24 hours."""
    return Cache(spark, root, 24.0, True, **options)


def stage_cache(spark: SparkSession, root: str, **options) -> Cache:
    """A miss is older than two hours."""
    return Cache(spark, root, 2.0, False, **options)
