"""Shared-storage helpers: cutting lineage, clearing what was cut, and joins of hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders made by this driver and not cleared yet.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Only a local session may go without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("taskloom.scratch.dir", None)
    if not found:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name storage that all executors share")
        found = tempfile.mkdtemp(prefix="taskloom-")
        spark.conf.set("taskloom.scratch.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to shared storage and read back: its lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> set[str]:
    """The folders made so far that aren't cleared."""
    return set(_MADE)


def clear(spark: SparkSession, keep: set[str] = frozenset()) -> int:
    """Deletes all folders made so far but ``keep``; for when no result that reads them is used any more.  Returns their number."""
    jvm = spark.sparkContext._jvm
    gone = [p for p in _MADE if p not in keep]
    for p in gone:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _MADE.remove(p)
    return len(gone)


def hot_join(left: DataFrame, right: DataFrame, on: str, hot: Column) -> DataFrame:
    """Inner join on column ``on``, of which ``right`` (a table) has one row each.

    ``hot`` marks rows of ``right`` whose key holds over a thousandth of ``left``: fewer than a thousand, so they are
    broadcast, and no key that is shuffled holds more than that share."""
    more = [c for c in right.columns if c != on]
    marked = left.join(F.broadcast(right.where(hot).select(on, F.struct(*more).alias("_more"))), on, "left")
    met = marked.where(F.col("_more").isNotNull()).select(*left.columns, "_more.*")
    rest = marked.where(F.col("_more").isNull()).select(*left.columns).join(right.where(~hot), on)
    return met.unionByName(rest.select(*met.columns))


def small(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """``df``, of a few numbers a row, hinted for broadcast only if it has ``most`` rows or fewer (counted, never assumed)."""
    if df.limit(most + 1).count() <= most:
        return F.broadcast(df), True
    return df, False


def picked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose number ``_rid`` is in ``ids``, without a shuffle of ``rows`` as long as the bit mask, of 64 numbers a row, has
    four million rows or fewer (numbers that are dense in each partition: some 256 million)."""
    word, bit = F.shiftright("_rid", 6).alias("_word"), F.expr("shiftleft(1L, cast(_rid & 63 as int))")
    mask = cut(ids.groupBy(word).agg(F.bit_or(bit).alias("_mask")), "mask")
    return rows.select("*", word).join(small(mask, 4_000_000)[0], "_word").where("getbit(_mask, cast(_rid & 63 as int)) = 1").select(*rows.columns)
