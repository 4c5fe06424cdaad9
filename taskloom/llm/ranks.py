"""Exact ranks within groups from hierarchical digit histograms, without a global sort and without a hot task.

Rows are counted by (group, prefix of their place).  Prefix sums over the counts are taken digit by digit: at most
``RADIX`` children under a parent, so no window holds more.  A bucket of over ``MOST`` rows (many rows of one place) is
counted again by the next four characters of the rows' key, then the next, until none is left; only rows inside small
buckets are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import cut, small

BITS = 12
RADIX = 1 << BITS
#: Rows of one bucket that are sorted by one task.
MOST = 65_536
#: Buckets over ``MOST`` that are broadcast, if a count finds no more: so many stand for 13 billion rows of hot places.
MOST_HOT = 200_000
_STEP = 4


def _before(n: str, *by: str):
    """Sum of ``n`` over the rows ahead, in order of the last of ``by`` within the others."""
    return F.coalesce(F.sum(n).over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def bucket_starts(hist: DataFrame, low: int, high: int) -> DataFrame:
    """``hist`` (group, place, n) with ``start``: rows of the group at lower places, which lie from ``low`` to ``high``."""
    if high - low < RADIX:
        return hist.withColumn("start", _before("n", "group", "place"))
    up = hist.groupBy("group", F.shiftright("place", BITS).alias("place")).agg(F.sum("n").alias("n"))
    above = bucket_starts(up, low >> BITS, high >> BITS).select("group", F.col("place").alias("_above"), F.col("start").alias("_from"))
    children = hist.withColumn("_above", F.shiftright("place", BITS)).join(above, ["group", "_above"])
    return children.withColumn("start", F.col("_from") + _before("n", "group", "_above", "place")).select("group", "place", "n", "start")


def ranked(rows: DataFrame, order: list[str], most: int = MOST) -> DataFrame:
    """``rows`` (a stored table with ``group`` string, ``place`` bigint, ``key`` string) with ``rank`` from 0 within the group.

    Rows go by place, then by key and ``order``; ``order`` must be monotone in (place, key) and end in a column that tells
    rows apart."""
    spark = rows.sparkSession
    hist = cut(rows.groupBy("group", "place").agg(F.count("*").alias("n")), "ranks-histogram")
    low, high = hist.agg(F.min("place"), F.max("place")).first()
    buckets = bucket_starts(hist, low or 0, high or 0).withColumn("path", F.lit(""))
    rows = rows.withColumn("path", F.lit(""))
    by, at = ["group", "place", "path"], 0
    while True:
        buckets = cut(buckets.select(*by, "n", "start"), "ranks-buckets")
        hot = buckets.where((F.col("n") > most) & (F.length("path") == at))
        if not hot.limit(1).count():
            break
        at += _STEP
        marked, _ = small(hot.select(*by, F.lit(True).alias("_hot")), MOST_HOT)
        finer = F.substring("key", 1, at)
        rows = rows.join(marked, by, "left").withColumn("path", F.when(F.col("_hot"), finer).otherwise(F.col("path"))).drop("_hot")
        again = rows.where(F.length("path") == at).groupBy(*by).agg(F.count("*").alias("n"))
        again = again.withColumn("_above", F.expr(f"substr(path, 1, {at - _STEP})"))
        above = hot.select("group", "place", F.col("path").alias("_above"), F.col("start").alias("_from"))
        again = again.join(above, ["group", "place", "_above"]).withColumn("start", F.col("_from") + _before("n", "group", "place", "_above", "path"))
        buckets = buckets.where(~((F.col("n") > most) & (F.length("path") == at - _STEP))).unionByName(again.select(*by, "n", "start"))
    within = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    placed = rows.join(buckets.drop("n"), by)
    return placed.withColumn("rank", F.col("start") + within - 1).drop("place", "key", "path", "start")
