"""Stateful processors against the batch operators, stopped and started again from their checkpoint in mid-stream."""

import datetime

import pytest
from pyspark.sql import functions as F

from taskloom.operators import telemetry as tm
from taskloom.sources import adapters as src
from taskloom.streaming import processors

DIR = "/root/testdata/sf0.001"


@pytest.fixture()
def state(spark):
    processors.store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def files(df, path, parts, order):
    """Rows in order of time as Parquet files, first files first."""
    n = -(-df.count() // parts)
    rows = df.orderBy(*order).collect()
    for i in range(parts):
        df.sparkSession.createDataFrame(rows[i * n : (i + 1) * n], df.schema).coalesce(1).write.mode("append").parquet(f"{path}/f{i:02d}")
        yield f"{path}/f{i:02d}"


def run_in_two(spark, df, order, make, tmp_path):
    """Runs over the first half, stops, puts the other half beside it, and goes on from the checkpoint."""
    got = str(tmp_path / "out")
    for k, path in enumerate(files(df, str(tmp_path / "in"), 2, order)):
        spark.read.parquet(path).coalesce(1).write.mode("append").parquet(str(tmp_path / "seen"))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "seen"))
        q = make(stream).writeStream.format("parquet").option("path", got).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    return spark.read.parquet(got)


def test_latch_and_streak(spark, state, tmp_path):
    t = tm.streak(src.telemetry(spark, DIR).where("pid < 5"))
    t = t.withColumn("bottleneck", tm.bottleneck_a(F.col("streak"))).select("pid", "seq", "ts", "cpu_pct", "ram_pct", "swap_pct", "gpu_pct", "disk_pct", "bottleneck").cache()
    got = run_in_two(spark, t, ["ts", "seq"], processors.latch_changes, tmp_path / "a")
    assert sorted(map(tuple, got.select("seq", "pid", "old", "new").collect())) == sorted(map(tuple, tm.latch_transitions(t).collect()))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    got = run_in_two(spark, t, ["ts", "seq"], processors.streaks, tmp_path / "b")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted(map(tuple, got.select("pid", "seq", "streak", "sustained").collect())) == sorted(map(tuple, tm.streak(t).select("pid", "seq", "streak", "sustained").collect()))


def test_aging_by_timers(spark, state, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda s: t0 + datetime.timedelta(seconds=s)
    rows = [(1, 10, at(0), "PUSH", 3), (1, 11, at(1), "PUSH", 1), (1, 12, at(2), "PUSH", 2), (1, 12, at(5), "GONE", 2), (2, 20, at(0), "PUSH", 0), (1, 10, at(15), "PUSH", 3), (1, 99, at(60), "PUSH", 4), (2, 98, at(61), "PUSH", 4)]
    df = spark.createDataFrame(rows, "queue long, task_id long, at timestamp, event string, priority int")
    got = run_in_two(spark, df, ["at", "task_id"], processors.aging, tmp_path)
    # task 10 has one step and is pushed again at 15; all steps that the watermark of 61 passed
    steps = {(r.task_id, int((r.at - t0).total_seconds()), r.effective) for r in got.collect()}
    assert {s for s in steps if s[0] == 11} == {(11, 11, 0)} and not {s for s in steps if s[0] in (12, 20)}
    assert {s for s in steps if s[0] == 10} >= {(10, 25, 2), (10, 35, 1), (10, 45, 0)}
