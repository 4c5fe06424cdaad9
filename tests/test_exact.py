"""Rounding as Python does it, bounds that keep null, and metrics of empty and unended logs."""

import random

from pyspark.sql import functions as F

from taskloom.functions import scalar as fx
from taskloom.operators import eventlog, queue


def test_rounding(spark):
    rng = random.Random(2)
    ties = [(2 * k + 1) / 2 / 10**n for n in range(4) for k in range(-3000, 3000)] + [2.675, 1.005, 0.5, 1.5, 2.5, -0.5, 0.045, 1e300, -0.0, 4503599627370497.5, 1e-320]
    many = ties + [rng.uniform(-1e6, 1e6) for _ in range(150_000)] + [k / 2**rng.randint(0, 12) for k in range(-30_000, 30_000)] + [round(rng.uniform(-100, 100), 4) for _ in range(60_000)]
    df = spark.createDataFrame([(x,) for x in many], "x double")
    for n in (0, 1, 2, 3, 4, 8):
        for r in df.select("x", fx.round_exact(F.col("x"), n).alias("r")).toLocalIterator():
            assert r.r == round(r.x, n), (r.x, n, r.r)
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double").select(fx.round_exact(F.col("x"), 2).alias("r")).collect()
    assert odd[0].r is None and odd[1].r != odd[1].r and odd[2].r == float("inf")


def test_bounds_keep_null(spark):
    r = spark.createDataFrame([(None,)], "x double").select(*[f(F.col("x")).alias(str(i)) for i, f in enumerate([lambda x: fx.clamp(x, 0, 1), fx.headroom, lambda x: fx.pressure_index(x, x)])]).first()
    assert list(r) == [None, None, None]


LOG = "task_id long, session long, priority int, queued_at timestamp_ntz, dispatch_at timestamp_ntz, complete_at timestamp_ntz, defer_count long, status string, event_type string, event_at timestamp_ntz"


def test_metrics_of_logs_without_an_end(spark):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    empty = spark.createDataFrame([], LOG)
    assert set(eventlog.scheduling_metrics(empty).first()) == {0}
    waiting = spark.createDataFrame([(1, 1, 2, t, None, None, 0, "DEFERRED", "QUEUED", t), (2, 1, 2, t, None, None, 0, "DEFERRED", "DEFERRED", t)], LOG)
    assert set(eventlog.scheduling_metrics(waiting).first()) == {0}
    # one instant: no wall time, so no shares of it
    once = spark.createDataFrame([(1, 1, 2, t, t, t, 0, "COMPLETED", "COMPLETED", t)], LOG)
    r = eventlog.scheduling_metrics(once).first()
    assert (r.completed, r.tasks, r.cpu_util, r.overhead, r.throughput_min) == (1, 1, 0.0, 0.0, 0.0)
    none = spark.createDataFrame([], "task_id long")
    assert queue.peek(queue.aged(empty.withColumn("ticks", F.lit(0))), none).collect() == []
