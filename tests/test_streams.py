"""Streams give what the batch operators give; logs, caches, sources, simulation, clustering, parsing and reports."""

import json
import os

import numpy as np
from pyspark.sql import functions as F

from taskloom import report
from taskloom.operators import eventlog, model_output, simulate, vectors
from taskloom.operators import telemetry as tm
from taskloom.sources import adapters as src
from taskloom.sources import caches, live, logs
from taskloom.streaming import lifecycle, telemetry

DIR = "/root/testdata/sf0.001"


def run(query, name, path):
    query.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()


def test_telemetry_stream(spark, tmp_path):
    batch = src.telemetry(spark, DIR).withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = [r[0] for r in batch.select(F.percentile_approx("ts", [0.3, 0.6]).alias("c")).select(F.explode("c")).collect()]
    for k in range(3):  # three files, in order of time
        some = batch.where((F.col("ts") > (cuts[k - 1] if k else "1900-01-01")) & (F.col("ts") <= (cuts[k] if k < 2 else "2999-01-01")))
        some.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(telemetry.changes(telemetry.source(spark, str(tmp_path / "in"))), "changes", str(tmp_path / "check"))
    got = {(r.pid, r.seq, r.what, r.old, r.new) for r in spark.table("changes").collect()}
    t = tm.streak(src.telemetry(spark, DIR)).withColumn("bottleneck", tm.bottleneck_a(F.col("streak")))
    want = {(r.pid, r.seq, "bottleneck", r.old, r.new) for r in tm.transitions(t).collect()} | {(r.pid, r.seq, "throttle", r.old, r.new) for r in tm.latch_transitions(t).collect()}
    assert got == want and want
    heard, failed = [], []
    posts = []
    many = telemetry.fan_out(telemetry.source(spark, str(tmp_path / "in"), 10).withColumn("severity", F.when(F.col("cpu_pct") > 95, "critical").otherwise("low")), [lambda b, n: heard.append(b.count()), lambda b, n: 1 / 0, telemetry.webhook(posts.extend)], str(tmp_path / "check2"), failed=lambda k, e: failed.append(k))
    many.trigger(availableNow=True).start().awaitTermination()
    assert sum(heard) == batch.count() and set(failed) == {1} and len(posts) == batch.where("cpu_pct > 95").count()


def test_lifecycle_stream(spark, tmp_path):
    e = src.task_events(spark, DIR).where("task_id < 200").select("task_id", "event_type", F.col("event_at").cast("timestamp").alias("event_at"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    run(lifecycle.fill(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))), "filled", str(tmp_path / "check"))
    assert spark.table("filled").exceptAll(eventlog.lifecycle_fill(e)).count() == 0 and spark.table("filled").count() == e.count() > 0


def test_logs(spark, tmp_path):
    path, day = str(tmp_path / "log"), "2024-01-0"
    rows = [(f"e{k}", "QUEUED", f"{day}{k}") for k in range(1, 8)]
    logs.append_events(spark.createDataFrame(rows, "entry_id string, event_type string, event_at string").withColumn("event_at", F.col("event_at").cast("timestamp")).withColumn("odd", F.lit(1)), path)
    with open(os.path.join(path, "more.json"), "w") as f:
        f.write("not json\n\n" + json.dumps({"entry_id": "e9", "event_at": "2024-01-09T00:00:00.000Z"}) + "\n")
    got = logs.load_events(spark, path, 3)
    assert [r.entry_id for r in got.orderBy("event_at").collect()] == ["e6", "e7", "e9"] and "odd" not in got.columns
    assert "e9" in logs.tail(spark, path, 1).first()[0]
    runs = spark.createDataFrame([("r1", "a", {"m": [1.0, 2.0], "n": [3.0]}, ["x"]), ("r2", "b", {}, [])], "run_id string, run_name string, metrics map<string,array<double>>, alerts_fired array<string>")
    logs.save_run(runs, str(tmp_path / "runs"))
    assert [(r.run_id, r.n_metrics, r.n_alerts, r.bottlenecks) for r in logs.list_runs(spark, str(tmp_path / "runs")).collect()] == [("r2", 0, 0, 0), ("r1", 3, 1, 0)]


def test_caches(spark, tmp_path):
    now = [0.0]
    papers, stages = (f(spark, str(tmp_path / f.__name__), clock=lambda: now[0]) for f in (caches.paper_cache, caches.stage_cache))
    made = []
    for c in (papers, stages):
        assert c.load("k") is None
        assert c.get("k", lambda: made.append(1) or spark.range(3)).count() == 3 and c.get("k", lambda: 1 / 0).count() == 3
    now[0] = 2 * 3600
    assert stages.load("k") is not None
    now[0] += 1
    assert stages.load("k") is None and papers.load("k") is not None
    now[0] = 24 * 3600
    assert papers.load("k") is None
    stages.save("other", spark.range(1))
    stages.invalidate()
    assert stages.load("other") is None
    assert caches.papers_key(["b", "a"]) == caches.papers_key(["a", "b"]) and caches.embedding_key(["a", "b"]) != caches.embedding_key(["b", "a"])
    assert caches.stage_key(" Q ", "s") == caches.stage_key("q", "s")


def test_live_and_options(spark):
    spark.dataSource.register(live.Telemetry)
    r = spark.read.format("telemetry").option("readings", "2").option("every", "0").load().collect()
    assert len(r) == 2 and 0 <= r[0].cpu_pct <= 100 and r[0].gpu_available is False
    o = live.Options.from_env({"TASKLOOM_WORKERS": "5"})
    assert o.workers == 5 and o.update(workers=2, odd=1) == ["odd"] and o.workers == 2


def test_ticks(spark):
    tasks = spark.createDataFrame([(1, 1, 0, True, 9), (1, 2, 1, True, 9), (1, 3, 1, False, 1), (1, 4, 4, False, 1), (2, 9, 2, True, 1)], "session long, task_id long, priority int, heavy boolean, burst int")
    load = spark.createDataFrame([(1, t, t < 3) for t in range(40)] + [(2, 0, False)], "session long, tick int, high boolean")
    got = [tuple(r) for r in simulate.run_ticks(tasks, load, 40).orderBy("session", "tick", "defer_count", "task_id").collect()]
    # one slot while pressure is high: the critical task takes it; the next is deferred no more as no slot is left
    assert got == [(1, 0, 1, "dispatch", 0, 0), (1, 3, 2, "dispatch", 1, 0), (1, 3, 3, "dispatch", 1, 0), (1, 4, 4, "dispatch", 4, 0), (2, 0, 9, "dispatch", 2, 0)]
    high = spark.createDataFrame([(2, t, True) for t in range(40)], "session long, tick int, high boolean")
    late = simulate.run_ticks(tasks.where("session = 2"), high, 40).orderBy("tick").collect()
    assert [r.action for r in late] == ["defer"] * 30 + ["force_dispatch"] and late[-1].effective == 2


def test_vectors(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0, 0], [9, 0, 0], [0, 9, 3]], dtype=float)
    points = np.vstack([c + rng.normal(0, 0.3, (40, 3)) for c in centres] + [np.array([[60.0, 60, 60]])])
    labels = vectors.density_labels(points)
    assert labels[-1] == -1 and set(labels) >= {0, 1, 2} and len(set(labels) - {-1}) == 3
    for k in range(3):
        part = labels[40 * k : 40 * k + 40]
        assert (part == np.bincount(part[part >= 0]).argmax()).mean() > 0.9
    df = spark.createDataFrame([(k % 2, k, [float(x) for x in p]) for k, p in enumerate(points)], "run int, vec_id long, embedding array<double>")
    assert vectors.cluster(df, "run").where("cluster >= 0").select("run", "cluster").distinct().count() == 6
    got = np.array([r.x for r in vectors.project(df).orderBy("vec_id").collect()])
    centred = points - points.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(centred @ axes[:2].T), atol=1e-6)
    made = vectors.embed(spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string"), lambda t: np.array([[len(x) + 1.0, 1.0] for x in t])).orderBy("id").collect()
    assert all(abs(sum(v * v for v in r.embedding) - 1) < 1e-6 for r in made)


def test_model_output(spark):
    reply = '```json\n[{"title": "t", "supporting_clusters": [1, 2], "confidence": 0.9}, {"description": "d"}]\n```'
    rows = spark.createDataFrame([(1, reply), (2, "sorry")], "reply_id long, reply string")
    got = {(r.reply_id, r.gap_id): (r.title, r.confidence, list(r.supporting_clusters)) for r in model_output.parse_gaps(rows).collect()}
    assert got == {(1, 0): ("t", 0.9, [1, 2]), (1, 1): ("Gap 1", 0.5, []), (2, 0): (model_output.NO_GAP, 0.0, [])}
    m = spark.createDataFrame([('{"methodology_type": "odd", "estimated_months": 3}',), ("no",)], "r string").select(model_output.parse_method(F.col("r"), ["benchmark"]).alias("m")).collect()
    assert [(r.m.methodology_type, r.m.estimated_months) for r in m] == [("empirical_analysis", 3), ("empirical_analysis", 6)]
    q = spark.createDataFrame([("q", '["a", "b"]'), ("q", "?")], "q string, r string").select(model_output.expanded_queries(F.col("q"), F.col("r")).alias("l")).collect()
    assert [list(r.l) for r in q] == [["q", "a", "b"], ["q"]]
    waits, calls = [], []
    try:
        model_output.with_retries(lambda: calls.append(1) or 1 / 0, 2, wait=waits.append)
    except ZeroDivisionError:
        assert len(calls) == 3 and waits == [2.0, 4.0]


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.234, None)], "x string, y double, z string")
    text = report.report("T", {"S": df, "N": "note"})
    assert "| a\\|b | 1.23 | - |" in text and text.startswith("# T")
    report.save(text, df, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r"), wholetext=True).first()[0] == text
    assert report.status(df) == {"x": "a|b", "y": 1.234, "z": None} and "**y**" in report.hypothesis_card(df)
