"""Scans over chunks against scans over whole keys, with one key that holds all rows; and the restarting machine against a plain fold."""

import datetime
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taskloom.operators import eventlog, queue, restarts
from taskloom.operators import telemetry as tm
from taskloom.operators.segments import CHUNK, Segments
from taskloom.sources import adapters as src

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def one_pid(spark):
    """Telemetry of one process, with equal times and nulls."""
    t = src.telemetry(spark, SF).withColumn("pid", F.lit(7).cast("long"))
    odd = F.when(F.col("seq") % 50 == 0, None).otherwise(F.col("cpu_pct"))
    return t.withColumns({"ts": F.date_trunc("hour", "ts").cast("timestamp_ntz"), "cpu_pct": odd}).cache()


def cut(t, most=60):
    return Segments(t, ["pid"], ["ts", "seq"], most)


def rows(df):
    return sorted(map(str, df.collect()))


def test_chunks_are_small_and_deterministic(one_pid):
    counts = cut(one_pid).rows.groupBy(CHUNK).count().collect()
    assert max(r["count"] for r in counts) <= one_pid.count() / 8 and len(counts) > 8
    assert cut(one_pid).rows.groupBy(CHUNK).count().collect().sort() == counts.sort()


@pytest.mark.parametrize("backwards", [False, True])
def test_running(one_pid, backwards):
    values = {"a": ("sum", F.col("seq")), "b": ("max", F.col("cpu_pct")), "c": ("min", F.col("cpu_pct")), "d": ("count", F.col("cpu_pct")), "e": ("last", F.when(F.col("seq") % 97 == 0, F.col("seq")))}
    order = [F.desc(c) if backwards else F.asc(c) for c in ("ts", "seq")]
    make = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "last": lambda c: F.last(c, ignorenulls=True)}
    for upto in (0, -1):
        w = W.partitionBy("pid").orderBy(*order).rowsBetween(W.unboundedPreceding, upto)
        plain = one_pid.withColumns({n: make[k](c).over(w) for n, (k, c) in values.items()}).fillna(0, ["a", "d"])
        assert rows(cut(one_pid).running(values, upto, backwards).done().select("seq", *values)) == rows(plain.select("seq", *values))


@pytest.mark.parametrize("backwards", [False, True])
@pytest.mark.parametrize("most", [3, 60])
def test_windowed(one_pid, backwards, most):
    few = one_pid.where("seq < 300")
    make = lambda w: {"x": F.count("*").over(w.rowsBetween(-4, 0)), "y": F.min("cpu_pct").over(w.rowsBetween(-4, -1)), "z": F.lag("seq", 1, -5).over(w)}
    order = [F.desc(c) if backwards else F.asc(c) for c in ("ts", "seq")]
    plain = few.withColumns(make(W.partitionBy("pid").orderBy(*order))).select("seq", "x", "y", "z")
    assert rows(cut(few, most).windowed(4, make, backwards).done().select("seq", "x", "y", "z")) == rows(plain)


def test_operators_on_a_hot_key(one_pid, monkeypatch):
    def all_(t):
        s = tm.streaks(t)
        s = s.over(s.rows.withColumn("bottleneck", tm.bottleneck_a(F.col("streak"))))
        return [rows(s.done().select("seq", "streak", "sustained")), rows(tm.transitions(s)), rows(tm.throttle_instant(s)), rows(tm.latch_transitions(s)), rows(tm.throttle_latch(s)), rows(tm.anomalies(t)), rows(tm.rolling(t)), rows(tm.counter_rate(t, "seq"))]

    def moved():
        tasks = src.tasks(one_pid.sparkSession, SF).withColumn("session", F.lit(1))
        return [rows(queue.push(tasks)), rows(queue.peak_depth(tasks)), rows(queue.peak_depth_whole(tasks)), rows(eventlog.run_lifecycle(tasks))]

    # a process of few rows is scanned whole
    plain, plain_moved = all_(one_pid), moved()
    own = Segments.__init__
    monkeypatch.setattr(Segments, "__init__", lambda self, t, key, order, most=100, share=0.05, like=None: own(self, t, key, order, most, share, like))
    assert all_(one_pid) == plain and moved() == plain_moved


def plain_machine(events, deadline, retries, base, escalate):
    """Event by event, as the rules are written down."""
    state, out = {}, []
    for e in sorted(events, key=lambda e: (e["at"], e["tie"])):
        s = state.setdefault(e["task_id"], {"clock": None, "tries": 0, "n": 0, "eff": e["priority"], "live": False})
        was = s["live"]
        if e["kind"] == "deferral":
            s["clock"] = s["clock"] or e["at"]
            elapsed, number, tries = (e["at"] - s["clock"]).total_seconds(), s["n"] + 1, None
            if elapsed >= deadline:
                action, after = "EXPIRED", -1
            else:
                action, s["n"], s["live"] = "REQUEUED", number, True
                if number >= escalate and s["eff"] > 0:
                    action, s["eff"] = "ESCALATED", s["eff"] - 1
                after = s["eff"]
            wait = 0.0 if action == "EXPIRED" else min(60.0, base * 2 ** (number - 1))
        else:
            s["tries"] += 1
            elapsed, number, tries = None, None, s["tries"]
            action = "SKIPPED" if not e["retryable"] else "EXHAUSTED" if tries > retries else "RETRYING"
            wait, after = (min(60.0, base * 2 ** (tries - 1)) if action == "RETRYING" else 0.0), e["priority"]
            if action == "RETRYING":
                s["n"], s["eff"] = 0, e["priority"]
        if action in restarts.RESTARTS:
            s.update(clock=None, tries=0, live=False)
        out.append((e["task_id"], e["tie"], action, tries, number, elapsed, wait, after, s["live"] - was))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_machine_against_a_plain_fold(spark, most):
    rng = random.Random(4)
    day = datetime.datetime(2024, 1, 1)
    events = []
    for i in range(600):
        task = rng.choice([None, 1, 1, 1, 1, 2, 3])
        at = day + datetime.timedelta(hours=rng.randint(0, 2000))
        events.append({"task_id": task, "session": 1, "priority": (task or 0) % 4 + 1, "at": at, "tie": i, "kind": rng.choice(["deferral"] * 3 + ["failure"]), "retryable": rng.random() < 0.8})
    df = spark.createDataFrame([tuple(e.values()) for e in events], "task_id long, session int, priority int, at timestamp_ntz, tie int, kind string, retryable boolean")
    got = restarts.machine(df, 30 * 3600, 2, escalate_after=3, most=most)
    cols = ["task_id", "tie", "action", "attempt", "defer_number", "elapsed_s", "backoff_s", "priority_after", "history"]
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == plain_machine(events, 30 * 3600, 2, 2.0, 3)
    assert restarts.machine(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        restarts.machine(df, 0)


def test_tasks_of_bounded_size_are_followed_after_one_shuffle(spark):
    rows = [(k % 5, 1, 2, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k), k, "failure" if k % 3 == 0 else "deferral", k % 4 != 0) for k in range(60)]
    df = spark.createDataFrame(rows, "task_id long, session long, priority int, at timestamp_ntz, tie long, kind string, retryable boolean")
    plan = restarts.machine(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
