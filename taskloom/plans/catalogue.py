"""All queries of the engine's own operators over the driver's tables, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalar as fx
from ..operators import corpus, eventlog, policy, queue, scoring, tools
from ..operators import telemetry as tm
from ..sources import adapters as src
from ..sources.adapters import sql

QUERIES = {}
ORACLE_SQL = {}
#: Keywords of the reproducibility statistics on these tables.
WORDS = ["license", "@", "copyright"]


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


def ev(s, d):
    return src.task_events(s, d)


def tels(s, d):
    """Telemetry with streaks and bottlenecks, cut for further scans."""
    t = tm.streaks(src.telemetry(s, d))
    return t.over(t.rows.withColumn("bottleneck", tm.bottleneck_a(F.col("streak"))))


def tel(s, d):
    return tels(s, d).done()


TE = ("tasks", "task_events")
WAIT, BURST, TURN = "greatest(0, date_diff('second', queued_at, dispatch_at))", "greatest(0, date_diff('second', dispatch_at, complete_at))", "greatest(0, date_diff('second', queued_at, complete_at))"
TIMED = f"e AS (SELECT *, {WAIT} AS wait_s, {BURST} AS burst_s, {TURN} AS turnaround_s FROM task_events)"
GRP = "g1 AS (SELECT *, sum(CASE WHEN cpu_pct > 85 THEN 0 ELSE 1 END) OVER (PARTITION BY pid ORDER BY ts, seq) AS grp FROM telemetry), tl AS (SELECT *, sum(CASE WHEN cpu_pct > 85 THEN 1 ELSE 0 END) OVER (PARTITION BY pid, grp ORDER BY ts, seq) AS streak FROM g1), t AS (SELECT *, CASE WHEN ram_pct > 92 OR swap_pct > 40 THEN 'oom_risk' WHEN gpu_pct > 90 THEN 'gpu_bound' WHEN ram_pct > 80 AND cpu_pct < 60 THEN 'memory_bound' WHEN disk_pct > 70 AND cpu_pct < 50 THEN 'io_bound' WHEN streak >= 3 OR cpu_pct > 95 THEN 'cpu_bound' ELSE 'none' END AS bottleneck FROM tl)"


def with_(body, *views, more=""):
    return "WITH " + ", ".join([*[src.SQL_VIEWS[v] for v in views], *([more] if more else [])]) + " " + body


# --- lifecycle log ---------------------------------------------------------------------------
#: printf rounds by the exact binary value, ties to even.
PY = lambda x, n: f"CAST(printf('%.{n}f', ({x})::DOUBLE) AS DOUBLE)"
#: Aging ticks of a task on these tables.
AGED = "greatest(0, priority - task_id % 60 // 10)::INT"
_ENDED = "event_type IN ('COMPLETED','FAILED')"
query("D1_scheduling_metrics", with_(
    f"""SELECT {PY('awt', 3)} AS awt, {PY('abt', 3)} AS abt, {PY('att', 3)} AS att, {PY('CASE WHEN ended > 0 AND wall > 0 THEN least(100.0::DOUBLE, burst * 100.0::DOUBLE / wall) ELSE 0.0 END', 2)} AS cpu_util,
 {PY('CASE WHEN ended > 0 AND wall > 0 THEN completed * 60.0::DOUBLE / wall ELSE 0.0 END', 3)} AS throughput_min, {PY('CASE WHEN ended > 0 AND wait + burst > 0 THEN least(100.0::DOUBLE, wait * 100.0::DOUBLE / (wait + burst)) ELSE 0.0 END', 2)} AS overhead,
 CASE WHEN ended > 0 THEN completed ELSE 0 END AS completed, CASE WHEN ended > 0 THEN ended - completed ELSE 0 END AS failed, CASE WHEN ended > 0 THEN deferred ELSE 0 END AS deferred, CASE WHEN ended > 0 THEN dispatched ELSE 0 END AS dispatched, CASE WHEN ended > 0 THEN tasks ELSE 0 END AS tasks
 FROM (SELECT coalesce(avg(wait_s) FILTER (WHERE {_ENDED} AND wait_s > 0), 0.0) AS awt, coalesce(avg(burst_s) FILTER (WHERE event_type = 'COMPLETED' AND burst_s > 0), 0.0) AS abt, coalesce(avg(turnaround_s) FILTER (WHERE {_ENDED} AND turnaround_s > 0), 0.0) AS att,
  date_diff('second', min(event_at), max(event_at))::DOUBLE AS wall, coalesce(sum(burst_s) FILTER (WHERE event_type = 'COMPLETED'), 0)::DOUBLE AS burst, coalesce(sum(wait_s) FILTER (WHERE {_ENDED}), 0)::DOUBLE AS wait, count(*) FILTER (WHERE {_ENDED}) AS ended,
  count(*) FILTER (WHERE event_type = 'COMPLETED') AS completed, count(*) FILTER (WHERE event_type = 'DEFERRED') AS deferred, count(*) FILTER (WHERE event_type = 'DISPATCHED') AS dispatched, count(DISTINCT task_id) AS tasks FROM e)""", *TE, more=TIMED))(lambda s, d: eventlog.scheduling_metrics(ev(s, d)))


def aged(t):
    """Tasks or events with their effective priority."""
    return queue.aged(t.withColumn("ticks", F.col("task_id") % 60)).drop("ticks")


def cancelled(s, d):
    """Tasks that were cancelled: orders with a returned line."""
    return src.table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("task_id"))


_LIVE = f"live AS (SELECT *, {AGED} AS effective FROM tasks WHERE status = 'DEFERRED' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = task_id AND l_returnflag = 'R'))"
query("D2_wait_by_priority", with_(f"SELECT {AGED} AS effective, {PY('avg(wait_s)', 3)} AS mean_wait, count(*) FILTER (WHERE event_type = 'COMPLETED') AS completed FROM e WHERE {_ENDED} GROUP BY 1", *TE, more=TIMED))(lambda s, d: eventlog.wait_by_priority(aged(ev(s, d))))
query("C11_lifecycle_fill", with_("""SELECT task_id, event_type, event_at, last_value(CASE WHEN event_type = 'QUEUED' THEN event_at END IGNORE NULLS) OVER w AS seen_queued, last_value(CASE WHEN event_type = 'DISPATCHED' THEN event_at END IGNORE NULLS) OVER w AS seen_dispatch FROM task_events
 WINDOW w AS (PARTITION BY task_id ORDER BY event_at, CASE event_type WHEN 'QUEUED' THEN 0 WHEN 'DEFERRED' THEN 1 WHEN 'DISPATCHED' THEN 2 ELSE 3 END ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", *TE))(lambda s, d: eventlog.lifecycle_fill(ev(s, d)))
query("N1_gantt_rows", with_("""SELECT task_id, 'bar' AS kind, dispatch_at AS start_at, complete_at AS end_at, CASE WHEN event_type = 'COMPLETED' THEN 'green' ELSE 'red' END AS colour FROM task_events WHERE event_type IN ('COMPLETED','FAILED') AND dispatch_at IS NOT NULL
 UNION ALL SELECT task_id, 'marker', event_at, event_at, 'orange' FROM task_events WHERE event_type = 'DEFERRED'""", *TE))(lambda s, d: eventlog.gantt_rows(ev(s, d)))
query("B1_events_last_n", with_("SELECT task_id, event_type, event_at FROM task_events ORDER BY event_at DESC, task_id DESC, event_type DESC LIMIT 50", *TE))(lambda s, d: eventlog.last_n(ev(s, d), 50))
query("B2_completed_only", with_("SELECT task_id, complete_at FROM task_events WHERE event_type = 'COMPLETED'", *TE))(lambda s, d: ev(s, d).where("event_type = 'COMPLETED'").select("task_id", "complete_at"))
query("I10_deferral_backoff", with_("SELECT task_id, k::INT AS defer_number, round(least(60.0, 2.0 * pow(2.0, k - 1)), 3)::DOUBLE AS backoff_s, greatest(0, priority - greatest(0, k - 4))::INT AS priority_after, k >= 5 AS escalated FROM tasks, unnest(range(1, defer_count + 1)) AS u(k)", "tasks"))(lambda s, d: eventlog.deferral_backoff(src.tasks(s, d).where("defer_count > 0")))
_fib = ", ".join(str(float(x)) for x in fx.fibonacci(30))
query("I12_backoff_table", f"SELECT k::INT AS attempt, round(least(60.0, 1.5 * pow(2.0, k - 1)), 3)::DOUBLE AS exponential, round(least(60.0, 1.5 * k), 3)::DOUBLE AS linear, 1.5::DOUBLE AS constant, round(least(60.0, 1.5 * ([{_fib}])[k]), 3)::DOUBLE AS fibonacci FROM range(1, 13) t(k)")(
    lambda s, d: s.range(1, 13).select(F.col("id").cast("int").alias("attempt"), *[fx.backoff(k, 1.5, F.col("id")).alias(k) for k in ("exponential", "linear", "constant", "fibonacci")]))
# --- telemetry -------------------------------------------------------------------------------
for _name, _inc, _frame in (("E1_anomaly_preceding", False, "30 PRECEDING AND 1 PRECEDING"), ("E2_anomaly_inclusive", True, "29 PRECEDING AND CURRENT ROW")):
    query(_name, with_("SELECT seq, pid, round(m, 5) AS mean, round(m + 2 * sd, 5) AS threshold FROM x WHERE n >= 10 AND sd > 0 AND abs(cpu_pct - m) > 2 * sd", "telemetry", more=f"x AS (SELECT *, count(cpu_pct) OVER w AS n, avg(cpu_pct) OVER w AS m, stddev_samp(cpu_pct) OVER w AS sd FROM telemetry WINDOW w AS (PARTITION BY pid ORDER BY ts, seq ROWS BETWEEN {_frame}))"))(lambda s, d, i=_inc: tm.anomalies(src.telemetry(s, d), i))
query("E3_cpu_streak", with_("SELECT seq, pid, streak::BIGINT AS streak, streak >= 3 AS sustained FROM t", "telemetry", more=GRP))(lambda s, d: tm.streak(src.telemetry(s, d)).select("seq", "pid", "streak", "sustained"))
query("E4_sustained_pressure", with_("SELECT seq, pid, n >= 5 AND lo > 80 AS cpu_high, n >= 5 AND hi < 60 AS cpu_low FROM x", "telemetry", more="x AS (SELECT *, count(*) OVER w AS n, min(cpu_pct) OVER w AS lo, max(cpu_pct) OVER w AS hi FROM telemetry WINDOW w AS (PARTITION BY pid ORDER BY ts, seq ROWS 4 PRECEDING))"))(lambda s, d: tm.pressure(src.telemetry(s, d)).select("seq", "pid", "cpu_high", "cpu_low"))
query("E5_rolling_10", with_("SELECT seq, pid, round(avg(cpu_pct) OVER w, 5) AS mean, max(cpu_pct) OVER w AS max FROM telemetry WINDOW w AS (PARTITION BY pid ORDER BY ts, seq ROWS 9 PRECEDING)", "telemetry"))(lambda s, d: tm.rolling(src.telemetry(s, d)))
_ctr = "c AS (SELECT *, sum(floor(cpu_pct)) OVER (PARTITION BY pid ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS counter, coalesce(ts <= max(ts) OVER (PARTITION BY pid ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stale FROM telemetry), p AS (SELECT *, lag(counter) OVER w AS pv, lag(ts) OVER w AS pt FROM c WINDOW w AS (PARTITION BY pid, stale ORDER BY ts, seq))"
query("E6_counter_rate", with_("SELECT seq, pid, round(CASE WHEN stale OR pt IS NULL THEN 0.0 ELSE greatest(0.0, counter - pv) / (date_diff('microsecond', pt, ts) / 1e6) END, 6)::DOUBLE AS rate FROM p", "telemetry", more=_ctr))(lambda s, d: tm.counter_rate(tm.by_pid(src.telemetry(s, d)).running({"counter": ("sum", F.floor("cpu_pct").cast("double"))})))
query("E8_bottleneck_transitions", with_("SELECT seq, pid, old, bottleneck AS new, CASE WHEN bottleneck <> 'none' THEN 'DETECTED' ELSE 'CLEARED' END AS event FROM (SELECT *, lag(bottleneck, 1, 'none') OVER (PARTITION BY pid ORDER BY ts, seq) AS old FROM t) WHERE old <> bottleneck", "telemetry", more=GRP))(lambda s, d: tm.transitions(tels(s, d)))
query("L13_bottleneck_a", with_("SELECT bottleneck, count(*) AS n FROM t GROUP BY 1", "telemetry", more=GRP))(lambda s, d: tel(s, d).groupBy("bottleneck").agg(F.count("*").alias("n")))
query("L14_bottleneck_s", with_("SELECT CASE WHEN ram_pct >= 92 OR swap_pct >= 40 THEN 'oom_risk' WHEN cpu_pct >= 90 THEN 'cpu_bound' WHEN disk_pct >= 70 AND cpu_pct < 50 THEN 'io_bound' WHEN ram_pct >= 80 AND cpu_pct < 60 THEN 'memory_bound' ELSE 'none' END AS bottleneck, count(*) AS n FROM telemetry GROUP BY 1", "telemetry"))(lambda s, d: src.telemetry(s, d).groupBy(tm.bottleneck_s().alias("bottleneck")).agg(F.count("*").alias("n")))
_al = """a AS (SELECT seq, pid, bottleneck, 'cpu' AS metric, CASE WHEN cpu_pct > 95 THEN 'CRITICAL' WHEN cpu_pct > 85 AND streak >= 3 THEN 'WARNING' END AS level FROM t
 UNION ALL SELECT seq, pid, bottleneck, 'ram', CASE WHEN ram_pct > 92 THEN 'CRITICAL' WHEN ram_pct > 80 THEN 'WARNING' END FROM t UNION ALL SELECT seq, pid, bottleneck, 'swap', CASE WHEN swap_pct > 40 THEN 'WARNING' END FROM t
 UNION ALL SELECT seq, pid, bottleneck, 'gpu', CASE WHEN gpu_pct > 97 THEN 'CRITICAL' WHEN gpu_pct > 90 THEN 'WARNING' END FROM t),
 al AS (SELECT seq, pid, metric, level, CASE WHEN level = 'CRITICAL' THEN 'critical' WHEN bottleneck IN ('oom_risk','gpu_bound') THEN 'high' ELSE 'medium' END AS severity FROM a WHERE level IS NOT NULL)"""
query("L15_L16_alerts", with_("SELECT * FROM al", "telemetry", more=GRP + ", " + _al))(lambda s, d: tm.alerts(tel(s, d)))
query("D18_alert_counts", with_("SELECT s AS severity, count(al.seq) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) v(s) LEFT JOIN al ON al.severity = s GROUP BY 1", "telemetry", more=GRP + ", " + _al))(
    lambda s, d: s.createDataFrame([("critical",), ("high",), ("medium",), ("low",)], "severity string").join(tm.alerts(tel(s, d)).groupBy("severity").agg(F.count("*").alias("c")), "severity", "left").select("severity", F.coalesce("c", F.lit(0)).cast("long").alias("n")))
query("I8_throttle_instant", with_("SELECT seq, pid, cap FROM (SELECT *, lag(cap, 1, 3) OVER (PARTITION BY pid ORDER BY ts, seq) AS p FROM (SELECT *, CASE WHEN cpu_pct > 85 OR bottleneck IN ('oom_risk','cpu_bound') THEN 1 ELSE 3 END AS cap FROM t)) WHERE p <> cap", "telemetry", more=GRP))(lambda s, d: tm.throttle_instant(tels(s, d)))
query("I9_throttle_latch", with_("SELECT state, count(*) AS n FROM (SELECT coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY pid ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 'NORMAL') AS state FROM y) GROUP BY 1", "telemetry", more=GRP + """, x AS (SELECT *, count(*) OVER w AS n, min(cpu_pct) OVER w AS cl, max(cpu_pct) OVER w AS ch, min(ram_pct) OVER w AS rl, max(ram_pct) OVER w AS rh FROM t WINDOW w AS (PARTITION BY pid ORDER BY ts, seq ROWS 4 PRECEDING)),
 y AS (SELECT *, CASE WHEN (n >= 5 AND (cl > 80 OR rl > 80)) OR bottleneck = 'oom_risk' THEN 'THROTTLED' WHEN n >= 5 AND ch < 60 AND rh < 60 AND bottleneck = 'none' THEN 'NORMAL' END AS sig FROM x)"""))(lambda s, d: tm.throttle_latch(tels(s, d)))
query("D24_rolling_averages", with_("SELECT pid, round(avg(cpu_pct), 5) AS avg_cpu, max(cpu_pct) AS max_cpu, round(avg(ram_pct), 5) AS avg_ram, max(ram_pct) AS max_ram, round(avg(disk_pct), 5) AS avg_disk, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY ts DESC, seq DESC) AS r FROM telemetry) WHERE r <= 10 GROUP BY 1", "telemetry"))(lambda s, d: tm.last_averages(src.telemetry(s, d)))
query("D16_session_summary", with_("SELECT pid, date_sub('second', min(ts), max(ts)) AS duration_s, round(avg(cpu_pct), 8) AS avg_cpu, max(cpu_pct) AS peak_cpu, round(avg(ram_pct), 8) AS avg_ram, max(ram_pct) AS peak_ram, coalesce(round(avg(gpu_pct) FILTER (WHERE seq % 5 <> 0), 8), 0.0) AS avg_gpu, coalesce(max(gpu_pct) FILTER (WHERE seq % 5 <> 0), 0.0) AS peak_gpu, sum((cpu_pct > 95 OR cpu_pct > 85 AND streak >= 3)::INT + (ram_pct > 80)::INT + (swap_pct > 40)::INT + (gpu_pct > 90)::INT)::BIGINT AS alerts, coalesce(array_to_string(list_sort(list(DISTINCT bottleneck) FILTER (WHERE bottleneck <> 'none')), ','), '') AS bottlenecks FROM t GROUP BY 1", "telemetry", more=GRP))(lambda s, d: tm.session_summary(tel(s, d).withColumn("gpu_available", F.col("seq") % 5 != 0)))
query("D17_run_metrics", "SELECT user_id AS run_id, event_type AS metric, min(value) AS lo, max(value) AS hi, arg_max(value, event_id) AS last, count(*) AS n FROM events GROUP BY 1, 2")(lambda s, d: src.table(s, d, "events").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("metric")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.max_by("value", "event_id").alias("last"), F.count("*").alias("n")))
query("D19_stage_summary", with_("SELECT session % 10 AS run, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE dispatch_at IS NULL) AS cached, round(sum(defer_count), 3)::DOUBLE AS total FROM tasks GROUP BY 1", "tasks"))(
    lambda s, d: src.tasks(s, d).groupBy((F.col("session") % 10).alias("run")).agg(F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("dispatch_at").isNull()).alias("cached"), F.sum("defer_count").cast("double").alias("total")))
query("D26_hottest_core", "SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT - 1 AS core FROM embeddings")(lambda s, d: src.table(s, d, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("core")))
query("B7_B14_snapshot_flags", with_("SELECT seq, greatest(0.0, 100 - ram_pct)::DOUBLE AS headroom, round(least(100.0, 0.7 * ram_pct + 0.3 * swap_pct), 6)::DOUBLE AS pressure, cpu_pct >= 90 AS overloaded, disk_pct >= 70 AS io_bound, ram_pct >= 92 OR swap_pct >= 40 AS oom FROM telemetry", "telemetry"))(
    lambda s, d: src.telemetry(s, d).select("seq", fx.headroom(F.col("ram_pct")).alias("headroom"), F.round(fx.pressure_index(F.col("ram_pct"), F.col("swap_pct")), 6).alias("pressure"), (F.col("cpu_pct") >= 90).alias("overloaded"), (F.col("disk_pct") >= 70).alias("io_bound"), ((F.col("ram_pct") >= 92) | (F.col("swap_pct") >= 40)).alias("oom")))
# --- admission policy ------------------------------------------------------------------------
_step = lambda over, b: f"CASE WHEN {over} < 5 THEN {b} WHEN {over} < 15 THEN {2 * b} ELSE {4 * b} END"
_need = lambda c, m: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + " ELSE 0 END"
_ramneed = _need("ram_cost", {"low": 8, "medium": 15, "high": 25})
_rules = [
    ("state = 'cancelled'", "skip", "cancellation_check", "0"), ("priority = 0", "dispatch", "critical_bypass", "0"), ("defer_count >= 30", "force_dispatch", "starvation_valve", "0"),
    ("(bottleneck = 'oom_risk' OR ram_pct >= 92) AND ram_cost NOT IN ('none','low')", "defer", "oom_risk_guard", "5"), ("swap_pct >= 40 AND ram_cost = 'high'", "defer", "oom_risk_guard", "8"),
    ("cpu_pct >= 95 AND cpu_cost NOT IN ('none','low')", "defer", "cpu_threshold", _step("cpu_pct - 95", 2)), ("cpu_cost = 'high' AND cpu_pct >= 80", "defer", "cpu_threshold", _step("cpu_pct - 80", 2)), ("cpu_cost = 'medium' AND cpu_pct >= 88", "defer", "cpu_threshold", _step("cpu_pct - 88", 2)),
    (f"greatest(0, 100 - ram_pct) < {_ramneed}", "defer", "ram_threshold", _step("ram_pct - 75", 4)), ("ram_cost = 'high' AND ram_pct >= 75", "defer", "ram_threshold", "5"), ("ram_cost = 'medium' AND ram_pct >= 85", "defer", "ram_threshold", "4"),
    ("gpu_available AND gpu_cost <> 'none' AND gpu_pct >= 97", "defer", "gpu_threshold", "10"), ("gpu_available AND gpu_cost = 'high' AND gpu_pct >= 85", "defer", "gpu_threshold", _step("gpu_pct - 85", 5)), ("gpu_available AND gpu_cost = 'medium' AND gpu_pct >= 92", "defer", "gpu_threshold", "8"),
    (f"greatest(0, 100 - cpu_pct) < {_need('cpu_cost', {'low': 5, 'medium': 15, 'high': 25})} OR greatest(0, 100 - ram_pct) < {_ramneed} OR (gpu_available AND greatest(0, 100 - gpu_pct) < {_need('gpu_cost', {'low': 5, 'medium': 12, 'high': 20})})", "defer", "cost_level_check", "3"),
]
_case = lambda k: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[k] if k == 3 else repr(r[k])}" for r in _rules) + {1: " ELSE 'dispatch'", 2: " ELSE 'default'", 3: " ELSE 0"}[k] + " END"
_dec = f"dec AS (SELECT *, {_case(1)} AS action, {_case(2)} AS rule, ({_case(3)})::DOUBLE AS retry_s FROM entries)"
_PV = ("tasks", "telemetry", "entries")
query("L1_L8_policy_chain", with_("SELECT task_id, action, rule, retry_s FROM dec", *_PV, more=_dec))(lambda s, d: policy.evaluate(src.entries(s, d)).select("task_id", "action", "rule", "retry_s"))
_OF = lambda *a: "count(*) FILTER (WHERE action IN (" + ", ".join(f"'{x}'" for x in a) + "))"
query("D14_policy_stats", with_(f"SELECT count(*) AS total, {_OF('dispatch')} AS dispatched, {_OF('force_dispatch')} AS forced, {_OF('defer')} AS deferred, {_OF('skip')} AS skipped, {PY(_OF('dispatch', 'force_dispatch') + '::DOUBLE / count(*)', 4)} AS dispatch_rate, {PY(_OF('defer') + '::DOUBLE / count(*)', 4)} AS defer_rate, {PY('avg(cpu_pct) FILTER (WHERE action = ' + repr('defer') + ')', 2)} AS cpu_at_defer, {PY('avg(ram_pct) FILTER (WHERE action = ' + repr('defer') + ')', 2)} AS ram_at_defer FROM dec", *_PV, more=_dec))(lambda s, d: policy.stats(policy.evaluate(src.entries(s, d))))
query("D14_defers_by_rule", with_("SELECT rule, count(*) AS n FROM dec WHERE action = 'defer' GROUP BY 1", *_PV, more=_dec))(lambda s, d: policy.evaluate(src.entries(s, d)).where("action = 'defer'").groupBy("rule").agg(F.count("*").alias("n")))
query("L10_B13_policy_a", with_("SELECT task_id, CASE WHEN defer_count >= 30 THEN 'force_dispatch' WHEN priority = 0 THEN 'dispatch' WHEN bottleneck = 'oom_risk' THEN 'defer' WHEN cpu_pct > 85 AND cpu_cost = 'high' THEN 'defer' WHEN ram_pct > 80 AND ram_cost = 'high' THEN 'defer' WHEN gpu_pct > 90 AND gpu_cost = 'high' THEN 'defer' WHEN 100 - ram_pct < 8 THEN 'defer' ELSE 'dispatch' END AS action FROM entries", *_PV))(
    lambda s, d: src.entries(s, d).select("task_id", F.when(F.col("defer_count") >= 30, "force_dispatch").when(F.col("priority") == 0, "dispatch").when(F.col("bottleneck") == "oom_risk", "defer").when((F.col("cpu_pct") > 85) & (F.col("cpu_cost") == "high"), "defer").when((F.col("ram_pct") > 80) & (F.col("ram_cost") == "high"), "defer").when((F.col("gpu_pct") > 90) & (F.col("gpu_cost") == "high"), "defer").when(100 - F.col("ram_pct") < 8, "defer").otherwise("dispatch").alias("action")))
# --- queue -----------------------------------------------------------------------------------
query("F1_queue_order", with_("SELECT task_id, row_number() OVER (ORDER BY greatest(0, priority - (task_id % 60) // 10), task_id)::INT AS position FROM tasks WHERE status = 'DEFERRED'", "tasks"))(lambda s, d: queue.pop_order(src.tasks(s, d)))
query("F3_peek", with_("SELECT task_id, effective FROM live ORDER BY effective, task_id LIMIT 1", "tasks", more=_LIVE))(lambda s, d: queue.peek(aged(src.tasks(s, d)), cancelled(s, d)))
_AGED = "greatest(0, priority - ticks // 10)"
query("I1_aging", with_(f"SELECT task_id, ({_AGED})::INT AS effective FROM (SELECT *, task_id % 60 AS ticks FROM tasks)", "tasks"))(lambda s, d: queue.aged(src.tasks(s, d).withColumn("ticks", F.col("task_id") % 60)).select("task_id", "effective"))
query("D13_priority_distribution", with_("SELECT n AS name, count(t.task_id) AS n_tasks FROM (VALUES (0,'CRITICAL'),(1,'HIGH'),(2,'MEDIUM'),(3,'LOW'),(4,'BACKGROUND')) v(p, n) LEFT JOIN live t ON t.effective = p GROUP BY 1", "tasks", more=_LIVE))(lambda s, d: queue.distribution(aged(src.tasks(s, d)), cancelled(s, d)))
query("D12_E14_peak_depth", with_("SELECT session, max(depth)::BIGINT AS peak FROM (SELECT session, sum(x) OVER (PARTITION BY session ORDER BY moved, x DESC, task_id ROWS UNBOUNDED PRECEDING) AS depth FROM (SELECT session, task_id, queued_at AS moved, 1 AS x FROM tasks UNION ALL SELECT session, task_id, dispatch_at, -1 FROM tasks WHERE dispatch_at IS NOT NULL)) GROUP BY 1", "tasks"))(lambda s, d: queue.peak_depth(src.tasks(s, d)))
query("C10_B5_pending", with_("SELECT task_id, effective, row_number() OVER (ORDER BY effective, task_id)::INT AS position FROM live", "tasks", more=_LIVE))(lambda s, d: queue.snapshot(aged(src.tasks(s, d)), cancelled(s, d)))
query("B15_worst_case_time", with_("SELECT name, round(backoff_s * (pow(2, max_retries) - 1) + timeout_s * (max_retries + 1), 4)::DOUBLE AS worst_s FROM task_defs", "task_defs"))(lambda s, d: src.task_defs(s).select("name", F.round(F.col("backoff_s") * (F.pow(F.lit(2.0), "max_retries") - 1) + F.col("timeout_s") * (F.col("max_retries") + 1), 4).alias("worst_s")))
query("B3_registry_filters", with_("SELECT name, stage_group FROM task_defs WHERE priority = 2 OR stage_group = 'retrieval'", "task_defs"))(lambda s, d: src.task_defs(s).where("priority = 2 OR stage_group = 'retrieval'").select("name", "stage_group"))
query("B10_signature", with_("SELECT name, cpu_cost || '/' || ram_cost || '/' || gpu_cost AS signature, gpu_cost IN ('medium','high') AS gpu_heavy, cpu_cost = 'high' AS cpu_heavy, ram_cost IN ('medium','high') AS ram_heavy FROM task_defs", "task_defs"))(lambda s, d: src.task_defs(s).select("name", F.concat_ws("/", "cpu_cost", "ram_cost", "gpu_cost").alias("signature"), F.col("gpu_cost").isin("medium", "high").alias("gpu_heavy"), (F.col("cpu_cost") == "high").alias("cpu_heavy"), F.col("ram_cost").isin("medium", "high").alias("ram_heavy")))
query("D23_state_rollup", sql("SELECT stage_group, array_to_string(list_sort(list(name)), ',') AS names, round(sum(estimated_s), 3)::DOUBLE AS total_s FROM task_defs GROUP BY 1", "task_defs"))(lambda s, d: src.task_defs(s).groupBy("stage_group").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"), F.round(F.sum("estimated_s"), 3).alias("total_s")))
# --- corpus ----------------------------------------------------------------------------------
_dom = "dom AS (SELECT cluster_id, category FROM (SELECT cluster_id, category, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, category) AS r FROM papers GROUP BY 1, 2) WHERE r = 1)"
_trend = "md AS (SELECT cluster_id, count(*) AS n, (list_sort(list(year)))[count(*) // 2 + 1] AS mid FROM papers GROUP BY 1), tr AS (SELECT p.cluster_id, CASE WHEN any_value(n) < 4 THEN 'insufficient data' WHEN count(*) FILTER (WHERE year >= mid) > 1.5 * count(*) FILTER (WHERE year < mid) THEN 'growing' WHEN count(*) FILTER (WHERE year >= mid) < 0.6 * count(*) FILTER (WHERE year < mid) THEN 'declining' ELSE 'stagnating' END AS trend FROM papers p JOIN md USING (cluster_id) GROUP BY 1)"
_rate = "rt AS (SELECT cluster_id, round(avg(CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in WORDS) + " THEN 1.0 ELSE 0.0 END), 3) AS rate FROM papers GROUP BY 1)"
P = lambda s, d: src.papers(s, d)
query("G1_first_seen", with_("SELECT min(paper_id) AS paper_id FROM papers GROUP BY text", "papers"))(lambda s, d: corpus.first_seen(P(s, d)))
query("D5_dominant_category", with_("SELECT * FROM dom", "papers", more=_dom))(lambda s, d: corpus.dominant_category(P(s, d)))
query("D6_trend", with_("SELECT * FROM tr", "papers", more=_trend))(lambda s, d: corpus.trend(P(s, d)))
query("D7_year_hist", with_("SELECT year, count(*) AS n FROM papers GROUP BY 1 ORDER BY 1 DESC LIMIT 5", "papers"))(lambda s, d: corpus.year_histogram(P(s, d)))
query("D8_repro_rate", with_("SELECT cluster_id, rate::DOUBLE AS rate FROM rt", "papers", more=_rate))(lambda s, d: corpus.keyword_rate(P(s, d), WORDS))
query("D4_cluster_profile", with_("SELECT cluster_id, count(*) AS n, min(year) AS from_year, max(year) AS to_year, any_value(dom.category) AS category, any_value(trend) AS trend, any_value(rate)::DOUBLE AS rate FROM papers p JOIN dom USING (cluster_id) JOIN tr USING (cluster_id) JOIN rt USING (cluster_id) GROUP BY 1", "papers", more=", ".join((_dom, _trend, _rate))))(lambda s, d: corpus.profile(P(s, d), WORDS))
query("D9_first_keyword", with_("SELECT keyword, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{w}'" for w in WORDS) + " END AS keyword FROM papers) WHERE keyword IS NOT NULL GROUP BY 1", "papers"))(lambda s, d: corpus.first_keyword(P(s, d), WORDS))
query("D10_density", with_("SELECT cluster_id, n, CASE WHEN n < 0.4 * m THEN 'sparse' WHEN n > 1.8 * m THEN 'dense' ELSE 'moderate' END AS density FROM (SELECT cluster_id, count(*) AS n, median(count(*)) OVER () AS m FROM papers WHERE cluster_id >= 0 GROUP BY 1)", "papers"))(lambda s, d: corpus.density(P(s, d)))
query("D25_cluster_counts", with_("SELECT count(DISTINCT cluster_id) FILTER (WHERE cluster_id >= 0) AS clusters, count(*) FILTER (WHERE cluster_id < 0) AS noise FROM papers", "papers"))(lambda s, d: P(s, d).agg(F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("clusters"), F.count_if(F.col("cluster_id") < 0).alias("noise")))
query("K2_cosine_topk", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 5) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 5")(lambda s, d: corpus.cosine_topk(src.table(s, d, "embeddings"), 0))
_tier = _trend + ", sz AS (SELECT cluster_id, count(*) AS cluster_size, row_number() OVER (ORDER BY count(*) DESC, cluster_id) <= 3 AS top FROM papers WHERE cluster_id >= 0 GROUP BY 1), ti AS (SELECT paper_id, p.cluster_id, year, cluster_size, CASE WHEN p.cluster_id < 0 THEN 5 WHEN coalesce(top, false) AND year <= thr - 2 THEN 1 WHEN year >= thr AND trend = 'growing' THEN 4 WHEN p.cluster_id IN (0, 2) THEN 3 ELSE 2 END AS tier FROM papers p LEFT JOIN tr USING (cluster_id) LEFT JOIN sz USING (cluster_id) CROSS JOIN (SELECT max(year) - 1 AS thr FROM papers WHERE cluster_id >= 0))"
_sel = _tier + ", se AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY CASE WHEN tier = 1 THEN year WHEN tier = 2 THEN -cluster_size WHEN tier IN (3, 4) THEN -year ELSE 0 END, paper_id) AS r FROM ti) WHERE r <= (CASE tier WHEN 1 THEN 8 WHEN 2 THEN 10 WHEN 3 THEN 10 WHEN 4 THEN 8 ELSE 4 END))"
T = lambda s, d: corpus.tiers(P(s, d), [0, 2])
S = lambda s, d: corpus.select_by_budget(T(s, d), 40).join(T(s, d).select("paper_id", "year", "cluster_id"), "paper_id")
query("M11_tiers", with_("SELECT paper_id, cluster_id, year, tier FROM ti", "papers", more=_tier))(lambda s, d: T(s, d).drop("cluster_size"))
query("D20_tier_counts", with_("SELECT k AS tier, count(ti.paper_id) AS n FROM range(1, 6) v(k) LEFT JOIN ti ON tier = k GROUP BY 1", "papers", more=_tier))(lambda s, d: s.range(1, 6).select(F.col("id").alias("tier")).join(T(s, d).groupBy("tier").agg(F.count("*").alias("c")), "tier", "left").select("tier", F.coalesce("c", F.lit(0)).cast("long").alias("n")))
query("M14_E12_selection", with_("SELECT paper_id, tier, r::INT AS rank FROM se", "papers", more=_sel))(lambda s, d: corpus.select_by_budget(T(s, d), 40))
query("E11_order", with_("SELECT paper_id, tier, row_number() OVER (ORDER BY tier, CASE WHEN tier = 1 THEN year WHEN tier = 4 THEN -year ELSE 0 END, paper_id)::INT AS reading_order FROM se", "papers", more=_sel))(lambda s, d: corpus.reading_order(S(s, d)))
query("D21_reading_totals", with_("SELECT round(sum(tier * 15) / 60.0, 1)::DOUBLE AS hours, round(sum(tier * 15) / 60.0 / 8, 1)::DOUBLE AS hours_per_week FROM se", "papers", more=_sel))(lambda s, d: S(s, d).agg(F.round(F.sum(F.col("tier") * 15) / 60.0, 1).alias("hours"), F.round(F.sum(F.col("tier") * 15) / 60.0 / 8, 1).alias("hours_per_week")))
query("C5_connects", with_("SELECT paper_id, array_to_string(list_filter(l, lambda x: x <> paper_id)[1:3], ',') AS connects FROM papers JOIN (SELECT cluster_id, list_sort(list(paper_id))[1:4] AS l FROM papers WHERE cluster_id >= 0 GROUP BY 1) USING (cluster_id)", "papers"))(lambda s, d: corpus.connects(P(s, d)))
query("M15_milestones", with_("SELECT tier, ((row_number() OVER (ORDER BY tier) - 1) * (8 // count(*) OVER ()) + 1)::INT AS week_start, least(8, row_number() OVER (ORDER BY tier) * (8 // count(*) OVER ()))::INT AS week_end FROM (SELECT DISTINCT tier FROM se)", "papers", more=_sel))(lambda s, d: scoring.milestones(S(s, d), 8))
# --- gaps and hypotheses ---------------------------------------------------------------------
_gaps = "gaps(gap_id, clusters) AS (VALUES (0, [0, 2]), (1, [1, 2]), (2, [3, 99]))"
_gp = _gaps + ", gc AS (SELECT gap_id, unnest(clusters)::INT AS cluster_id, generate_subscripts(clusters, 1)::INT AS pos FROM gaps)"
query("C1_gap_clusters", with_("SELECT gap_id, gc.cluster_id, pos - 1 AS pos, n FROM gc JOIN (SELECT cluster_id, count(*) AS n FROM papers GROUP BY 1) USING (cluster_id)", "papers", more=_gp))(lambda s, d: scoring.gap_clusters(scoring.gaps(s), P(s, d)))
query("C2_C9_gap_papers", with_("SELECT DISTINCT gap_id, paper_id FROM gc JOIN papers USING (cluster_id)", "papers", more=_gp))(lambda s, d: scoring.gap_papers(scoring.gaps(s), P(s, d)).select("gap_id", "paper_id"))
query("F5_gap_recent", with_("SELECT gap_id, paper_id FROM (SELECT DISTINCT gap_id, paper_id, year FROM gc JOIN papers USING (cluster_id)) QUALIFY row_number() OVER (PARTITION BY gap_id ORDER BY year DESC, paper_id) <= 8", "papers", more=_gp))(lambda s, d: scoring.gap_recent(scoring.gaps(s), P(s, d)))
_evd = _gp + ", " + _trend + ", " + _rate + ", cs AS (SELECT cluster_id, count(*) AS n, any_value(trend) AS trend, any_value(rate) AS rate FROM papers JOIN tr USING (cluster_id) JOIN rt USING (cluster_id) GROUP BY 1), evd AS (SELECT g.gap_id, coalesce(avg(n), 0) AS avg_papers, coalesce(min(rate), 0)::DOUBLE AS min_repro, count(*) FILTER (WHERE trend = 'stagnating') AS stagnating, len(any_value(clusters)) > 1 AS multi, count(n) AS n_clusters FROM gaps g LEFT JOIN gc ON g.gap_id = gc.gap_id LEFT JOIN cs USING (cluster_id) GROUP BY 1)"
query("D11_gap_evidence", with_("SELECT gap_id, round(avg_papers, 4)::DOUBLE AS avg_papers, min_repro, stagnating, multi, n_clusters FROM evd", "papers", more=_evd))(lambda s, d: scoring.gap_evidence(scoring.gaps(s), P(s, d), WORDS))
_nov = ", nv AS (SELECT gap_id, round(CASE WHEN hi = lo THEN 0.5 ELSE 1 - (avg_papers - lo) / (hi - lo) END, 4)::DOUBLE AS sparsity, round(stagnating / greatest(n_clusters, 1), 4)::DOUBLE AS recency, round(1 - min_repro, 4) AS repro_gap, round(least(1, (n_clusters - 1) / 3), 4)::DOUBLE AS distance, round(least(1.0, CASE WHEN multi THEN 0.4 ELSE 0.0 END + 0.2 * n_categories), 4)::DOUBLE AS overlap FROM evd JOIN (SELECT gap_id, count(DISTINCT category) AS n_categories FROM gc LEFT JOIN dom USING (cluster_id) GROUP BY 1) USING (gap_id), (SELECT min(n) AS lo, max(n) AS hi FROM cs))"
query("M1_M7_novelty", with_("SELECT *, round(least(1.0, greatest(0.0, 0.2 * sparsity + 0.2 * recency + 0.15 * repro_gap + 0.15 * distance + 0.15 * overlap + 0.15 * 0.5)), 4)::DOUBLE AS novelty FROM nv", "papers", more=_evd + ", " + _dom + _nov))(lambda s, d: scoring.novelty(scoring.gaps(s), P(s, d), WORDS))
_hy = "h AS (SELECT p_partkey AS id, p_partkey % 7 AS gap_id, p_brand AS method, round((p_partkey * 37 % 101) / 100.0, 4)::DOUBLE AS novelty, round((p_size % 11) / 10.0, 4)::DOUBLE AS feasibility, round((p_partkey * 13 % 51) / 50.0, 4)::DOUBLE AS impact FROM part), hc AS (SELECT *, round(0.4 * novelty + 0.3 * feasibility + 0.3 * impact, 4) AS score FROM h)"
query("M8_composite", with_("SELECT id, score FROM hc", more=_hy))(lambda s, d: scoring.composite(scoring.hypotheses(src.table(s, d, "part"))).select("id", "score"))
query("E9_diversity", with_("SELECT id, round(CASE WHEN row_number() OVER (PARTITION BY method ORDER BY score DESC, id) > 2 THEN greatest(0.0, score - 0.05) ELSE score END, 4)::DOUBLE AS adjusted FROM hc", more=_hy))(lambda s, d: scoring.diversity(scoring.composite(scoring.hypotheses(src.table(s, d, "part")))).select("id", "adjusted"))
query("E10_M9_shortlist", with_("SELECT id, gap_id FROM (SELECT * FROM hc QUALIFY row_number() OVER (PARTITION BY gap_id ORDER BY score DESC, id) <= 2) ORDER BY score DESC, id LIMIT 10", more=_hy))(lambda s, d: scoring.shortlist(scoring.composite(scoring.hypotheses(src.table(s, d, "part"))), 10).select("id", "gap_id"))
# --- keys and scalars ------------------------------------------------------------------------
query("A4_H7_stage_keys", "SELECT doc_id, substr(sha256(lower(trim(source)) || '::' || lang), 1, 16) AS stage_key, substr(md5(source || '|' || upper(lang)), 1, 12) AS query_key FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")(
    lambda s, d: src.table(s, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", fx.stage_key(F.col("source"), F.col("lang")).alias("stage_key"), F.substring(F.md5(F.concat_ws("|", "source", F.upper("lang"))), 1, 12).alias("query_key")))
query("H_strings", "SELECT page_id, lower(url) AS low, split_part(url, '/', 3) AS host, substr(replace(html, chr(10), ' '), 1, 40) AS head FROM pages")(lambda s, d: src.table(s, d, "pages").select("page_id", F.lower("url").alias("low"), F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.substring(F.replace("html", F.lit("\n"), F.lit(" ")), 1, 40).alias("head")))

_week = _sel + """, m AS (SELECT tier, count(*) AS n, row_number() OVER (ORDER BY tier) AS k, greatest(1, 8 // count(*) OVER ()) AS e FROM se GROUP BY tier),
 w AS (SELECT tier, (k - 1) * e + 1 AS ws, least(8, k * e) - (k - 1) * e AS nw, n FROM m)"""
query("E15_weekly", with_("SELECT (ws + (r - 1) // greatest(1, n // greatest(1, nw)))::INT AS week, tier, paper_id FROM se JOIN w USING (tier) WHERE (r - 1) // greatest(1, n // greatest(1, nw)) < nw", "papers", more=_week))(lambda s, d: scoring.weekly(corpus.select_by_budget(T(s, d), 40), 8))
#: Titles to look up on these tables: the fourth is in no text.
TITLES = ["License", "Copyright", "password", "zzqx no such title", "http", "token", "secret"]
query("C7_title_match", "SELECT pos, title, paper_id FROM (" + " UNION ALL ".join(f"SELECT {i} AS pos, '{x}' AS title, min(doc_id) AS paper_id FROM documents WHERE contains(lower(text), lower('{x[:30]}'))" for i, x in enumerate(TITLES)) + ") WHERE paper_id IS NOT NULL ORDER BY pos LIMIT 5")(lambda s, d: scoring.title_match(P(s, d), TITLES))
query("I18_run_lifecycle", with_("SELECT task_id, session, ended_at, run_status, CASE WHEN ended_at IS NULL THEN NULL ELSE greatest(0, date_diff('second', queued_at, ended_at))::DOUBLE END AS duration_s FROM (SELECT *, CASE WHEN ab THEN nx ELSE complete_at END AS ended_at, CASE WHEN ab THEN 'ABORTED' WHEN complete_at IS NULL THEN 'RUNNING' WHEN status = 'FAILED' THEN 'FAILED' ELSE 'COMPLETED' END AS run_status FROM (SELECT *, nx IS NOT NULL AND (complete_at IS NULL OR nx < complete_at) AS ab FROM (SELECT *, lead(queued_at) OVER (PARTITION BY session ORDER BY queued_at, task_id) AS nx FROM tasks)))", "tasks"))(lambda s, d: eventlog.run_lifecycle(src.tasks(s, d)))
# --- tools as table functions ------------------------------------------------------------------
query("P_cluster_tools", ORACLE_SQL["D4_cluster_profile"])(lambda s, d: tools.answered(tools.cells(src.papers(s, d), WORDS)))
query("P_cluster_years", with_("SELECT cluster_id, year, count(*) AS n FROM papers GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY year DESC) <= 3", "papers"))(lambda s, d: tools.years_of(tools.cells(src.papers(s, d), WORDS), 3))
