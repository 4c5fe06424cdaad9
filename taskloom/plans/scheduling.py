"""Queries of queues, policies, logs, telemetry and graphs beyond the catalogue's first ones, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as fx
from ..operators import eventlog, policy, queue
from ..operators import telemetry as tm
from ..sources import adapters as src
from ..sources.adapters import sql
from .catalogue import _PV, _dec, GRP, ev, query, tel, tels, with_

TK = lambda s, d: src.tasks(s, d)
#: Cancelled tasks: orders with a returned line.
CAN = lambda s, d: src.table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("task_id"))
_live = "live AS (SELECT * FROM tasks WHERE status = 'DEFERRED' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = task_id AND l_returnflag = 'R'))"
_can = "can AS (SELECT DISTINCT l_orderkey AS task_id FROM lineitem WHERE l_returnflag = 'R')"

# --- queue -----------------------------------------------------------------------------------
query("E13_aging_after_repush", "WITH RECURSIVE " + src.SQL_VIEWS["tasks"] + """, t AS (SELECT task_id, priority, task_id % 60 AS age0, task_id % 25 AS ticks FROM tasks),
 sim(task_id, age, stop, eff) AS (SELECT task_id, age0, age0 + ticks, priority FROM t UNION ALL
  SELECT task_id, age + 1, stop, CASE WHEN age + 1 >= 50 AND eff > 1 THEN 1 WHEN (age + 1) % 10 = 0 THEN greatest(0, eff - 1) ELSE eff END FROM sim WHERE age < stop)
 SELECT task_id, eff::INT AS effective FROM sim WHERE age = stop""")(lambda s, d: queue.aged_again(TK(s, d).withColumns({"age": F.col("task_id") % 60, "ticks": F.col("task_id") % 25})).select("task_id", "effective"))
query("I2_aging_pending", "WITH RECURSIVE " + src.SQL_VIEWS["tasks"] + """, t AS (SELECT task_id, priority, CASE WHEN defer_count > 0 THEN task_id % 15 ELSE task_id % 45 END AS ticks FROM tasks),
 sim(task_id, k, stop, counter, eff) AS (SELECT task_id, 0, ticks, 0, priority FROM t UNION ALL
  SELECT task_id, k + 1, stop, CASE WHEN counter + 1 >= 10 AND eff > 0 THEN 0 ELSE counter + 1 END, CASE WHEN counter + 1 >= 10 AND eff > 0 THEN eff - 1 ELSE eff END FROM sim WHERE k < stop)
 SELECT task_id, eff::INT AS effective FROM sim WHERE k = stop""")(lambda s, d: queue.aged_pending(TK(s, d).withColumn("pending_ticks", F.when(F.col("defer_count") > 0, F.col("task_id") % 15).otherwise(F.col("task_id") % 45))).select("task_id", "effective"))
query("I3_push", with_("SELECT task_id, row_number() OVER (ORDER BY queued_at, task_id) - 1 AS arrival_seq, priority AS effective, 'pending' AS state FROM tasks", "tasks"))(lambda s, d: queue.push(TK(s, d)))
query("F2_pop_batch", with_("SELECT task_id, greatest(0, priority - (task_id % 60) // 10)::INT AS effective FROM live ORDER BY 2, 1 LIMIT 25", "tasks", more=_live))(lambda s, d: queue.pop_batch(TK(s, d), CAN(s, d), 25))
query("F2_drain", with_("SELECT task_id, row_number() OVER (ORDER BY greatest(0, priority - (task_id % 60) // 10), task_id)::INT AS position FROM live", "tasks", more=_live))(lambda s, d: queue.drain(TK(s, d), CAN(s, d)))
query("B4_peek_by_priority", with_("SELECT task_id, priority FROM live WHERE priority = 2", "tasks", more=_live))(lambda s, d: queue.peek_by_priority(TK(s, d), CAN(s, d), 2))
query("I5_cancel", with_("SELECT t.task_id, priority, CASE WHEN status <> 'DEFERRED' THEN 'gone' WHEN can.task_id IS NOT NULL THEN 'cancelled' ELSE 'pending' END AS state FROM tasks t LEFT JOIN can USING (task_id)", "tasks", more=_can))(lambda s, d: queue.cancel(TK(s, d), CAN(s, d)))
query("I6_cancel_eager", with_("SELECT task_id, priority, CASE WHEN status <> 'DEFERRED' THEN 'gone' ELSE 'pending' END AS state FROM tasks WHERE NOT (status = 'DEFERRED' AND task_id IN (SELECT task_id FROM can))", "tasks", more=_can))(lambda s, d: queue.cancel(TK(s, d), CAN(s, d), eager=True))
query("I4_requeue", with_("SELECT task_id, count(*) FILTER (WHERE event_type = 'DEFERRED') AS defer_count, max(event_at) AS waiting_since, min(priority) AS effective FROM task_events WHERE event_type IN ('QUEUED','DEFERRED') GROUP BY 1", "tasks", "task_events"))(lambda s, d: queue.requeue(ev(s, d)))
query("D12_queue_stats", with_("""SELECT t.session, count(*) AS pushed, count(dispatch_at) AS popped, count(*) FILTER (WHERE status = 'DEFERRED' AND can.task_id IS NOT NULL) AS cancelled, sum(defer_count)::BIGINT AS requeued,
 sum(least(priority, (t.task_id % 60) // 10))::BIGINT AS boosts, coalesce(round(avg(greatest(0, date_diff('second', queued_at, dispatch_at))) FILTER (WHERE dispatch_at IS NOT NULL), 3), 0.0) AS avg_wait, any_value(peak) AS peak
 FROM tasks t LEFT JOIN can USING (task_id) JOIN pk ON pk.session = t.session GROUP BY 1""", "tasks", more=_can + ", mv AS (SELECT session, task_id, queued_at AS moved, 1 AS x FROM tasks UNION ALL SELECT session, task_id, dispatch_at, -1 FROM tasks WHERE dispatch_at IS NOT NULL), pk AS (SELECT session, max(depth)::BIGINT AS peak FROM (SELECT session, sum(x) OVER (PARTITION BY session ORDER BY moved, x DESC, task_id ROWS UNBOUNDED PRECEDING) AS depth FROM mv) GROUP BY 1)"))(lambda s, d: queue.queue_stats(TK(s, d), CAN(s, d)))
query("D15_scheduler_stats", with_("""SELECT count(*) AS submitted, count(dispatch_at) AS dispatched, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'DEFERRED') AS deferred,
 count(*) FILTER (WHERE defer_count >= 5) AS forced, coalesce(round(avg(greatest(0, date_diff('second', queued_at, dispatch_at))) FILTER (WHERE dispatch_at IS NOT NULL), 3), 0.0) AS avg_wait,
 coalesce(round(avg(greatest(0, date_diff('second', dispatch_at, complete_at))) FILTER (WHERE status <> 'DEFERRED' AND dispatch_at IS NOT NULL), 3), 0.0) AS avg_burst, (SELECT max(d) FROM (SELECT sum(x) OVER (ORDER BY moved, x DESC, task_id ROWS UNBOUNDED PRECEDING)::BIGINT AS d FROM (SELECT task_id, queued_at AS moved, 1 AS x FROM tasks UNION ALL SELECT task_id, dispatch_at, -1 FROM tasks WHERE dispatch_at IS NOT NULL))) AS peak FROM tasks""", "tasks"))(lambda s, d: queue.scheduler_stats(TK(s, d)))

# --- policy ----------------------------------------------------------------------------------
_SNAP = ["cpu_pct", "ram_pct", "swap_pct", "gpu_pct", "gpu_available", "bottleneck"]


def _batch(s, d):
    e = src.entries(s, d)
    snap = s.createDataFrame([(87.0, 50.0, 0.0, 30.0, True, "cpu_bound")], "cpu_pct double, ram_pct double, swap_pct double, gpu_pct double, gpu_available boolean, bottleneck string")
    return policy.evaluate_batch(e.drop(*_SNAP), snap).select("task_id", "action", "rule", "retry_s")


_one = "entries2 AS (SELECT task_id, task_name, priority, defer_count, state, cpu_cost, ram_cost, gpu_cost, 87.0::DOUBLE AS cpu_pct, 50.0::DOUBLE AS ram_pct, 0.0::DOUBLE AS swap_pct, 30.0::DOUBLE AS gpu_pct, true AS gpu_available, 'cpu_bound' AS bottleneck FROM entries), "
query("L11_policy_batch", with_("SELECT task_id, action, rule, retry_s FROM dec", *_PV, more=_one + _dec.replace("FROM entries)", "FROM entries2)")))(_batch)


def _edited(s, d):
    chain = policy.Chain()
    chain.remove("critical")
    chain.prepend(lambda: F.when(F.col("defer_count") % 10 == 9, policy.decide("skip", "tenth", 1.0)))
    return chain.evaluate(src.entries(s, d)).groupBy("rule", "action").agg(F.count("*").alias("n"))


_noncrit = "e3 AS (SELECT * REPLACE (CASE WHEN priority = 0 THEN 1 ELSE priority END AS priority) FROM entries), "
query("L12_edited_chain", with_("SELECT CASE WHEN defer_count % 10 = 9 THEN 'tenth' ELSE rule END AS rule, CASE WHEN defer_count % 10 = 9 THEN 'skip' ELSE action END AS action, count(*) AS n FROM dec GROUP BY 1, 2", *_PV, more=_noncrit + _dec.replace("FROM entries)", "FROM e3)")))(_edited)

# --- logs ------------------------------------------------------------------------------------
query("B12_retryable", with_("SELECT name, name NOT IN ('KeyboardInterrupt','SystemExit','ValueError','NotImplementedError','ImportError','TaskExpiredError','RetryBudgetExhaustedError') AS retryable FROM (SELECT DISTINCT (['ValueError','TimeoutError','ImportError','RateLimitError','SystemExit','Odd'])[1 + task_id % 6] AS name FROM tasks)", "tasks"))(
    lambda s, d: TK(s, d).select(F.element_at(F.array(*[F.lit(x) for x in ("ValueError", "TimeoutError", "ImportError", "RateLimitError", "SystemExit", "Odd")]), (F.col("task_id") % 6 + 1).cast("int")).alias("name")).distinct().withColumn("retryable", eventlog.retryable("name")))
def _recorded(s, d):
    t = tm.throttle_instant(tels(s, d)).join(src.telemetry(s, d).select("seq", "ts"), "seq").select(F.col("ts").alias("at"), (F.col("cap") == 1).alias("throttled"))
    return eventlog.record_lifecycle(ev(s, d), t).groupBy("event").agg(F.count("*").alias("n"), F.sum("wait_s").alias("wait_s"), F.sum("burst_s").alias("burst_s"), F.sum("turnaround_s").alias("turnaround_s"), F.min("event_at").alias("first_at"))


query("I15_lifecycle", with_("""SELECT event, count(*) AS n, sum(w)::BIGINT AS wait_s, sum(b)::BIGINT AS burst_s, sum(t)::BIGINT AS turnaround_s, min(event_at) AS first_at FROM (
 SELECT CASE WHEN event_type = 'DISPATCHED' AND defer_count >= 5 THEN 'FORCE_DISPATCHED' WHEN event_type = 'DEFERRED' AND task_id % 41 = 0 THEN 'CANCELLED' ELSE event_type END AS event, event_at,
  CASE WHEN event_type IN ('DISPATCHED','COMPLETED','FAILED') THEN greatest(0, date_diff('second', queued_at, dispatch_at)) ELSE 0 END AS w,
  CASE WHEN event_type IN ('COMPLETED','FAILED') THEN greatest(0, date_diff('second', dispatch_at, complete_at)) ELSE 0 END AS b,
  CASE WHEN event_type IN ('COMPLETED','FAILED') THEN greatest(0, date_diff('second', queued_at, complete_at)) ELSE 0 END AS t FROM task_events
 UNION ALL SELECT CASE WHEN cap = 1 THEN 'THROTTLED' ELSE 'UNTHROTTLED' END, ts, 0, 0, 0 FROM (SELECT *, lag(cap, 1, 3) OVER (PARTITION BY pid ORDER BY ts, seq) AS p FROM (SELECT *, CASE WHEN cpu_pct > 85 OR bottleneck IN ('oom_risk','cpu_bound') THEN 1 ELSE 3 END AS cap FROM bt)) WHERE p <> cap) GROUP BY 1""",
    "tasks", "task_events", "telemetry", more=GRP + ", bt AS (SELECT *, CASE WHEN ram_pct > 92 OR swap_pct > 40 THEN 'oom_risk' WHEN gpu_pct > 90 THEN 'gpu_bound' WHEN ram_pct > 80 AND cpu_pct < 60 THEN 'memory_bound' WHEN disk_pct > 70 AND cpu_pct < 50 THEN 'io_bound' WHEN streak >= 3 OR cpu_pct > 95 THEN 'cpu_bound' ELSE 'none' END AS bottleneck FROM tl)"))(_recorded)
query("I16_audit_trail", with_("SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY event_at, event_type)::INT AS entry, event_type, event_at FROM task_events WHERE task_id IN (1, 2, 3, 4, 5, 6, 7, 32, 33, 34) AND event_type IN ('DEFERRED','FAILED')", "tasks", "task_events"))(lambda s, d: eventlog.audit_trail(ev(s, d), [1, 2, 3, 4, 5, 6, 7, 32, 33, 34]))
query("D1_dispatch_resources", with_("""SELECT count(*) FILTER (WHERE defer_count >= 5) AS starvation, coalesce(round(avg(cpu_pct) FILTER (WHERE pl), 4), 0.0) AS avg_cpu, coalesce(max(cpu_pct) FILTER (WHERE pl), 0.0) AS max_cpu, coalesce(round(avg(ram_pct) FILTER (WHERE pl), 4), 0.0) AS avg_ram, coalesce(max(ram_pct) FILTER (WHERE pl), 0.0) AS max_ram
 FROM (SELECT e.defer_count, t.cpu_pct, t.ram_pct, event_type = 'DISPATCHED' AND e.defer_count < 5 AS pl FROM task_events e LEFT JOIN telemetry t ON t.seq = e.task_id WHERE event_type IN ('DISPATCHED','COMPLETED','FAILED'))""", "tasks", "task_events", "telemetry"))(
    lambda s, d: eventlog.dispatch_resources(ev(s, d), src.telemetry(s, d)).withColumns({"max_cpu": F.col("max_cpu"), "max_ram": F.col("max_ram")}))


def _runs(s, d):
    e = src.table(s, d, "events")
    by = e.groupBy("user_id", "event_type").agg(F.collect_list("value").alias("v"))
    runs = by.groupBy(F.col("user_id").alias("run_id")).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("metrics"))
    return eventlog.run_catalogue(runs.withColumns({"alerts": F.array_repeat(F.lit("a"), (F.col("run_id") % 4).cast("int")), "bottlenecks": F.array_repeat(F.lit("b"), (F.col("run_id") % 3).cast("int"))}))


query("A11_run_catalogue", "SELECT user_id AS run_id, count(*)::INT AS n_metrics, (user_id % 4)::INT AS n_alerts, (user_id % 3)::INT AS n_bottlenecks FROM events GROUP BY 1")(_runs)
query("N2_status", with_("SELECT session, string_agg(status || '=' || n, ' ' ORDER BY status) AS status FROM (SELECT session, status, count(*) AS n FROM tasks GROUP BY 1, 2) GROUP BY 1", "tasks"))(
    lambda s, d: TK(s, d).groupBy("session", "status").agg(F.count("*").alias("n")).groupBy("session").agg(F.array_join(F.array_sort(F.collect_list(F.concat("status", F.lit("="), F.col("n").cast("string")))), " ").alias("status")))

# --- telemetry -------------------------------------------------------------------------------
query("E6_E7_disk_rates", with_("""SELECT seq, pid, CASE WHEN t0 IS NULL THEN 0.0 ELSE round(greatest(0.0, (read_bytes - b) / 1048576.0 / dt), 3) END::DOUBLE AS read_mb_s,
 CASE WHEN t0 IS NULL THEN 0.0 ELSE round(least(100.0, greatest(0.0, (busy_ms - m) / 1000.0 / dt * 100.0)), 1) END::DOUBLE AS busy_pct, CASE WHEN t0 IS NULL THEN 0.0 ELSE round(greatest(0.0, (ctx - c) / 2.0), 4) END::DOUBLE AS ctx_per_s FROM (
 SELECT *, CASE WHEN date_diff('microsecond', t0, ts) > 0 THEN date_diff('microsecond', t0, ts) / 1e6 ELSE 2.0 END AS dt FROM (SELECT *, lag(read_bytes) OVER w AS b, lag(busy_ms) OVER w AS m, lag(ctx) OVER w AS c, lag(ts) OVER w AS t0 FROM cn WINDOW w AS (PARTITION BY pid ORDER BY ts, seq)))""", "telemetry",
    more="cn AS (SELECT seq, pid, ts, sum((seq % 1000) * 1048576) OVER v AS read_bytes, sum(seq % 700000) OVER v AS busy_ms, sum(seq % 313) OVER v AS ctx FROM telemetry WINDOW v AS (PARTITION BY pid ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))"))(
    lambda s, d: tm.disk_rates(tm.by_pid(src.telemetry(s, d)).running({"read_bytes": ("sum", (F.col("seq") % 1000) * 1048576), "busy_ms": ("sum", F.col("seq") % 700000), "ctx": ("sum", F.col("seq") % 313)})))
query("I5_cancel_by_name", with_("SELECT task_name, (SELECT count(*) FROM live l WHERE 'job-' || l.session % 40 = n.task_name) AS n FROM (SELECT DISTINCT 'job-' || c_custkey % 50 AS task_name FROM customer) n", "tasks", more=_live))(
    lambda s, d: queue.cancel_by_name(TK(s, d).withColumn("task_name", F.concat(F.lit("job-"), (F.col("session") % 40).cast("string"))), CAN(s, d), src.table(s, d, "customer").select(F.concat(F.lit("job-"), (F.col("c_custkey") % 50).cast("string")).alias("task_name"))))
query("I5_clear", with_("SELECT task_id, status FROM tasks WHERE status <> 'DEFERRED'", "tasks"))(lambda s, d: queue.cleared(TK(s, d)).select("task_id", "status"))
query("D15_peak_depth_whole", with_("""SELECT d AS peak, min(moved) AS peak_at FROM dd WHERE d = (SELECT max(d) FROM dd) GROUP BY 1""", "tasks", more="""mv AS (SELECT task_id, queued_at AS moved, 1 AS x FROM tasks UNION ALL SELECT task_id, dispatch_at, -1 FROM tasks WHERE dispatch_at IS NOT NULL),
 dd AS (SELECT moved, sum(x) OVER (ORDER BY moved, x DESC, task_id ROWS UNBOUNDED PRECEDING)::BIGINT AS d FROM mv)"""))(lambda s, d: queue.peak_depth_whole(TK(s, d)))
query("F4_top_processes", with_("SELECT pid, cpu_pct FROM (SELECT * FROM (SELECT * FROM pr ORDER BY cpu_pct DESC, pid LIMIT 10) UNION SELECT * FROM pr WHERE pid IN (1, 2, 3))", "telemetry", more="pr AS (SELECT pid, arg_max(cpu_pct, seq) AS cpu_pct FROM telemetry GROUP BY 1)"))(lambda s, d: tm.top_processes(src.telemetry(s, d).groupBy("pid").agg(F.max_by("cpu_pct", "seq").alias("cpu_pct")), [1, 2, 3]))


def _nested(s, d):
    t, k = src.telemetry(s, d), F.col("seq")
    return t.select("seq", F.when(k % 7 > 0, F.struct(F.col("cpu_pct").alias("overall_pct"))).alias("cpu"), F.when(k % 5 > 0, F.struct(F.col("ram_pct").alias("used_pct"), F.when(k % 2 > 0, 8.5).alias("available_gb"), "swap_pct")).alias("memory"),
                    F.when(k % 3 > 0, F.struct((k % 2 > 0).alias("available"), F.col("gpu_pct").alias("vram_used_pct"))).alias("gpu"), F.when(k % 11 > 0, "io_bound").alias("bottleneck"))


query("B11_A17_flat_snapshot", with_("""SELECT seq, CASE WHEN seq % 7 > 0 THEN cpu_pct ELSE 0.0 END AS cpu_pct, CASE WHEN seq % 5 > 0 THEN ram_pct ELSE 0.0 END AS ram_used_pct, CASE WHEN seq % 5 > 0 AND seq % 2 > 0 THEN 8.5 ELSE 16.0 END::DOUBLE AS ram_available_gb, CASE WHEN seq % 5 > 0 THEN swap_pct ELSE 0.0 END AS swap_pct,
 seq % 3 > 0 AND seq % 2 > 0 AS gpu_available, CASE WHEN seq % 3 > 0 THEN gpu_pct ELSE 0.0 END AS gpu_vram_pct, CASE WHEN seq % 11 > 0 THEN 'io_bound' ELSE 'none' END AS bottleneck FROM telemetry""", "telemetry"))(lambda s, d: tm.flat_snapshot(_nested(s, d)))
query("B9_bytes", "SELECT page_id, round(octet_length(encode(html)) / 1048576.0, 6)::DOUBLE AS mb, round(octet_length(encode(html)) / 1073741824.0, 9)::DOUBLE AS gb FROM pages WHERE html IS NOT NULL")(lambda s, d: src.table(s, d, "pages").where("html IS NOT NULL").select("page_id", F.round(fx.megabytes(F.octet_length("html")), 6).alias("mb"), F.round(fx.gigabytes(F.octet_length("html")), 9).alias("gb")))
_sig = "CASE WHEN n >= 5 AND (min(cpu_pct) OVER w > 80 OR min(ram_pct) OVER w > 80) OR bottleneck = 'oom_risk' THEN 'THROTTLED' WHEN n >= 5 AND max(cpu_pct) OVER w < 60 AND max(ram_pct) OVER w < 60 AND bottleneck = 'none' THEN 'NORMAL' END"
_bt = "bt AS (SELECT *, CASE WHEN ram_pct > 92 OR swap_pct > 40 THEN 'oom_risk' WHEN gpu_pct > 90 THEN 'gpu_bound' WHEN ram_pct > 80 AND cpu_pct < 60 THEN 'memory_bound' WHEN disk_pct > 70 AND cpu_pct < 50 THEN 'io_bound' WHEN streak >= 3 OR cpu_pct > 95 THEN 'cpu_bound' ELSE 'none' END AS bottleneck2 FROM tl), b2 AS (SELECT seq, pid, ts, cpu_pct, ram_pct, bottleneck2 AS bottleneck FROM bt)"
query("I9_latch_transitions", with_(f"""SELECT seq, pid, p AS old, st AS new FROM (SELECT *, lag(st, 1, 'NORMAL') OVER (PARTITION BY pid ORDER BY ts, seq) AS p FROM (
 SELECT *, coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY pid ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 'NORMAL') AS st FROM (
 SELECT *, {_sig} AS sig FROM (SELECT *, count(*) OVER (PARTITION BY pid ORDER BY ts, seq ROWS 4 PRECEDING) AS n FROM b2) WINDOW w AS (PARTITION BY pid ORDER BY ts, seq ROWS 4 PRECEDING)))) WHERE p <> st""", "telemetry", more=GRP + ", " + _bt))(lambda s, d: tm.latch_transitions(tels(s, d)))

query("B6_lookup", sql("SELECT name, priority FROM task_defs WHERE name = 'alert_drain'", "task_defs"))(lambda s, d: src.task_defs(s).where("name = 'alert_drain'").select("name", "priority"))
