"""Queries of the deferral and retry machine, with one recursive step an event as their oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import restarts
from ..sources import adapters as src
from .catalogue import query

DEADLINE_S, RETRIES, ESCALATE = 45 * 86400, 2, 5
NOW = "1999-01-01 00:00:00"


def events(s, d):
    """Shipments as events of their supplier: returned ones are failures (a sixth or later line isn't tried again), others deferrals."""
    line, sup = src.table(s, d, "lineitem"), src.table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("session"))
    return line.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_suppkey").alias("task_id"), "session", (F.col("l_suppkey") % 5).cast("int").alias("priority"), F.col("l_shipdate").alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"),
        F.when(F.col("l_returnflag") == "R", "failure").otherwise("deferral").alias("kind"), (F.col("l_linenumber") < 6).alias("retryable"),
    )


def acted(s, d):
    return restarts.machine(events(s, d), DEADLINE_S, RETRIES, escalate_after=ESCALATE)


#: The machine as written down: state by state, an event a step.
_STEP = f"""
ev AS (SELECT l_suppkey AS task_id, s_nationkey AS session, (l_suppkey % 5)::INT AS priority, l_shipdate AS moved, l_orderkey * 10 + l_linenumber AS tie, l_returnflag = 'R' AS failed, l_linenumber < 6 AS retryable,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber) AS i FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate IS NOT NULL),
m(task_id, session, priority, i, moved, tie, failed, retryable, clock, seen, tries, n, eff, live, was_live, act) AS (
 SELECT l_suppkey, 0, (l_suppkey % 5)::INT, 0::BIGINT, NULL::TIMESTAMP, 0::BIGINT, false, true, NULL::TIMESTAMP, NULL::TIMESTAMP, 0, 0, (l_suppkey % 5)::INT, false, false, '' FROM (SELECT DISTINCT l_suppkey FROM lineitem)
 UNION ALL
 SELECT task_id, session, priority, i, moved, tie, failed, retryable,
  CASE WHEN act IN ('EXPIRED', 'SKIPPED', 'EXHAUSTED') THEN NULL ELSE c END, c, CASE WHEN act IN ('EXPIRED', 'SKIPPED', 'EXHAUSTED') THEN -a ELSE a END,
  CASE WHEN act = 'RETRYING' THEN 0 WHEN act IN ('REQUEUED', 'ESCALATED') THEN n + 1 ELSE n END, CASE WHEN act = 'ESCALATED' THEN eff - 1 WHEN act = 'RETRYING' THEN priority ELSE eff END,
  CASE WHEN act IN ('EXPIRED', 'SKIPPED', 'EXHAUSTED') THEN false WHEN act IN ('REQUEUED', 'ESCALATED') THEN true ELSE live END, live, act
 FROM (SELECT *, CASE WHEN failed THEN CASE WHEN NOT retryable THEN 'SKIPPED' WHEN a > {RETRIES} THEN 'EXHAUSTED' ELSE 'RETRYING' END
   WHEN date_diff('second', c, moved) >= {DEADLINE_S} THEN 'EXPIRED' WHEN n + 1 >= {ESCALATE} AND eff > 0 THEN 'ESCALATED' ELSE 'REQUEUED' END AS act
  FROM (SELECT e.task_id, e.session, e.priority, e.i, e.moved, e.tie, e.failed, e.retryable, CASE WHEN e.failed THEN m.clock ELSE coalesce(m.clock, e.moved) END AS c, greatest(m.tries, 0) + e.failed::INT AS a, m.n, m.eff, m.live FROM m JOIN ev e ON e.task_id = m.task_id AND e.i = m.i + 1))),
acted AS (SELECT *, act IN ('REQUEUED', 'ESCALATED') AS put, abs(tries) AS attempt FROM m WHERE i > 0)"""


def _oracle(body: str) -> str:
    return f"WITH RECURSIVE {_STEP} {body}"


_WAIT = "round(least(60.0, 2.0 * pow(2.0, {0} - 1)), 3)"
query("I10_handle_deferrals", _oracle(f"""SELECT task_id, tie, act AS action, CASE WHEN put THEN n ELSE n + 1 END::INT AS defer_number, date_diff('second', seen, moved)::DOUBLE AS elapsed_s,
 CASE WHEN put THEN {_WAIT.format('n')} ELSE 0.0 END::DOUBLE AS backoff_s, CASE WHEN put THEN eff ELSE -1 END::INT AS priority_after FROM acted WHERE NOT failed"""))(
    lambda s, d: acted(s, d).where("kind = 'deferral'").select("task_id", "tie", "action", "defer_number", "elapsed_s", "backoff_s", "priority_after"))
query("I11_retry_outcome", _oracle(f"SELECT task_id, tie, attempt::INT AS attempt, act AS outcome, CASE WHEN act = 'RETRYING' THEN {_WAIT.format('attempt')} ELSE 0.0 END::DOUBLE AS delay_s FROM acted WHERE failed"))(
    lambda s, d: acted(s, d).where("kind = 'failure'").select("task_id", "tie", "attempt", F.col("action").alias("outcome"), F.col("backoff_s").alias("delay_s")))
query("I13_backpressure", _oracle("""SELECT session, task_id, tie, active::BIGINT AS active, CASE WHEN n >= 10 THEN 'task_backpressure' WHEN active >= 5 THEN 'system_overload' ELSE 'none' END AS signal
 FROM (SELECT *, sum(live::INT - was_live::INT) OVER (PARTITION BY session ORDER BY moved, tie ROWS UNBOUNDED PRECEDING) AS active FROM acted) WHERE put"""))(lambda s, d: restarts.pressure_signals(acted(s, d)))
query("D22_active_deferrals", _oracle(f"""SELECT task_id, n::INT AS defer_count, act = 'ESCALATED' AS escalated, date_diff('second', seen, TIMESTAMP '{NOW}')::DOUBLE AS elapsed_s, round(date_diff('second', seen, TIMESTAMP '{NOW}') / {DEADLINE_S} * 100, 1)::DOUBLE AS pct_deadline
 FROM acted WHERE put QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY i DESC) = 1 AND task_id IN (SELECT arg_max(task_id, i) FROM acted GROUP BY task_id HAVING arg_max(live, i))"""))(lambda s, d: restarts.still_deferred(acted(s, d), NOW, DEADLINE_S))
