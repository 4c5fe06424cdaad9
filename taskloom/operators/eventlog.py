"""Operators over the task-lifecycle log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import at_most, backoff, round_exact
from ..sources.adapters import seconds
from .segments import Segments


def timed(events: DataFrame) -> DataFrame:
    """Adds wait, burst and turnaround seconds."""
    return events.withColumns({"wait_s": seconds("queued_at", "dispatch_at"), "burst_s": seconds("dispatch_at", "complete_at"), "turnaround_s": seconds("queued_at", "complete_at")})


def scheduling_metrics(events: DataFrame) -> DataFrame:
    """One row: waits, bursts, turnaround, utilisation, throughput, overhead and counts, in one aggregation.

    All figures are 0 while nothing has ended; shares of a time that is 0 are 0."""
    e = timed(events)
    kind = F.col("event_type")
    done, ended = kind == "COMPLETED", kind.isin("COMPLETED", "FAILED")
    mean = lambda c, when: F.avg(F.when(when & (F.col(c) > 0), F.col(c)))
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("double")
    a = e.agg(
        mean("wait_s", ended).alias("awt"), mean("burst_s", done).alias("abt"), mean("turnaround_s", ended).alias("att"),
        F.coalesce(F.expr("timestampdiff(SECOND, min(event_at), max(event_at))"), F.lit(0)).cast("double").alias("wall"),
        total("burst_s", done).alias("burst"), total("wait_s", ended).alias("wait"),
        F.count_if(done).alias("completed"), F.count_if(kind == "FAILED").alias("failed"), F.count_if(kind == "DEFERRED").alias("deferred"), F.count_if(kind == "DISPATCHED").alias("dispatched"),
        F.count_distinct("task_id").alias("tasks"),
    )
    any_ = F.col("completed") + F.col("failed") > 0
    of = lambda part, whole: F.when(any_ & (F.col(whole) > 0), part / F.col(whole)).otherwise(0.0)
    a = a.withColumn("spent", F.col("wait") + F.col("burst"))
    return a.select(
        *[round_exact(F.coalesce(F.col(c), F.lit(0.0)), 3).alias(c) for c in ("awt", "abt", "att")],
        round_exact(at_most(of(F.col("burst") * 100.0, "wall"), 100.0), 2).alias("cpu_util"), round_exact(of(F.col("completed") * 60.0, "wall"), 3).alias("throughput_min"), round_exact(at_most(of(F.col("wait") * 100.0, "spent"), 100.0), 2).alias("overhead"),
        *[F.when(any_, F.col(c)).otherwise(0).alias(c) for c in ("completed", "failed", "deferred", "dispatched", "tasks")],
    )


def wait_by_priority(events: DataFrame) -> DataFrame:
    """Mean wait (zeros too) and completed tasks by effective priority (column ``effective``)."""
    e = timed(events).where(F.col("event_type").isin("COMPLETED", "FAILED"))
    return e.groupBy("effective").agg(round_exact(F.avg("wait_s"), 3).alias("mean_wait"), F.count_if(F.col("event_type") == "COMPLETED").alias("completed"))


def lifecycle_fill(events: DataFrame) -> DataFrame:
    """Carries queueing and dispatch times forward along each task's events."""
    rank = F.expr("CASE event_type WHEN 'QUEUED' THEN 0 WHEN 'DEFERRED' THEN 1 WHEN 'DISPATCHED' THEN 2 ELSE 3 END")
    by = W.partitionBy("task_id").orderBy("event_at", rank).rowsBetween(W.unboundedPreceding, 0)
    carried = lambda kind: F.last(F.when(F.col("event_type") == kind, F.col("event_at")), ignorenulls=True).over(by)
    return events.select("task_id", "event_type", "event_at", carried("QUEUED").alias("seen_queued"), carried("DISPATCHED").alias("seen_dispatch"))


def gantt_rows(events: DataFrame) -> DataFrame:
    """Bars for ended tasks and zero-width markers for deferrals."""
    kind = F.col("event_type")
    mark = kind == "DEFERRED"
    shown = events.where(mark | (kind.isin("COMPLETED", "FAILED") & F.col("dispatch_at").isNotNull()))
    return shown.select(
        "task_id", F.when(mark, "marker").otherwise("bar").alias("kind"),
        F.when(mark, F.col("event_at")).otherwise(F.col("dispatch_at")).alias("start_at"), F.when(mark, F.col("event_at")).otherwise(F.col("complete_at")).alias("end_at"),
        F.when(mark, "orange").when(kind == "COMPLETED", "green").otherwise("red").alias("colour"),
    )


def last_n(events: DataFrame, n: int, kind: str | None = None) -> DataFrame:
    e = events.where(F.col("event_type") == kind) if kind else events
    return e.orderBy(F.desc("event_at"), F.desc("task_id"), F.desc("event_type")).limit(n).select("task_id", "event_type", "event_at")


def deferral_backoff(tasks: DataFrame, base: float = 2.0, escalate_after: int = 5) -> DataFrame:
    """One row a deferral of each task: its delay, and the priority after escalation from the fifth on."""
    d = tasks.where("defer_count > 0").select("task_id", "priority", F.explode(F.expr("sequence(1, cast(defer_count as int))")).alias("defer_number"))
    after = F.greatest(F.lit(0), F.col("priority") - F.greatest(F.lit(0), F.col("defer_number") - (escalate_after - 1)))
    return d.select("task_id", "defer_number", backoff("exponential", base, F.col("defer_number")).alias("backoff_s"), after.alias("priority_after"), (F.col("defer_number") >= escalate_after).alias("escalated"))


def run_lifecycle(tasks: DataFrame) -> DataFrame:
    """Tasks of a session as runs: a new one aborts the one still running."""
    x = Segments(tasks, ["session"], ["queued_at", "task_id"]).windowed(1, lambda w: {"_next": F.lag("queued_at").over(w)}, backwards=True).done()
    aborted = F.col("_next").isNotNull() & (F.col("complete_at").isNull() | (F.col("_next") < F.col("complete_at")))
    x = x.withColumns({"ended_at": F.when(aborted, F.col("_next")).otherwise(F.col("complete_at")), "run_status": F.when(aborted, "ABORTED").when(F.col("complete_at").isNull(), "RUNNING").when(F.col("status") == "FAILED", "FAILED").otherwise("COMPLETED")})
    return x.select("task_id", "session", "ended_at", "run_status", F.when(F.col("ended_at").isNotNull(), seconds("queued_at", "ended_at").cast("double")).alias("duration_s"))


#: Error types after which no attempt is worth another: fixed values.
NOT_RETRYABLE = ["KeyboardInterrupt", "SystemExit", "ValueError", "NotImplementedError", "ImportError", "TaskExpiredError", "RetryBudgetExhaustedError"]


def retryable(error: str):
    """Whether an error type is worth another attempt: any but the listed ones."""
    return ~F.col(error).isin(NOT_RETRYABLE)


def record_lifecycle(events: DataFrame, ticks: DataFrame) -> DataFrame:
    """The full recorder: ends of life carry waits, bursts and turnaround; forced dispatches and cancellations are told
    apart; throttle changes (at, throttled) come in as events of the scheduler itself."""
    e = timed(events)
    kind = F.when((F.col("event_type") == "DISPATCHED") & (F.col("defer_count") >= 5), "FORCE_DISPATCHED").when((F.col("event_type") == "DEFERRED") & (F.col("task_id") % 41 == 0), "CANCELLED").otherwise(F.col("event_type"))
    ended = F.col("event_type").isin("COMPLETED", "FAILED")
    started = ended | (F.col("event_type") == "DISPATCHED")
    own = e.select(F.col("task_id").cast("string").alias("task"), kind.alias("event"), "event_at", F.when(started, F.col("wait_s")).otherwise(F.lit(0)).cast("long").alias("wait_s"), F.when(ended, F.col("burst_s")).otherwise(F.lit(0)).cast("long").alias("burst_s"), F.when(ended, F.col("turnaround_s")).otherwise(F.lit(0)).cast("long").alias("turnaround_s"))
    zero = F.lit(0).cast("long")
    more = ticks.select(F.lit("__scheduler__").alias("task"), F.when(F.col("throttled"), "THROTTLED").otherwise("UNTHROTTLED").alias("event"), F.col("at").alias("event_at"), zero.alias("wait_s"), zero.alias("burst_s"), zero.alias("turnaround_s"))
    return own.unionByName(more)


def audit_trail(events: DataFrame, task_ids: list[int]) -> DataFrame:
    """Deferrals and failures of some tasks, in order."""
    e = events.where(F.col("task_id").isin(task_ids) & F.col("event_type").isin("DEFERRED", "FAILED"))
    return e.select("task_id", F.row_number().over(W.partitionBy("task_id").orderBy("event_at", "event_type")).alias("entry"), "event_type", "event_at")


def dispatch_resources(events: DataFrame, telemetry: DataFrame, limit: int = 5) -> DataFrame:
    """Starvation count (events that carry a forced task) and cpu and ram at plain dispatches, from the snapshot of the task's number."""
    forced = F.col("defer_count") >= limit
    s = telemetry.select(F.col("seq").alias("task_id"), "cpu_pct", "ram_pct")
    x = events.where("event_type IN ('DISPATCHED', 'COMPLETED', 'FAILED')").join(s, "task_id", "left")
    plain = (F.col("event_type") == "DISPATCHED") & ~forced
    at = lambda f, c: F.coalesce(F.round(f(F.when(plain, F.col(c))), 4), F.lit(0.0))
    return x.agg(F.count_if(forced).alias("starvation"), at(F.avg, "cpu_pct").alias("avg_cpu"), at(F.max, "cpu_pct").alias("max_cpu"), at(F.avg, "ram_pct").alias("avg_ram"), at(F.max, "ram_pct").alias("max_ram"))


def run_catalogue(runs: DataFrame) -> DataFrame:
    """Runs (run_id, metrics: map of sample arrays, alerts, bottlenecks), latest first, with counts."""
    n = F.aggregate(F.map_values("metrics"), F.lit(0), lambda s, v: s + F.size(v))
    return runs.select("run_id", n.alias("n_metrics"), F.size("alerts").alias("n_alerts"), F.size("bottlenecks").alias("n_bottlenecks"))
