"""Priority queue operators: a queue is an ordering, aging is arithmetic on ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.adapters import seconds
from .segments import Segments

NAMES = [(0, "CRITICAL"), (1, "HIGH"), (2, "MEDIUM"), (3, "LOW"), (4, "BACKGROUND")]


def aged(tasks: DataFrame) -> DataFrame:
    """``effective`` priority of a first enqueue after ``ticks``: one step every ten, not under 0.

    The step to HIGH at fifty ticks can't show here: from any priority 0 is reached by then (see ``aged_again``)."""
    return tasks.withColumn("effective", F.greatest(F.lit(0), F.col("priority") - F.floor(F.col("ticks") / 10)).cast("int"))


def aged_again(tasks: DataFrame) -> DataFrame:
    """``effective`` priority ``ticks`` after a re-push, which resets the priority but keeps ``age`` ticks.

    The first tick at an age of fifty or more sets what is still over HIGH to HIGH; every tenth age is a step else."""
    age, end, p = F.col("age"), F.col("age") + F.col("ticks"), F.col("priority")
    tens = lambda x: F.floor(x / 10)
    low = lambda x: F.greatest(F.lit(0), x)
    first = F.greatest(F.lit(50), age + 1)
    before = low(p - (tens(first - 1) - tens(age)))
    at = F.when(before > 1, 1).when(first % 10 == 0, low(before - 1)).otherwise(before)
    forced = low(at - (tens(end) - tens(first)))
    return tasks.withColumn("effective", F.when(F.col("ticks") < 1, p).when(end < first, low(p - (tens(end) - tens(age)))).otherwise(forced).cast("int"))


def aged_pending(tasks: DataFrame) -> DataFrame:
    """The other form: only ticks that a task was pending count, the counter starts anew at each step, and no step is forced."""
    return tasks.withColumn("effective", F.greatest(F.lit(0), F.col("priority") - F.floor(F.col("pending_ticks") / 10)).cast("int"))


def numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """``out``: each row's place from 0 along ``order`` (a time first): a running count over chunks of time."""
    one = Segments(rows.withColumn("_all", F.lit(1)), ["_all"], order)
    return one.running({out: ("count", F.lit(1))}, upto=-1).done().withColumn(out, F.col(out).cast("long")).drop("_all")


def push(tasks: DataFrame) -> DataFrame:
    """Arrival numbers by time of submission; the effective priority starts at the nominal one, the state is pending."""
    seq = numbered(tasks, ["queued_at", "task_id"], "arrival_seq")
    return seq.select("task_id", "arrival_seq", F.col("priority").alias("effective"), F.lit("pending").alias("state"))


def live(tasks: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Waiting tasks without those cancelled (column task_id)."""
    return tasks.where("status = 'DEFERRED'").join(cancelled.select("task_id").distinct(), "task_id", "left_anti")


def pop_batch(tasks: DataFrame, cancelled: DataFrame, n: int) -> DataFrame:
    """The first ``n`` live tasks by effective priority and arrival: an ordered limit, kept per partition before it is merged."""
    x = live(tasks, cancelled).select("task_id", F.greatest(F.lit(0), F.col("priority") - F.floor(F.col("task_id") % 60 / 10)).cast("int").alias("effective"))
    return x.orderBy("effective", "task_id").limit(n)


def drain(tasks: DataFrame, cancelled: DataFrame) -> DataFrame:
    """All live tasks with their positions."""
    return pop_order(live(tasks, cancelled))


def peek_by_priority(tasks: DataFrame, cancelled: DataFrame, priority: int) -> DataFrame:
    """Live tasks of a nominal priority."""
    return live(tasks, cancelled).where(F.col("priority") == priority).select("task_id", "priority")


def cancel(tasks: DataFrame, ids: DataFrame, eager: bool = False) -> DataFrame:
    """State of each task after cancelling ``ids``: waiting tasks only.  ``eager``: cancelled ones leave at once."""
    hit = ids.select("task_id", F.lit(True).alias("_hit")).distinct()
    x = tasks.join(hit, "task_id", "left")
    state = F.when(F.col("_hit") & (F.col("status") == "DEFERRED"), "cancelled").when(F.col("status") == "DEFERRED", "pending").otherwise("gone")
    x = x.select("task_id", "priority", state.alias("state"))
    return x.where("state <> 'cancelled'") if eager else x


def cancel_by_name(tasks: DataFrame, cancelled: DataFrame, names: DataFrame) -> DataFrame:
    """(task_name, n): waiting tasks of each of ``names`` (task_name) that weren't cancelled before; 0 for a name that none has."""
    own = live(tasks, cancelled).groupBy("task_name").agg(F.count("*").alias("n"))
    return names.select("task_name").distinct().join(own, "task_name", "left").select("task_name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cleared(tasks: DataFrame) -> DataFrame:
    """A queue after it was cleared: what waited is gone, what was popped stays."""
    return tasks.where("status <> 'DEFERRED'")


def snapshot(tasks: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Live tasks (column ``effective``) with their place in the order of popping."""
    own = live(tasks, cancelled)
    return own.select("task_id", "effective").join(pop_order(own), "task_id")


def requeue(events: DataFrame) -> DataFrame:
    """Requeues folded from the log: how often, since when a task waits now; priority and place in line stay."""
    d = events.where("event_type IN ('QUEUED', 'DEFERRED')")
    return d.groupBy("task_id").agg(F.count_if(F.col("event_type") == "DEFERRED").alias("defer_count"), F.max("event_at").alias("waiting_since"), F.min("priority").alias("effective"))


def _spent(a: str, b: str):
    """Seconds from ``a`` to ``b``, not under 0; null where either is."""
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), seconds(a, b))


def queue_stats(tasks: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Counters of each session's queue: pushed, popped, cancelled, requeued, boosts, mean wait and peak depth."""
    hit = cancelled.select("task_id", F.lit(True).alias("_hit")).distinct()
    wait = _spent("queued_at", "dispatch_at")
    x = tasks.join(hit, "task_id", "left").groupBy("session").agg(
        F.count("*").alias("pushed"), F.count("dispatch_at").alias("popped"), F.count_if(F.col("_hit") & (F.col("status") == "DEFERRED")).alias("cancelled"), F.sum("defer_count").alias("requeued"),
        F.sum(F.least(F.col("priority"), F.floor(F.col("task_id") % 60 / 10))).cast("long").alias("boosts"), F.coalesce(F.round(F.avg(wait), 3), F.lit(0.0)).alias("avg_wait"),
    )
    return x.join(peak_depth(tasks), "session")


def scheduler_stats(tasks: DataFrame) -> DataFrame:
    """One row of totals, with mean wait and burst, and the most tasks that waited at once."""
    wait = _spent("queued_at", "dispatch_at")
    burst = F.when(F.col("status") != "DEFERRED", _spent("dispatch_at", "complete_at"))
    is_ = lambda k: F.count_if(F.col("status") == k)
    totals = tasks.agg(
        F.count("*").alias("submitted"), F.count("dispatch_at").alias("dispatched"), is_("COMPLETED").alias("completed"), is_("FAILED").alias("failed"), is_("DEFERRED").alias("deferred"),
        F.count_if(F.col("defer_count") >= 5).alias("forced"), F.coalesce(F.round(F.avg(wait), 3), F.lit(0.0)).alias("avg_wait"), F.coalesce(F.round(F.avg(burst), 3), F.lit(0.0)).alias("avg_burst"),
    )
    return totals.crossJoin(peak_depth_whole(tasks).select("peak"))  # one row each


def pop_order(tasks: DataFrame, steps: int = 64) -> DataFrame:
    """Every waiting task's position by effective priority and arrival.

    Each effective priority is dealt by arrival into ranges of about equal size (bounds by quantile: literals, so that
    both uses of them agree); a position is the count of the ranges before and the place inside, with no window over all."""
    x = tasks.where("status = 'DEFERRED'").select("task_id", F.greatest(F.lit(0), F.col("priority") - F.floor(F.col("task_id") % 60 / 10)).alias("_e"))
    bounds = x.groupBy("_e").agg(F.percentile_approx("task_id", [k / steps for k in range(1, steps)], 100 * steps).alias("_c")).collect()  # a row a priority
    passed = [F.when(F.col("_e") == r["_e"], F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in r["_c"]]), lambda c: c <= F.col("task_id")))) for r in bounds]
    x = x.withColumn("_b", F.coalesce(*passed, F.lit(0)))
    totals = x.groupBy("_e", "_b").agg(F.count("*").alias("_total"))
    ahead = F.coalesce(F.sum("_total").over(W.orderBy("_e", "_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(totals.select("_e", "_b", ahead.alias("_ahead")))  # ``steps`` rows a priority
    inside = x.withColumn("_r", F.row_number().over(W.partitionBy("_e", "_b").orderBy("task_id")))
    return inside.join(starts, ["_e", "_b"]).select("task_id", (F.col("_ahead") + F.col("_r")).cast("int").alias("position"))


def peek(tasks: DataFrame, cancelled: DataFrame) -> DataFrame:
    """The live task that would be popped next: least effective priority (column ``effective``), then arrival.  No row if none waits."""
    first = live(tasks, cancelled).agg(F.min(F.struct("effective", "task_id")).alias("_m"))
    return first.where("_m IS NOT NULL").select("_m.task_id", "_m.effective")


def distribution(tasks: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Live tasks by the name of their effective priority, 0 for names that none has."""
    names = tasks.sparkSession.createDataFrame(NAMES, "effective int, name string")
    counts = live(tasks, cancelled).groupBy("effective").agg(F.count("*").alias("c"))
    return names.join(counts, "effective", "left").select("name", F.coalesce("c", F.lit(0)).cast("long").alias("n_tasks"))


def depths(tasks: DataFrame, by: list[str]) -> DataFrame:
    """``depth`` after each arrival and dispatch, along time: of each queue of ``by``, or of all as one queue."""
    moves = tasks.select(*by, "task_id", F.inline(F.array_compact(F.array(F.struct(F.col("queued_at").alias("at"), F.lit(-1).alias("_less")), F.when(F.col("dispatch_at").isNotNull(), F.struct(F.col("dispatch_at").alias("at"), F.lit(1).alias("_less")))))))
    own = moves if by else moves.withColumn("_all", F.lit(1))
    return Segments(own, by or ["_all"], ["at", "_less", "task_id"]).running({"depth": ("sum", -F.col("_less"))}).done().drop("_all", "_less")


def peak_depth(tasks: DataFrame) -> DataFrame:
    """Largest number of waiting tasks of each session."""
    return depths(tasks, ["session"]).groupBy("session").agg(F.max("depth").alias("peak"))


def peak_depth_whole(tasks: DataFrame) -> DataFrame:
    """One row: the largest number of tasks that wait at once, and when that is first so."""
    return depths(tasks, []).agg(F.max(F.struct("depth", F.expr("-timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', at)").alias("_when"), "at")).alias("_m")).select(F.col("_m.depth").alias("peak"), F.col("_m.at").alias("peak_at"))
