"""The machine of deferrals and failures of a task, which starts anew when a task expires or its attempts end.

A task's state is a clock since its first deferral, its failed attempts, its deferral count and its priority.  Expiry, a
failure that isn't worth another attempt and an exhausted budget clear clock, attempts and history (a restart).  A failure
that is tried again sets the deferral count to 0 and the priority to the nominal one, but leaves the clock.

The fold is sequential only in its restarts, and these are found without one.  For every event, the restart that would
follow if the machine were blank there depends on later events alone: the first failure without retry, the failure that is
one more than the budget, or the first deferral past the deadline of the next one's clock, whichever comes first.  That
gives each place a pointer to the next blank place; the places really reached from a task's first event come from following
pointers of 1, 2, 4, ... restarts (``log2`` rounds of joins on unique keys).  All else is running sums and last values
between restarts, taken over chunks (``segments``), so a task may hold any share of the events.

That is how hot tasks go (of more than ``most`` events, or a 256th of all if more).  The others are dealt and sorted once, and
each is followed event by event, with nothing held but the machine's state (``_fold``).

Defined results: events of equal time go by ``tie``, which must tell them apart within a session; null ids are a task of
their own; events without a time are left out, as no clock reads them; no events give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import backoff
from ..sources.scratch import cut
from .segments import MOST, SHARE, Segments

RESTARTS = ("EXPIRED", "SKIPPED", "EXHAUSTED")


def _unique(a: DataFrame, b: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """Join on task and place, null tasks being equal."""
    cond = None
    for x, y in on.items():
        one = F.col(x).eqNullSafe(F.col(y))
        cond = one if cond is None else cond & one
    return a.join(b, cond, how)


def _next_blank(ev: DataFrame, deadline_s: float, max_retries: int, like: Segments) -> DataFrame:
    """(task_id, i, blank): the place after the restart that follows if the machine is blank before event ``i``."""
    cut_ = lambda t, order: Segments(t, ["task_id"], order, like.bound, like=like)
    # the first deferral at or past each deferral's deadline: deferrals and deadlines in one line of time, read from its end
    later = F.col("at") + F.expr(f"INTERVAL {int(deadline_s * 1_000_000)} MICROSECOND")
    points = ev.where("kind = 'deferral'").select("task_id", "i", F.inline(F.array(F.struct(F.col("at").alias("when"), F.lit(1).alias("real")), F.struct(later.alias("when"), F.lit(0).alias("real")))))
    line = cut_(points, ["when", "real", "i"]).running({"due": ("last", F.when(F.col("real") == 1, F.col("i")))}, backwards=True).done()
    due = line.where("real = 0").select(F.col("task_id").alias("_t"), F.col("i").alias("_i"), "due")
    x = _unique(ev, due, {"task_id": "_t", "i": "_i"}, "left").drop("_t", "_i")
    ended = cut_(x, ["at", "tie"]).running({
        "by_skip": ("last", F.when((F.col("kind") == "failure") & ~F.col("retryable"), F.col("i"))),
        # a deferral with no other past its deadline stands for "never"
        "by_clock": ("last", F.when(F.col("kind") == "deferral", F.coalesce("due", F.lit(-1)))),
    }, backwards=True).done()
    tries = ev.where("kind = 'failure' AND retryable").select(F.col("task_id").alias("_t"), F.col("tried").alias("_n"), F.col("i").alias("by_budget"))
    own = F.col("tried") - F.when((F.col("kind") == "failure") & F.col("retryable"), 1).otherwise(0)
    met = _unique(ended.withColumn("_need", own + max_retries + 1), tries, {"task_id": "_t", "_need": "_n"}, "left")
    return met.select("task_id", "i", (F.least("by_skip", "by_budget", F.when(F.col("by_clock") >= 0, F.col("by_clock"))) + 1).alias("blank"))


def _blanks(pointers: DataFrame) -> DataFrame:
    """(task_id, i): the places before which the machine is blank, the first of each task among them."""
    pointers = cut(pointers.where("blank IS NOT NULL"), "restart-pointers")
    # only places that something points to, and the first, are ever blank
    ends = pointers.select(F.col("task_id").alias("_t"), F.col("blank").alias("_b")).distinct()
    jump = cut(_unique(pointers.where("i > 0"), ends, {"task_id": "_t", "i": "_b"}).select("task_id", "i", "blank").unionByName(pointers.where("i = 0")), "restart-jumps")
    reached = cut(jump.where("i = 0").select("task_id", "i"), "restart-reached")
    step = lambda j: j.select(F.col("task_id").alias("_t"), F.col("i").alias("_i"), F.col("blank").alias("_b"))
    far = lambda j: _unique(j, step(j), {"task_id": "_t", "blank": "_i"}).select("task_id", "i", F.col("_b").alias("blank"))
    more = lambda r, j: r.unionByName(_unique(r, step(j), {"task_id": "_t", "i": "_i"}).select("task_id", F.col("_b").alias("i")))
    n = -1
    while n != (n := reached.count()):
        twice = far(jump)  # two doublings a round
        reached, jump = cut(more(more(reached, jump), twice).distinct(), "restart-reached"), cut(far(twice), "restart-jumps")
    return reached


def _fold(batches: Iterator[pa.RecordBatch], deadline: int, max_retries: int) -> Iterator[pa.RecordBatch]:
    """The machine's state at every event of rows sorted by task and time; ``_us`` is the time in microseconds."""
    started, task, clock, attempts, off, number = False, None, None, 0, 0, 0
    for b in batches:
        made = []
        for one, deferral, retryable, us in zip(*(b.column(c).to_pylist() for c in ("task_id", "_deferral", "_retryable", "_us"))):
            if not started or one != task:
                started, task, clock, attempts, off, number = True, one, None, 0, 0, 0
            if deferral:
                off += 1
                if off == 1:
                    clock = us
                expired = us - clock >= deadline
                made.append((None, number + 1, off, clock, expired, False))
                number += not expired
                if expired:
                    attempts = off = 0
            else:
                attempts += 1
                retried = retryable and attempts <= max_retries
                made.append((attempts, None, off, clock, False, retried))
                if retried:
                    number = 0
                else:
                    attempts = off = 0
        if made:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            arrays = [pa.array(x, type=k) for x, k in zip(zip(*made), kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, "attempt", "_number", "_off", "_clock_us", "_expired", "_retried"])


def _followed(events: DataFrame, deadline_s: float, max_retries: int) -> DataFrame:
    """``events`` of tasks that one task can follow, with the columns that ``machine`` reads."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(at AS TIMESTAMP_NTZ))")
    rows = events.select("task_id", "session", "priority", "tie", us.alias("_us"), (F.col("kind") == "deferral").alias("_deferral"), "retryable", (F.coalesce("retryable", F.lit(False))).alias("_retryable"), "kind", "at")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    deadline = int(deadline_s * 1_000_000)
    met = rows.repartition("task_id").sortWithinPartitions("task_id", "_us", "tie").mapInArrow(
        lambda b: _fold(b, deadline, max_retries), kinds + ", attempt bigint, _number int, _off bigint, _clock_us bigint, _expired boolean, _retried boolean"
    )
    clock = F.expr("CAST(timestampadd(MICROSECOND, _clock_us, TIMESTAMP_NTZ '1970-01-01 00:00:00') AS %s)" % events.schema["at"].dataType.simpleString())
    elapsed = F.when(F.col("kind") == "deferral", F.expr("timestampdiff(SECOND, _clock, at)")).cast("double")
    return met.withColumn("_clock", clock).withColumn("elapsed_s", elapsed)


def machine(events: DataFrame, deadline_s: float = 600.0, max_retries: int = 2, base: float = 2.0, escalate_after: int = 5, most: int = MOST) -> DataFrame:
    """Every event (task_id, session, priority, at, tie, kind 'deferral' or 'failure', retryable) with what follows it.

    Adds ``action`` (REQUEUED, ESCALATED, EXPIRED; RETRYING, EXHAUSTED, SKIPPED), ``attempt`` (failures), ``defer_number``,
    ``elapsed_s`` on the clock, ``backoff_s``, ``priority_after`` (-1: expired) and ``history`` (what the event does to the
    number of tasks with a deferral history: 1, 0 or -1)."""
    if deadline_s <= 0:
        raise ValueError("a deadline is over 0")
    events = events.where("at IS NOT NULL")
    counts = events.groupBy("task_id").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    # at most 256 of them
    hot = counts.where(F.col("_n") > max(most, int(total * SHARE))).select("task_id").collect()
    if not hot:
        return _judged(_followed(events, deadline_s, max_retries), base, escalate_after)
    few = F.broadcast(events.sparkSession.createDataFrame(hot, counts.select(F.col("task_id").alias("_t")).schema))
    same = F.col("task_id").eqNullSafe(F.col("_t"))
    rest = _followed(events.join(few, same, "left_anti"), deadline_s, max_retries)
    return _judged(_scanned(events.join(few, same, "left_semi"), deadline_s, max_retries, most), base, escalate_after).unionByName(_judged(rest, base, escalate_after))


def _scanned(events: DataFrame, deadline_s: float, max_retries: int, most: int) -> DataFrame:
    """``events`` of tasks of any size with the columns that ``machine`` reads, by scans between restarts."""
    kinds = {"deferral": F.col("kind") == "deferral", "try": (F.col("kind") == "failure") & F.col("retryable")}
    numbered = Segments(events, ["task_id"], ["at", "tie"], most).running({"i": ("count", F.lit(1))}, upto=-1)
    numbered = numbered.running({"tried": ("sum", kinds["try"].cast("int")), "put_off": ("sum", kinds["deferral"].cast("int"))})
    ev = cut(numbered.done(), "restart-events")
    blank = _blanks(_next_blank(ev, deadline_s, max_retries, numbered)).where("i > 0").select(F.col("task_id").alias("_t"), F.col("i").alias("_i"), F.lit(True).alias("_new"))
    x = _unique(ev, blank, {"task_id": "_t", "i": "_i"}, "left").drop("_t", "_i")
    # counts since the last restart, then the clock, then the deferral count since the last retry
    s = Segments(x, ["task_id"], ["at", "tie"], most, like=numbered).running({
        "_tried0": ("last", F.when(F.col("_new"), F.col("tried") - kinds["try"].cast("int"))), "_off0": ("last", F.when(F.col("_new"), F.col("put_off") - kinds["deferral"].cast("int"))),
    })
    tried, off = F.col("tried") - F.coalesce("_tried0", F.lit(0)), F.col("put_off") - F.coalesce("_off0", F.lit(0))
    s = s.over(s.rows.withColumns({"attempt": F.when(F.col("kind") == "failure", tried + F.when(~F.col("retryable"), 1).otherwise(0)), "_off": off}))
    s = s.running({"_clock": ("last", F.when(kinds["deferral"] & (F.col("_off") == 1), F.col("at")))})
    elapsed = F.when(kinds["deferral"], F.expr("timestampdiff(SECOND, _clock, at)"))
    s = s.over(s.rows.withColumn("elapsed_s", elapsed.cast("double")))
    expired = kinds["deferral"] & (F.expr("timestampdiff(MICROSECOND, _clock, at)") >= int(deadline_s * 1_000_000))
    retried = kinds["try"] & (F.col("attempt") <= max_retries)
    s = s.over(s.rows.withColumns({"_expired": expired, "_retried": retried})).running({"_queued": ("sum", (kinds["deferral"] & ~F.col("_expired")).cast("int"))})
    s = s.running({"_queued0": ("last", F.when(F.col("_retried"), F.col("_queued")))})
    own = F.when(kinds["deferral"] & ~F.col("_expired"), 1).otherwise(0)
    number = F.col("_queued") - F.coalesce("_queued0", F.lit(0)) - own + 1
    return s.done().withColumn("_number", number)


def _judged(t: DataFrame, base: float, escalate_after: int) -> DataFrame:
    """What follows each event, from the machine's state there."""
    kinds = {"deferral": F.col("kind") == "deferral"}
    t = t.withColumn("defer_number", F.when(kinds["deferral"], F.col("_number")).cast("int"))
    after = F.greatest(F.lit(0), F.col("priority") - F.greatest(F.lit(0), F.col("defer_number") - (escalate_after - 1)))
    before = F.greatest(F.lit(0), F.col("priority") - F.greatest(F.lit(0), F.col("defer_number") - escalate_after))
    action = (
        F.when(F.col("_expired"), "EXPIRED").when(kinds["deferral"] & (F.col("defer_number") >= escalate_after) & (before > 0), "ESCALATED").when(kinds["deferral"], "REQUEUED")
        .when(~F.col("retryable"), "SKIPPED").when(F.col("_retried"), "RETRYING").otherwise("EXHAUSTED")
    )
    t = t.withColumn("action", action)
    had = F.col("_off") - kinds["deferral"].cast("int") > 0
    history = F.when(F.col("action").isin(*RESTARTS), F.when(had, -1).otherwise(0)).when(kinds["deferral"] & ~had, 1).otherwise(0)
    wait = F.when(F.col("action").isin("REQUEUED", "ESCALATED"), backoff("exponential", base, F.col("defer_number"))).when(F.col("_retried"), backoff("exponential", base, F.col("attempt"))).otherwise(0.0)
    return t.select(
        "task_id", "session", "priority", "at", "tie", "kind", "action", F.col("attempt").cast("int").alias("attempt"), "defer_number", "elapsed_s", wait.alias("backoff_s"),
        F.when(F.col("_expired"), -1).when(kinds["deferral"], after).otherwise(F.col("priority")).cast("int").alias("priority_after"), history.alias("history"), F.col("_clock").alias("clock"),
    )


def pressure_signals(acted: DataFrame, per_task: int = 10, overload: int = 5, most: int = MOST) -> DataFrame:
    """For each deferral that is queued again: how many tasks of its session have a history then, and the signal."""
    # stored, as sessions are counted and cut before they are scanned
    acted = cut(acted.select("session", "task_id", "at", "tie", "action", "defer_number", "history"), "restart-acted")
    s = Segments(acted, ["session"], ["at", "tie"], most).running({"active": ("sum", F.col("history"))})
    d = s.done().where("action IN ('REQUEUED', 'ESCALATED')")
    return d.select("session", "task_id", "tie", F.col("active").cast("long").alias("active"), F.when(F.col("defer_number") >= per_task, "task_backpressure").when(F.col("active") >= overload, "system_overload").otherwise("none").alias("signal"))


def still_deferred(acted: DataFrame, now: str, deadline_s: float = 600.0) -> DataFrame:
    """Tasks with a deferral history at the end of the log, most deferrals first: the last deferral's number, whether it escalated, time on the clock till ``now`` (a timestamp's text) and its share of the deadline."""
    last = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, F.struct("at", "tie")))
    put = F.col("action").isin("REQUEUED", "ESCALATED")
    t = acted.groupBy("task_id").agg(
        F.sum("history").alias("_open"), last("defer_number", put).alias("defer_count"), last("action", put).alias("_last"), last("clock", put).alias("_clock"),
    ).where("_open > 0")
    elapsed = F.expr(f"timestampdiff(SECOND, _clock, TIMESTAMP_NTZ '{now}')").cast("double")
    return t.select("task_id", "defer_count", (F.col("_last") == "ESCALATED").alias("escalated"), elapsed.alias("elapsed_s"), F.round(elapsed / deadline_s * 100, 1).alias("pct_deadline")).orderBy(F.desc("defer_count"), "task_id")
