"""Operators over telemetry: anomalies, streaks, rates, classifiers, alerts and throttles.

All go along the rows of a process by time; a process that holds a large share of the rows is scanned in chunks (``segments``).
Functions in the plural give rows that stay cut, for the scans that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .segments import Segments


def by_pid(t: DataFrame | Segments) -> Segments:
    """Rows of each process in order of time, a hot process cut into chunks."""
    return t if isinstance(t, Segments) else Segments(t, ["pid"], ["ts", "seq"])


def anomalies(t: DataFrame, inclusive: bool = False, value: str = "cpu_pct", window: int = 30, least: int = 10, sigmas: float = 2.0) -> DataFrame:
    """Rows over ``sigmas`` sample deviations off the mean of earlier rows (``inclusive``: of rows up to this one)."""
    frame = (-(window - 1), 0) if inclusive else (-window, -1)

    def made(w):
        w = w.rowsBetween(*frame)
        return {"_n": F.count(value).over(w), "mean": F.avg(value).over(w), "sd": F.stddev_samp(value).over(w)}

    x = by_pid(t).windowed(window, made).done()
    hit = (F.col("_n") >= least) & (F.col("sd") > 0) & (F.abs(F.col(value) - F.col("mean")) > sigmas * F.col("sd"))
    return x.where(hit).select("seq", "pid", F.round("mean", 5).alias("mean"), F.round(F.col("mean") + sigmas * F.col("sd"), 5).alias("threshold"))


def streaks(t: DataFrame | Segments, over: float = 85.0, least: int = 3) -> Segments:
    """``streak`` as rows that stay cut for further scans: rows over the level so far, less those before the last row that wasn't."""
    high = F.col("cpu_pct") > over
    s = by_pid(t).running({"_h": ("sum", F.when(high, 1).otherwise(0))})
    s = s.running({"_l": ("max", F.when(high, None).otherwise(F.col("_h")))})
    n = (F.col("_h") - F.coalesce("_l", F.lit(0))).cast("long")
    return s.over(s.rows.withColumns({"streak": n, "sustained": n >= least}).drop("_h", "_l"))


def streak(t: DataFrame, over: float = 85.0, least: int = 3) -> DataFrame:
    """Length of the run of rows over a level that ends here, and whether it is sustained."""
    return streaks(t, over, least).done()


def pressures(t: DataFrame | Segments, high: float = 80.0, low: float = 60.0, n: int = 5) -> Segments:
    def made(w):
        w = w.rowsBetween(-(n - 1), 0)
        full = F.count("*").over(w) >= n
        return {f"{r}_{side}": full & held for r, c in (("cpu", "cpu_pct"), ("ram", "ram_pct")) for side, held in (("high", F.min(c).over(w) > high), ("low", F.max(c).over(w) < low))}

    return by_pid(t).windowed(n - 1, made)


def pressure(t: DataFrame, high: float = 80.0, low: float = 60.0, n: int = 5) -> DataFrame:
    return pressures(t, high, low, n).done()


def rolling(t: DataFrame, n: int = 10) -> DataFrame:
    def made(w):
        w = w.rowsBetween(-(n - 1), 0)
        return {"mean": F.round(F.avg("cpu_pct").over(w), 5), "max": F.max("cpu_pct").over(w)}

    return by_pid(t.select("seq", "pid", "ts", "cpu_pct")).windowed(n - 1, made).done().select("seq", "pid", "mean", "max")


def counter_rate(t: DataFrame | Segments, value: str = "counter") -> DataFrame:
    """Increase a second of a counter; rows that don't advance time give 0 and are not compared with."""
    s = by_pid(t).windowed(1, lambda w: {"_stale": F.coalesce(F.col("ts") <= F.lag("ts").over(w), F.lit(False))})
    s = s.running({"_p": ("last", F.when(~F.col("_stale"), F.struct(F.col(value).alias("v"), F.col("ts").alias("t"))))}, upto=-1)
    dt = F.expr("timestampdiff(MICROSECOND, _p.t, ts)") / 1e6
    rate = F.when(F.col("_stale") | F.col("_p.t").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.col(value) - F.col("_p.v")) / dt)
    return s.done().select("seq", "pid", F.round(rate, 6).alias("rate"))


def bottleneck_a(streak_col: Column) -> Column:
    c, r, s, g, d = (F.col(x) for x in ("cpu_pct", "ram_pct", "swap_pct", "gpu_pct", "disk_pct"))
    return (
        F.when((r > 92) | (s > 40), "oom_risk").when(g > 90, "gpu_bound").when((r > 80) & (c < 60), "memory_bound").when((d > 70) & (c < 50), "io_bound")
        .when((streak_col >= 3) | (c > 95), "cpu_bound").otherwise("none")
    )


def bottleneck_s() -> Column:
    c, r, s, d = (F.col(x) for x in ("cpu_pct", "ram_pct", "swap_pct", "disk_pct"))
    return F.when((r >= 92) | (s >= 40), "oom_risk").when(c >= 90, "cpu_bound").when((d >= 70) & (c < 50), "io_bound").when((r >= 80) & (c < 60), "memory_bound").otherwise("none")


def transitions(t: DataFrame | Segments, state: str = "bottleneck") -> DataFrame:
    """Rows at which the state changes; it starts as none."""
    x = by_pid(t).windowed(1, lambda w: {"_b": F.lag(state, 1, "none").over(w)}).done()
    return x.where(F.col("_b") != F.col(state)).select("seq", "pid", F.col("_b").alias("old"), F.col(state).alias("new"), F.when(F.col(state) != "none", "DETECTED").otherwise("CLEARED").alias("event"))


def alert_rules() -> Column:
    """The alerts of a row (needs ``streak``): array of (metric, level)."""
    c, r, s, g = (F.col(x) for x in ("cpu_pct", "ram_pct", "swap_pct", "gpu_pct"))
    one = lambda metric, level: F.struct(F.lit(metric).alias("metric"), F.lit(level).alias("level"))
    return F.array_compact(F.array(
        F.when(c > 95, one("cpu", "CRITICAL")).when((c > 85) & (F.col("streak") >= 3), one("cpu", "WARNING")),
        F.when(r > 92, one("ram", "CRITICAL")).when(r > 80, one("ram", "WARNING")),
        F.when(s > 40, one("swap", "WARNING")),
        F.when(g > 97, one("gpu", "CRITICAL")).when(g > 90, one("gpu", "WARNING")),
    ))


def alerts(t: DataFrame) -> DataFrame:
    """Every alert of every row (needs ``streak`` and ``bottleneck``), with its severity."""
    x = t.select("seq", "pid", "bottleneck", F.inline(alert_rules()))
    severity = F.when(F.col("level") == "CRITICAL", "critical").when(F.col("bottleneck").isin("oom_risk", "gpu_bound"), "high").otherwise("medium")
    return x.withColumn("severity", severity).drop("bottleneck")


def throttle_instant(t: DataFrame | Segments) -> DataFrame:
    on = (F.col("cpu_pct") > 85) | F.col("bottleneck").isin("oom_risk", "cpu_bound")
    s = by_pid(t)
    s = s.over(s.rows.withColumn("cap", F.when(on, 1).otherwise(3))).windowed(1, lambda w: {"_p": F.lag("cap", 1, 3).over(w)})
    return s.done().where(F.col("_p") != F.col("cap")).select("seq", "pid", "cap")


def latched(t: DataFrame | Segments) -> Segments:
    """``_s``: set when cpu or ram stay high or memory runs out, reset when both stay low and nothing is wrong; else unchanged."""
    signal = F.when(F.col("cpu_high") | F.col("ram_high") | (F.col("bottleneck") == "oom_risk"), "THROTTLED").when(F.col("cpu_low") & F.col("ram_low") & (F.col("bottleneck") == "none"), "NORMAL")
    s = pressures(t).running({"_s": ("last", signal)})
    return s.over(s.rows.withColumn("_s", F.coalesce("_s", F.lit("NORMAL"))))


def throttle_latch(t: DataFrame | Segments) -> DataFrame:
    """How many rows are in each state of the latch."""
    return latched(t).done().groupBy(F.col("_s").alias("state")).agg(F.count("*").alias("n"))


def latch_transitions(t: DataFrame | Segments) -> DataFrame:
    """The rows at which the latch changes."""
    x = latched(t).windowed(1, lambda w: {"_p": F.lag("_s", 1, "NORMAL").over(w)}).done()
    return x.where(F.col("_p") != F.col("_s")).select("seq", "pid", F.col("_p").alias("old"), F.col("_s").alias("new"))


def last_averages(t: DataFrame, window: int = 10) -> DataFrame:
    recent = W.partitionBy("pid").orderBy(F.desc("ts"), F.desc("seq"))
    x = t.withColumn("_r", F.row_number().over(recent)).where(F.col("_r") <= window)
    return x.groupBy("pid").agg(F.round(F.avg("cpu_pct"), 5).alias("avg_cpu"), F.max("cpu_pct").alias("max_cpu"), F.round(F.avg("ram_pct"), 5).alias("avg_ram"), F.max("ram_pct").alias("max_ram"), F.round(F.avg("disk_pct"), 5).alias("avg_disk"), F.count("*").alias("n"))


def session_summary(t: DataFrame) -> DataFrame:
    """Each process's time, loads, alerts and bottlenecks; gpu figures are of rows with ``gpu_available`` only, 0 without any."""
    gpu = F.when(F.col("gpu_available"), F.col("gpu_pct"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return t.groupBy("pid").agg(
        F.expr("timestampdiff(SECOND, min(ts), max(ts))").alias("duration_s"), F.round(F.avg("cpu_pct"), 8).alias("avg_cpu"), F.max("cpu_pct").alias("peak_cpu"), F.round(F.avg("ram_pct"), 8).alias("avg_ram"), F.max("ram_pct").alias("peak_ram"),
        zero(F.round(F.avg(gpu), 8)).alias("avg_gpu"), zero(F.max(gpu)).alias("peak_gpu"), F.sum(F.size(alert_rules())).alias("alerts"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("bottleneck") != "none", F.col("bottleneck")))), ",").alias("bottlenecks"),
    )


def disk_rates(t: DataFrame | Segments, poll_s: float = 2.0) -> DataFrame:
    """Rates from counters (read_bytes, busy_ms, ctx): MB/s over the real time step, busy share under 100, and context
    switches over the nominal poll; rates aren't negative, a first row is 0, a step that takes no time counts as a poll."""
    names = {"_b": "read_bytes", "_m": "busy_ms", "_c": "ctx", "_t": "ts"}
    x = by_pid(t).windowed(1, lambda w: {n: F.lag(c).over(w) for n, c in names.items()}).done()
    dt = F.expr("timestampdiff(MICROSECOND, _t, ts)") / 1e6
    dt = F.when(dt > 0, dt).otherwise(poll_s)
    known = F.col("_t").isNotNull()
    rate = lambda v: F.when(known, F.greatest(F.lit(0.0), v)).otherwise(0.0)
    busy = rate((F.col("busy_ms") - F.col("_m")) / 1000.0 / dt * 100.0)
    return x.select(
        "seq", "pid", F.round(rate((F.col("read_bytes") - F.col("_b")) / 1048576.0 / dt), 3).alias("read_mb_s"),
        F.round(F.when(busy > 100.0, 100.0).otherwise(busy), 1).alias("busy_pct"), F.round(rate((F.col("ctx") - F.col("_c")) / poll_s), 4).alias("ctx_per_s"),
    )


def top_processes(processes: DataFrame, own: list[int], n: int = 10) -> DataFrame:
    """The ``n`` busiest processes and the own ones, each once."""
    top = processes.orderBy(F.desc("cpu_pct"), "pid").limit(n)
    return top.unionByName(processes.where(F.col("pid").isin(own))).groupBy("pid").agg(F.max("cpu_pct").alias("cpu_pct"))


def flat_snapshot(nested: DataFrame) -> DataFrame:
    """Nested snapshots as one row of resources; what is missing has its default (16 GB of memory, no GPU, no bottleneck)."""
    d = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return nested.select(
        "seq", d("cpu.overall_pct", 0.0).alias("cpu_pct"), d("memory.used_pct", 0.0).alias("ram_used_pct"), d("memory.available_gb", 16.0).alias("ram_available_gb"), d("memory.swap_pct", 0.0).alias("swap_pct"),
        d("gpu.available", False).alias("gpu_available"), d("gpu.vram_used_pct", 0.0).alias("gpu_vram_pct"), d("bottleneck", "none").alias("bottleneck"),
    )
