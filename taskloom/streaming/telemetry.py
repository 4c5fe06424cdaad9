"""Telemetry as a stream: throttle latch, streaks and bottleneck changes by process, with state in the engine's store.

The batch operators (``operators.telemetry``) define the results; here the same folds run row by row over what each
micro-batch brings, so a stream over files in order of time gives the same transitions.  State is a few numbers a
process: the last five readings, the streak, the last bottleneck and the latch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "ts timestamp, seq long, pid long, cpu_pct double, ram_pct double, swap_pct double, gpu_pct double, disk_pct double, kind string"
CHANGES = "pid long, seq long, what string, old string, new string"
STATE = "cpu array<double>, ram array<double>, streak int, bottleneck string, latch string"


def source(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Polled telemetry: new Parquet files of a folder, ``files`` a trigger.  Nothing is dropped under load; files wait."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def classify(cpu: float, ram: float, swap: float, gpu: float, disk: float, streak: int) -> str:
    """The bottleneck of a reading, first rule that holds."""
    if ram > 92 or swap > 40:
        return "oom_risk"
    if gpu > 90:
        return "gpu_bound"
    if ram > 80 and cpu < 60:
        return "memory_bound"
    if disk > 70 and cpu < 50:
        return "io_bound"
    return "cpu_bound" if streak >= 3 or cpu > 95 else "none"


def _fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    cpu, ram, streak, last, latch = ([], [], 0, "none", "NORMAL") if not state.exists else state.get
    cpu, ram, out = list(cpu), list(ram), []
    rows = pd.concat(list(frames)).sort_values(["ts", "seq"])  # one process in one micro-batch
    for r in rows.itertuples(index=False):
        cpu, ram = [*cpu, r.cpu_pct][-5:], [*ram, r.ram_pct][-5:]
        streak = streak + 1 if r.cpu_pct > 85 else 0
        now = classify(r.cpu_pct, r.ram_pct, r.swap_pct, r.gpu_pct, r.disk_pct, streak)
        if now != last:
            out.append((key[0], r.seq, "bottleneck", last, now))
        last = now
        full = len(cpu) == 5
        to = latch
        if (full and (min(cpu) > 80 or min(ram) > 80)) or now == "oom_risk":
            to = "THROTTLED"
        elif full and max(cpu) < 60 and max(ram) < 60 and now == "none":
            to = "NORMAL"
        if to != latch:
            out.append((key[0], r.seq, "throttle", latch, to))
        latch = to
    state.update((cpu, ram, streak, last, latch))
    yield pd.DataFrame(out, columns=["pid", "seq", "what", "old", "new"])


def changes(stream: DataFrame) -> DataFrame:
    """Changes of bottleneck and throttle of every process (pid, seq, what, old, new)."""
    return stream.groupBy("pid").applyInPandasWithState(_fold, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)


def rolling(stream: DataFrame, window: str = "10 minutes", slide: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Means and peaks by process over event-time windows, with a watermark for late readings."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "pid").agg(F.avg("cpu_pct").alias("avg_cpu"), F.max("cpu_pct").alias("max_cpu"), F.count("*").alias("n"))


def fan_out(stream: DataFrame, subscribers: list[Callable[[DataFrame, int], None]], checkpoint: str, most: int = 20, failed: Callable[[int, Exception], None] | None = None):
    """Hands each micro-batch to up to ``most`` subscribers; one that fails doesn't stop the others (``failed`` is told)."""
    if len(subscribers) > most:
        raise ValueError(f"at most {most} subscribers")

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for k, s in enumerate(subscribers):
            try:
                s(batch, number)
            except Exception as error:  # noqa: BLE001
                if failed:
                    failed(k, error)
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def webhook(send: Callable[[list[dict]], None], most: int = 1000) -> Callable[[DataFrame, int], None]:
    """A subscriber that sends severe events (column severity) of a micro-batch on, ``most`` a call; ``send`` is injected."""

    def post(batch: DataFrame, number: int) -> None:
        some: list[dict] = []
        for r in batch.where(F.lower("severity").isin("high", "critical")).toLocalIterator():
            some.append(r.asDict())
            if len(some) == most:
                send(some)
                some = []
        if some:
            send(some)

    return post
