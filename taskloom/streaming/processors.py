"""Stateful processors: the latch, streaks and aging of the batch operators as folds with list, value and map state, time to live and timers.

State lives in the engine's store (RocksDB; ``store`` sets it), so a query that stops in mid-stream goes on from its
checkpoint.  A micro-batch's rows of one key come in pieces and may be out of order between micro-batches: a processor takes
them in order of time within a micro-batch, as ``streaming.telemetry`` does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

READINGS = 5
#: A process that isn't heard of for so long is forgotten.
LIFE_MS = 24 * 3600 * 1000
#: Ticks of one step of aging.
STEP = 10


def store(spark: SparkSession) -> None:
    """Puts state in RocksDB, which these processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by)


class Latch(StatefulProcessor):
    """Changes of the throttle latch (I9): set by five high readings or no memory, reset by five low ones with nothing wrong."""

    OUT = "pid long, seq long, old string, new string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.readings = handle.getListState("readings", "cpu double, ram double")
        self.latch = handle.getValueState("latch", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = [tuple(r) for r in self.readings.get()]
        state = self.latch.get()[0] if self.latch.exists() else "NORMAL"
        out = []
        for r in _ordered(rows, ["ts", "seq"]).itertuples(index=False):
            last = [*last, (r.cpu_pct, r.ram_pct)][-READINGS:]
            (cpu, ram), full, to = zip(*last), len(last) == READINGS, state
            if full and (min(cpu) > 80 or min(ram) > 80) or r.bottleneck == "oom_risk":
                to = "THROTTLED"
            elif full and max(cpu) < 60 and max(ram) < 60 and r.bottleneck == "none":
                to = "NORMAL"
            if to != state:
                out.append((key[0], r.seq, state, to))
            state = to
        self.readings.put(last)
        self.latch.update((state,))
        yield pd.DataFrame(out, columns=["pid", "seq", "old", "new"])

    def close(self) -> None:
        pass


class Streak(StatefulProcessor):
    """The run of readings over a level that ends at each reading (E3); a process not heard of for a day starts anew."""

    OUT = "pid long, seq long, streak long, sustained boolean"

    def __init__(self, over: float = 85.0, least: int = 3, life_ms: int = LIFE_MS):
        self.over, self.least, self.life_ms = over, least, life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "n long", self.life_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.streak.get()[0] if self.streak.exists() else 0
        out = []
        for r in _ordered(rows, ["ts", "seq"]).itertuples(index=False):
            n = n + 1 if r.cpu_pct > self.over else 0
            out.append((key[0], r.seq, n, n >= self.least))
        self.streak.update((n,))
        yield pd.DataFrame(out, columns=["pid", "seq", "streak", "sustained"])

    def close(self) -> None:
        pass


class Aging(StatefulProcessor):
    """Priorities of waiting tasks (I2): a step up for every ten ticks that a task stays pending, by a timer in event time.

    Keyed by queue; rows are (queue, task_id, at, event PUSH or GONE, priority).  ``tick_ms`` is the length of a tick.  Each
    step of each waiting task is a row; the counter of a task starts anew when it is pushed again."""

    OUT = "queue long, task_id long, at timestamp, effective int"

    def __init__(self, tick_ms: int = 1000):
        self.step_ms = STEP * tick_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "task_id long", "effective int, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for r in _ordered(rows, ["at", "task_id"]).itertuples(index=False):
            if r.event == "PUSH":
                due = int(pd.Timestamp(r.at).value // 1_000_000) + self.step_ms
                self.waiting.updateValue((int(r.task_id),), (int(r.priority), due))
                self.handle.registerTimer(due)
            else:
                self.waiting.removeKey((int(r.task_id),))
        yield pd.DataFrame([], columns=["queue", "task_id", "at", "effective"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the watermark may have passed several steps at once; timers of these find nothing left to do
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for (task,), (effective, due) in list(self.waiting.iterator()):
            if due > now or effective < 1:
                continue
            while due <= now and effective > 0:
                effective -= 1
                out.append((key[0], task, pd.Timestamp(due, unit="ms"), effective))
                due += self.step_ms
            self.waiting.updateValue((task,), (effective, due))
            if effective:
                self.handle.registerTimer(due)
        yield pd.DataFrame(out, columns=["queue", "task_id", "at", "effective"]).astype({"at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def latch_changes(stream: DataFrame) -> DataFrame:
    """(pid, seq, old, new) of a stream with cpu_pct, ram_pct and bottleneck."""
    return stream.groupBy("pid").transformWithStateInPandas(Latch(), Latch.OUT, "Append", "None")


def streaks(stream: DataFrame, over: float = 85.0, least: int = 3) -> DataFrame:
    """(pid, seq, streak, sustained) of every reading of a stream.

    Time to live goes by the clock, for which the engine runs batches without rows; a run that is to end by itself
    (``availableNow``) needs ``spark.sql.streaming.noDataMicroBatches.enabled`` off."""
    return stream.groupBy("pid").transformWithStateInPandas(Streak(over, least), Streak.OUT, "Append", "ProcessingTime")


def aging(stream: DataFrame, late: str = "0 seconds", tick_ms: int = 1000) -> DataFrame:
    """(queue, task_id, at, effective): the steps of waiting tasks, as the watermark passes them."""
    return stream.withWatermark("at", late).groupBy("queue").transformWithStateInPandas(Aging(tick_ms), Aging.OUT, "Append", "EventTime")
