"""The tick scheduler as an ordered fold: each dispatch changes the slots that the next decision sees, so no window can state it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUT = "session long, tick int, task_id long, action string, effective int, defer_count int"


def run_ticks(tasks: DataFrame, pressure: DataFrame, ticks: int, workers: int = 3, throttled: int = 1, aging: int = 10, force_at: int = 30) -> DataFrame:
    """Decisions of each session's scheduler, tick by tick.

    ``tasks``: session, task_id, priority, heavy (whether pressure defers it), burst (ticks it runs).  ``pressure``: session,
    tick, high.  A tick adjusts the slots, ages pending tasks, then pops by (effective priority, arrival) until the slots are
    used or a task is deferred.  A deferred task doesn't age any more.  A session is held by one task: a queue of one
    scheduler, with as many rows as it has tasks; sessions run side by side."""

    def fold(key, own: pd.DataFrame, load: pd.DataFrame) -> Iterator[pd.DataFrame] | pd.DataFrame:
        high = dict(zip(load["tick"], load["high"]))
        wait = [[int(r.priority), k, int(r.task_id), bool(r.heavy), int(r.burst), 0, 0] for k, r in enumerate(own.sort_values("task_id").itertuples(index=False))]
        running: list[int] = []
        out = []
        for tick in range(ticks):
            running = [end for end in running if end > tick]
            hot = bool(high.get(tick, False))
            for w in wait:
                if w[6] == 0:  # pending, never deferred
                    w[5] += 1
                    if w[5] >= aging and w[0] > 0:
                        w[0], w[5] = w[0] - 1, 0
            slots = (throttled if hot else workers) - len(running)
            wait.sort(key=lambda w: (w[0], w[1]))
            while slots > 0 and wait:
                w = wait[0]
                if w[6] < force_at and w[0] > 0 and hot and w[3]:
                    w[6] += 1
                    out.append((key[0], tick, w[2], "defer", w[0], w[6]))
                    break
                wait.pop(0)
                out.append((key[0], tick, w[2], "force_dispatch" if w[6] >= force_at else "dispatch", w[0], w[6]))
                running.append(tick + w[4])
                slots -= 1
        return pd.DataFrame(out, columns=["session", "tick", "task_id", "action", "effective", "defer_count"])

    return tasks.groupBy("session").cogroup(pressure.groupBy("session")).applyInPandas(fold, OUT)
