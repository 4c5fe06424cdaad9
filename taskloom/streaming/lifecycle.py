"""The task-lifecycle log as a stream: events of a task with its queueing and dispatch times carried forward."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RANK = {"QUEUED": 0, "DEFERRED": 1, "DISPATCHED": 2}
FILLED = "task_id long, event_type string, event_at timestamp, seen_queued timestamp, seen_dispatch timestamp"


def _carry(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    queued, dispatched = (None, None) if not state.exists else state.get
    out = []
    rows = pd.concat(list(frames))  # one task in one micro-batch
    rows = rows.assign(_r=rows["event_type"].map(lambda x: RANK.get(x, 3))).sort_values(["event_at", "_r"])
    for r in rows.itertuples(index=False):
        if r.event_type == "QUEUED":
            queued = r.event_at
        elif r.event_type == "DISPATCHED":
            dispatched = r.event_at
        out.append((key[0], r.event_type, r.event_at, queued, dispatched))
    state.update((queued, dispatched))
    yield pd.DataFrame(out, columns=["task_id", "event_type", "event_at", "seen_queued", "seen_dispatch"])


def fill(stream: DataFrame) -> DataFrame:
    """Events (task_id, event_type, event_at) with what is known of their task by then."""
    own = stream.select("task_id", "event_type", "event_at")
    return own.groupBy("task_id").applyInPandasWithState(_carry, FILLED, "queued timestamp, dispatched timestamp", "append", GroupStateTimeout.NoTimeout)
