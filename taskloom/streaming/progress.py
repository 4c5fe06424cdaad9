"""What runs did, as a table: stages, micro-batches and actions append their events, to be read back with status and duration.

``Progress.attach`` hooks a streaming query listener and a query execution listener into a session.  Listeners only note
events; ``flush`` appends what was noted to a Parquet folder, and its own writes aren't noted.  Events are of runs, stages
and micro-batches, never of rows, so the buffer is small; ``most`` notes flush by themselves when the next stage ends.
"""

from __future__ import annotations

import contextlib
import datetime
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "run_id string, kind string, name string, status string, batch long, n_rows long, duration_ms double, error string, at timestamp"
MOST = 10_000


class _Streams(StreamingQueryListener):
    def __init__(self, note):
        self.note, self.names = note, {}

    def onQueryStarted(self, event):
        self.names[str(event.runId)] = event.name
        self.note("stream", event.name, "started", run_id=str(event.runId))

    def onQueryProgress(self, event):
        p = event.progress
        self.note("batch", p.name, "completed", run_id=str(p.runId), batch=p.batchId, n_rows=p.numInputRows, duration_ms=float(p.batchDuration))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        run = str(event.runId)
        self.note("stream", self.names.pop(run, None), "failed" if event.exception else "completed", run_id=run, error=event.exception)


class _Actions:
    """The engine's hook for every action of the session."""

    def __init__(self, note):
        self.note = note

    def onSuccess(self, name, execution, nanos):
        self.note("action", name, "completed", duration_ms=nanos / 1e6)

    def onFailure(self, name, execution, error):
        self.note("action", name, "failed", error=str(error.getMessage()))

    class Java:
        implements = ["org.apache.spark.sql.util.QueryExecutionListener"]


class Progress:
    def __init__(self, spark: SparkSession, path: str, most: int = MOST):
        self.spark, self.path, self.most, self.run_id = spark, path, most, uuid.uuid4().hex
        self.notes: list[tuple] = []
        self.lock, self.quiet = threading.Lock(), False
        self.hooks: tuple | None = None

    def note(self, kind: str, name: str | None, status: str, run_id: str | None = None, batch: int | None = None, n_rows: int | None = None, duration_ms: float | None = None, error: str | None = None) -> None:
        if kind != "action" or self.hooks and not self.quiet:
            with self.lock:
                self.notes.append((run_id or self.run_id, kind, name, status, batch, n_rows, duration_ms, error, datetime.datetime.now(datetime.timezone.utc)))

    def attach(self) -> Progress:
        """Hooks the listeners in; after ``detach`` nothing more is noted (the session keeps a deaf one for actions, which can't be told apart to be taken out)."""
        from pyspark.java_gateway import ensure_callback_server_started

        ensure_callback_server_started(self.spark.sparkContext._gateway)
        self.hooks = _Streams(self.note), _Actions(self.note)
        self.spark.streams.addListener(self.hooks[0])
        self.spark._jsparkSession.listenerManager().register(self.hooks[1])
        return self

    def detach(self) -> None:
        if self.hooks:
            self.spark.streams.removeListener(self.hooks[0])
        self.flush()
        self.hooks = None

    @contextlib.contextmanager
    def stage(self, name: str):
        """A stage of a run: its start, and its end with what it took or how it failed."""
        self.note("stage", name, "started")
        began = time.monotonic()
        try:
            yield
        except Exception as e:
            self.note("stage", name, "failed", duration_ms=(time.monotonic() - began) * 1000, error=f"{type(e).__name__}: {e}"[:1000])
            raise
        else:
            self.note("stage", name, "completed", duration_ms=(time.monotonic() - began) * 1000)
        finally:
            if len(self.notes) >= self.most:
                self.flush()

    def flush(self) -> None:
        """Appends what was noted to the table."""
        with self.lock:
            notes, self.notes = self.notes, []
        if notes:
            self.quiet = True
            try:
                self.spark.createDataFrame(notes, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
                # actions are told of later than they end
                self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            finally:
                self.quiet = False


def events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def status(spark: SparkSession, path: str) -> DataFrame:
    """Stages and streams of each run as they stand: the last status, when it came, time taken, rows, and the share of its stages that are done."""
    e = events(spark, path).where("kind <> 'action'")
    own = F.when(F.col("kind") == "batch", "stream").otherwise(F.col("kind"))
    last = lambda c: F.max_by(c, F.when(F.col("kind") != "batch", F.struct("at", (F.col("status") != "started").alias("x"))))
    t = e.groupBy("run_id", own.alias("kind"), "name").agg(last("status").alias("status"), F.max("at").alias("at"), F.sum("duration_ms").alias("duration_ms"), F.sum("n_rows").alias("n_rows"), F.max("error").alias("error"))
    done = t.groupBy("run_id").agg(F.round(F.avg((F.col("status") == "completed").cast("double")), 4).alias("done"))
    return t.join(done, "run_id")
