"""Event logs and run records as JSON lines: append, load, tail, list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A log line: fixed fields.
EVENT = "entry_id string, task_id string, task_name string, stage_group string, priority string, event_type string, queued_at timestamp, dispatch_at timestamp, complete_at timestamp, event_at timestamp, wait_time_s double, burst_time_s double, turnaround_s double, defer_count int, cpu_pct double, ram_pct double, gpu_pct double, bottleneck string, error string, defer_reason string"
RUN = "run_id string, run_name string, status string, started_at timestamp, duration_s double, metrics map<string,array<double>>, alerts_fired array<string>, bottlenecks_detected array<string>"


def append_events(events: DataFrame, path: str) -> None:
    """Adds events to the log; each write is committed whole."""
    events.write.mode("append").json(path)


def stream_events(events: DataFrame, path: str, checkpoint: str):
    """The same as a streaming sink, exactly once by its checkpoint."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def load_events(spark: SparkSession, path: str, last: int = 500, schema: str = EVENT) -> DataFrame:
    """The latest ``last`` events; unknown keys are dropped, missing ones null, lines that aren't JSON left out (the log has no order but its times)."""
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path).cache()
    good = rows.where(F.col("_bad").isNull()).drop("_bad")
    return good.orderBy(F.desc("event_at"), F.desc("entry_id")).limit(last)


def tail(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The latest ``n`` lines as they are, by their event time."""
    lines = spark.read.text(path)
    return lines.where(F.length(F.trim("value")) > 0).orderBy(F.desc(F.get_json_object("value", "$.event_at")), F.desc("value")).limit(n)


def save_run(run: DataFrame, path: str) -> None:
    """One record for each run, in a folder by run."""
    run.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(path)


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """Saved runs, latest id first, with numbers of samples, alerts and bottlenecks; records without a name are skipped."""
    rows = spark.read.schema(RUN).json(path).where("run_name IS NOT NULL")
    n = F.aggregate(F.map_values(F.coalesce("metrics", F.create_map().cast("map<string,array<double>>"))), F.lit(0), lambda s, v: s + F.size(v))
    size = lambda c: F.greatest(F.lit(0), F.size(F.coalesce(c, F.array().cast("array<string>"))))
    return rows.select("run_id", "run_name", "status", "started_at", "duration_s", n.alias("n_metrics"), size("alerts_fired").alias("n_alerts"), size("bottlenecks_detected").alias("bottlenecks")).orderBy(F.desc("run_id"))
