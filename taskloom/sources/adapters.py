"""Domain views over the driver's tables, and the literal task catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import at_most


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of orders and lineitem that one task aims to join.  It bounds memory only: results don't depend on it.
MOST = 1_000_000


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks: dispatched at their first, completed at their last shipment after the order date."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    rows = o.count() + line.count()
    if rows > MOST:
        # a number of parts that grows with the tables, so that a task's sorts and groups don't
        n = max(-(-rows // MOST), spark.sparkContext.defaultParallelism)
        o, line = o.repartition(n, "o_orderkey"), line.repartition(n, "l_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("DEFERRED")
    # one join and one aggregate on the join's own partitioning
    lines = o.join(line, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")), "left")
    spans = lines.groupBy("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_orderstatus").agg(F.min("l_shipdate").alias("dispatch_at"), F.max("l_shipdate").alias("complete_at"), F.count("l_orderkey").alias("_n"))
    return spans.select(
        F.col("o_orderkey").alias("task_id"),
        F.col("o_custkey").alias("session"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("priority"),
        F.col("o_orderdate").alias("queued_at"),
        "dispatch_at",
        "complete_at",
        F.greatest(F.col("_n") - 1, F.lit(0)).cast("long").alias("defer_count"),
        status.alias("status"),
    )


def seconds(a: str, b: str):
    """Seconds from column ``a`` to ``b``, never under 0."""
    return F.greatest(F.lit(0).cast("long"), F.expr(f"timestampdiff(SECOND, {a}, {b})"))


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifecycle log: one row a QUEUED, DEFERRED, DISPATCHED, COMPLETED or FAILED event."""
    t = tasks(spark, sf_dir)
    ran = F.col("dispatch_at").isNotNull()
    event = lambda kind, at: F.struct(kind.alias("event_type"), at.alias("event_at"))
    rows = F.array(
        event(F.lit("QUEUED"), F.col("queued_at")),
        F.when(F.col("status") == "DEFERRED", event(F.lit("DEFERRED"), F.col("queued_at"))),
        F.when(ran, event(F.lit("DISPATCHED"), F.col("dispatch_at"))),
        F.when(ran & (F.col("status") != "DEFERRED"), event(F.col("status"), F.col("complete_at"))),
    )
    return t.select("task_id", "session", "priority", "queued_at", "dispatch_at", "complete_at", "defer_count", "status", F.inline(F.array_compact(rows)))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "ts",
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("pid"),
        at_most(F.col("value"), 100.0).alias("cpu_pct"),
        F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0)).alias("ram_pct"),
        (F.col("event_id") * 3 % 60).cast("double").alias("swap_pct"),
        (F.col("event_id") * 7 % 101).cast("double").alias("gpu_pct"),
        (F.col("event_id") * 5 % 90).cast("double").alias("disk_pct"),
        F.col("event_type").alias("kind"),
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return d.join(e, F.col("doc_id") == F.col("vec_id"), "left").select(
        F.col("doc_id").alias("paper_id"), "text", F.col("source").alias("category"), "lang", (2015 + F.col("n_chars") % 10).cast("int").alias("year"), F.coalesce("label", F.lit(-1)).alias("cluster_id")
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All queue entries with cost levels and the snapshot of the same number; one without a snapshot meets an idle machine without a GPU."""
    level = lambda c: F.when(c == 0, "none").when(c == 1, "low").when(c == 2, "medium").otherwise("high")
    k = F.col("task_id")
    t = tasks(spark, sf_dir).select(
        "task_id", F.concat(F.lit("task-"), k.cast("string")).alias("task_name"), "priority", (k % 37).alias("defer_count"), F.when(k % 41 == 0, "cancelled").otherwise("pending").alias("state"),
        level(1 + k % 3).alias("cpu_cost"), level(F.floor(k / 4) % 4).alias("ram_cost"), level(F.floor(k / 16) % 4).alias("gpu_cost"),
    )
    idle = {"cpu_pct": 0.0, "ram_pct": 0.0, "swap_pct": 0.0, "gpu_pct": 0.0, "gpu_available": False}
    s = telemetry(spark, sf_dir).select(F.col("seq").alias("task_id"), "cpu_pct", "ram_pct", "swap_pct", "gpu_pct", (F.col("seq") % 5 != 0).alias("gpu_available"))
    both = t.join(s, "task_id", "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in idle.items()})
    return both.withColumn("bottleneck", F.when((F.col("ram_pct") > 92) | (F.col("swap_pct") > 40), "oom_risk").otherwise("none"))


#: The default task catalogue: fixed values (name, priority, cpu, ram, gpu, seconds, dependencies, optional, retries, backoff, timeout, group).
CATALOGUE = [
    ("system_monitor_tick", 0, "low", "low", "none", 0.1, [], False, 5, 0.5, 5.0, "system"),
    ("alert_drain", 0, "low", "low", "none", 0.05, [], False, 3, 0.2, 2.0, "system"),
    ("query_reformulation", 1, "low", "low", "low", 5.0, [], False, 3, 2.0, 30.0, "retrieval"),
    ("cache_check", 1, "low", "low", "none", 0.5, ["query_reformulation"], False, 1, 0.5, 5.0, "retrieval"),
    ("arxiv_retrieval", 1, "low", "low", "none", 20.0, ["cache_check"], False, 3, 5.0, 120.0, "retrieval"),
    ("abstract_embedding", 2, "high", "medium", "medium", 60.0, ["arxiv_retrieval"], False, 2, 5.0, 300.0, "embedding"),
    ("faiss_index_build", 2, "medium", "medium", "medium", 10.0, ["abstract_embedding"], False, 2, 3.0, 60.0, "embedding"),
    ("hdbscan_clustering", 2, "high", "medium", "none", 10.0, ["abstract_embedding"], False, 2, 3.0, 120.0, "clustering"),
    ("umap_reduction", 3, "high", "high", "none", 20.0, ["abstract_embedding"], True, 1, 5.0, 180.0, "clustering"),
    ("cluster_labeling", 2, "medium", "low", "high", 30.0, ["hdbscan_clustering"], False, 3, 3.0, 120.0, "labeling"),
    ("gap_analysis_react", 1, "medium", "medium", "high", 45.0, ["cluster_labeling", "faiss_index_build"], False, 2, 5.0, 300.0, "gap_detection"),
    ("hypothesis_generation", 1, "low", "low", "medium", 20.0, ["gap_analysis_react"], False, 2, 3.0, 120.0, "hypothesis"),
    ("roadmap_building", 3, "low", "low", "low", 30.0, ["hypothesis_generation", "umap_reduction"], False, 2, 3.0, 180.0, "roadmap"),
    ("report_generation", 3, "low", "low", "none", 10.0, ["roadmap_building"], False, 2, 2.0, 60.0, "report"),
    ("stage_cache_write", 3, "low", "low", "none", 1.0, ["arxiv_retrieval"], True, 1, 1.0, 10.0, "utility"),
    ("experiment_checkpoint", 3, "low", "low", "none", 0.5, [], True, 1, 0.5, 5.0, "utility"),
]


def task_defs(spark: SparkSession) -> DataFrame:
    rows = [(n, p, c, r, g, s, o, m, b, t, grp) for n, p, c, r, g, s, _, o, m, b, t, grp in CATALOGUE]
    return spark.createDataFrame(rows, "name string, priority int, cpu_cost string, ram_cost string, gpu_cost string, estimated_s double, optional boolean, max_retries int, backoff_s double, timeout_s double, stage_group string")


def task_edges(spark: SparkSession) -> DataFrame:
    """(src, dst): ``dst`` depends on ``src``."""
    return spark.createDataFrame([(d, x[0]) for x in CATALOGUE for d in x[6]], "src string, dst string")


#: The same views for the oracle.
def _values(rows) -> str:
    lit = lambda v: "NULL" if v is None else ("true" if v is True else "false" if v is False else f"'{v}'" if isinstance(v, str) else repr(v))
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


SQL_VIEWS = {
    "tasks": """tasks AS (SELECT o_orderkey AS task_id, o_custkey AS session, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS priority, o_orderdate AS queued_at,
 min(l_shipdate) AS dispatch_at, max(l_shipdate) AS complete_at, greatest(count(l_orderkey) - 1, 0)::BIGINT AS defer_count,
 CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED' ELSE 'DEFERRED' END AS status
 FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate GROUP BY o_orderkey, o_custkey, o_orderpriority, o_orderdate, o_orderstatus)""",
    "task_events": """task_events AS (SELECT *, 'QUEUED' AS event_type, queued_at AS event_at FROM tasks
 UNION ALL SELECT *, 'DEFERRED', queued_at FROM tasks WHERE status = 'DEFERRED'
 UNION ALL SELECT *, 'DISPATCHED', dispatch_at FROM tasks WHERE dispatch_at IS NOT NULL
 UNION ALL SELECT *, status, complete_at FROM tasks WHERE dispatch_at IS NOT NULL AND status <> 'DEFERRED')""",
    "telemetry": """telemetry AS (SELECT ts, event_id AS seq, user_id AS pid, CASE WHEN value > 100 THEN 100.0 ELSE value END AS cpu_pct, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS ram_pct,
 (event_id * 3 % 60)::DOUBLE AS swap_pct, (event_id * 7 % 101)::DOUBLE AS gpu_pct, (event_id * 5 % 90)::DOUBLE AS disk_pct, event_type AS kind FROM events)""",
    "papers": """papers AS (SELECT doc_id AS paper_id, text, source AS category, lang, (2015 + n_chars % 10)::INT AS year, coalesce(label, -1) AS cluster_id
 FROM documents LEFT JOIN embeddings ON doc_id = vec_id)""",
    "entries": """entries AS (SELECT t.task_id, 'task-' || t.task_id AS task_name, priority, t.task_id % 37 AS defer_count, CASE WHEN t.task_id % 41 = 0 THEN 'cancelled' ELSE 'pending' END AS state,
 (['none','low','medium','high'])[2 + t.task_id % 3] AS cpu_cost, (['none','low','medium','high'])[1 + (t.task_id // 4) % 4] AS ram_cost, (['none','low','medium','high'])[1 + (t.task_id // 16) % 4] AS gpu_cost,
 coalesce(cpu_pct, 0.0) AS cpu_pct, coalesce(ram_pct, 0.0) AS ram_pct, coalesce(swap_pct, 0.0) AS swap_pct, coalesce(gpu_pct, 0.0) AS gpu_pct, coalesce(seq % 5 <> 0, false) AS gpu_available,
 CASE WHEN ram_pct > 92 OR swap_pct > 40 THEN 'oom_risk' ELSE 'none' END AS bottleneck
 FROM tasks t LEFT JOIN telemetry ON seq = t.task_id)""",
    "task_defs": f"task_defs(name, priority, cpu_cost, ram_cost, gpu_cost, estimated_s, optional, max_retries, backoff_s, timeout_s, stage_group) AS (VALUES {_values([(n, p, c, r, g, s, o, m, b, t, grp) for n, p, c, r, g, s, _, o, m, b, t, grp in CATALOGUE])})",
    "task_edges": f"task_edges(src, dst) AS (VALUES {_values([(d, x[0]) for x in CATALOGUE for d in x[6]])})",
}


def sql(body: str, *views: str, recursive: str = "") -> str:
    """``body`` under the named views."""
    parts = [SQL_VIEWS[v] for v in views] + ([recursive] if recursive else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}" if parts else body
