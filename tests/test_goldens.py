"""Values known from the operators' definitions."""

from pyspark.sql import functions as F

from taskloom.functions.scalar import backoff
from taskloom.operators import dag, policy, queue, telemetry
from taskloom.sources.adapters import task_defs, task_edges


def test_critical_path_and_levels(spark):
    d, e = task_defs(spark), task_edges(spark)
    top = dag.critical_path(d, e).first()
    assert top["cost"] == 230.5 and top["path"].startswith("query_reformulation>cache_check")
    assert dag.levels(d, e).agg(F.max("level")).first()[0] == 9
    assert {r[0] for r in dag.isolated(d, e).collect()} == {"system_monitor_tick", "alert_drain", "experiment_checkpoint"}


def test_backoff(spark):
    k = spark.range(1, 8).select(*[backoff(x, 2.0, F.col("id")).alias(x) for x in ("exponential", "linear", "constant", "fibonacci")]).collect()
    assert [r.exponential for r in k] == [2, 4, 8, 16, 32, 60, 60]
    assert [r.fibonacci for r in k] == [2, 2, 4, 6, 10, 16, 26]
    assert [r.linear for r in k][-1] == 14 and {r.constant for r in k} == {2.0}


def test_aging(spark):
    rows = spark.createDataFrame([(4, 9), (4, 10), (4, 39), (4, 40), (4, 50), (1, 50), (0, 99)], "priority int, ticks int")
    assert [r.effective for r in queue.aged(rows).collect()] == [4, 3, 1, 0, 0, 0, 0]


def test_first_rule_decides(spark):
    row = dict(task_id="a", task_name="x", state="pending", priority=2, defer_count=0, cpu_cost="high", ram_cost="medium", gpu_cost="none", cpu_pct=87.0, ram_pct=94.0, swap_pct=0.0, gpu_pct=0.0, gpu_available=True, bottleneck="none")
    case = lambda **k: policy.evaluate(spark.createDataFrame([row | k])).first()
    assert (case().rule, case().retry_s) == ("oom_risk_guard", 5.0)
    assert case(ram_pct=50.0).rule == "cpu_threshold" and case(ram_pct=50.0).retry_s == 4.0
    assert case(priority=0).rule == "critical_bypass" and case(state="cancelled", priority=0).action == "skip"
    assert case(defer_count=31).action == "force_dispatch"
    assert case(ram_pct=10.0, cpu_pct=10.0).action == "dispatch"


def test_stale_counter_rows_are_not_compared_with(spark):
    t = spark.sql("SELECT * FROM VALUES (1, 1, TIMESTAMP_NTZ'2024-01-01 00:00:00', 10D), (1, 2, TIMESTAMP_NTZ'2024-01-01 00:00:00', 99D), (1, 3, TIMESTAMP_NTZ'2024-01-01 00:00:02', 14D), (1, 4, TIMESTAMP_NTZ'2024-01-01 00:00:03', 1D) AS t(pid, seq, ts, counter)")
    assert {r.seq: r.rate for r in telemetry.counter_rate(t).collect()} == {1: 0.0, 2: 0.0, 3: 2.0, 4: 0.0}
