"""Admission policy: an ordered list of rules, each a nullable column; the first that isn't null decides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import headroom, round_exact

Rule = Callable[[], Column]


def decide(action: str, rule: str, retry: float | Column = 0.0) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"), (retry if isinstance(retry, Column) else F.lit(float(retry))).alias("retry_s"))


def stepped(over: Column, base: float) -> Column:
    return F.when(over < 5, base).when(over < 15, 2.0 * base).otherwise(4.0 * base)


def _needs(cost: str, table: dict[str, float]) -> Column:
    return F.expr("CASE " + cost + " " + " ".join(f"WHEN '{k}' THEN {float(v)}D" for k, v in table.items()) + " ELSE 0D END")


def cancellation() -> Column:
    return F.when((F.col("state") == "cancelled") | (F.coalesce(F.col("task_id").cast("string"), F.lit("")) == "") | (F.coalesce("task_name", F.lit("")) == ""), decide("skip", "cancellation_check"))


def critical() -> Column:
    return F.when(F.col("priority") == 0, decide("dispatch", "critical_bypass"))


def starvation(limit: int = 30) -> Column:
    return F.when(F.col("defer_count") >= limit, decide("force_dispatch", "starvation_valve"))


def oom() -> Column:
    light = F.col("ram_cost").isin("none", "low")
    return F.when(((F.col("bottleneck") == "oom_risk") | (F.col("ram_pct") >= 92)) & ~light, decide("defer", "oom_risk_guard", 5.0)).when((F.col("swap_pct") >= 40) & (F.col("ram_cost") == "high"), decide("defer", "oom_risk_guard", 8.0))


def cpu() -> Column:
    c, cost = F.col("cpu_pct"), F.col("cpu_cost")
    hit = lambda at: decide("defer", "cpu_threshold", stepped(c - at, 2.0))
    return F.when((c >= 95) & ~cost.isin("none", "low"), hit(95.0)).when((cost == "high") & (c >= 80), hit(80.0)).when((cost == "medium") & (c >= 88), hit(88.0))


def ram() -> Column:
    r, cost = F.col("ram_pct"), F.col("ram_cost")
    need = _needs("ram_cost", {"none": 0, "low": 8, "medium": 15, "high": 25})
    return F.when(headroom(r) < need, decide("defer", "ram_threshold", stepped(r - 75.0, 4.0))).when((cost == "high") & (r >= 75), decide("defer", "ram_threshold", 5.0)).when((cost == "medium") & (r >= 85), decide("defer", "ram_threshold", 4.0))


def gpu() -> Column:
    g, cost = F.col("gpu_pct"), F.col("gpu_cost")
    on = F.col("gpu_available") & (cost != "none")
    return F.when(on & (g >= 97), decide("defer", "gpu_threshold", 10.0)).when(on & (cost == "high") & (g >= 85), decide("defer", "gpu_threshold", stepped(g - 85.0, 5.0))).when(on & (cost == "medium") & (g >= 92), decide("defer", "gpu_threshold", 8.0))


def levels() -> Column:
    short = (
        (headroom(F.col("cpu_pct")) < _needs("cpu_cost", {"none": 0, "low": 5, "medium": 15, "high": 25}))
        | (headroom(F.col("ram_pct")) < _needs("ram_cost", {"none": 0, "low": 8, "medium": 15, "high": 25}))
        | (F.col("gpu_available") & (headroom(F.col("gpu_pct")) < _needs("gpu_cost", {"none": 0, "low": 5, "medium": 12, "high": 20})))
    )
    return F.when(short, decide("defer", "cost_level_check", 3.0))


RULES: list[Rule] = [cancellation, critical, starvation, oom, cpu, ram, gpu, levels]


def evaluate(entries: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Adds the deciding action, rule and retry delay to every entry."""
    chosen = F.coalesce(*[r() for r in rules], decide("dispatch", "default"))
    return entries.withColumn("_d", chosen).select("*", "_d.action", "_d.rule", "_d.retry_s").drop("_d")


def stats(decisions: DataFrame) -> DataFrame:
    """One row: decisions by action, the rates of dispatch (forced ones too) and deferral, and mean cpu and ram at deferral; 0 where there are none."""
    n, of = F.count("*"), lambda *a: F.count_if(F.col("action").isin(*a))
    rate = lambda x: round_exact(F.when(n > 0, x / n).otherwise(0.0), 4)
    at = lambda c: round_exact(F.coalesce(F.avg(F.when(F.col("action") == "defer", F.col(c))), F.lit(0.0)), 2)
    return decisions.agg(
        n.alias("total"), of("dispatch").alias("dispatched"), of("force_dispatch").alias("forced"), of("defer").alias("deferred"), of("skip").alias("skipped"),
        rate(of("dispatch", "force_dispatch")).alias("dispatch_rate"), rate(of("defer")).alias("defer_rate"), at("cpu_pct").alias("cpu_at_defer"), at("ram_pct").alias("ram_at_defer"),
    )


def evaluate_batch(entries: DataFrame, snapshot: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """All entries against one snapshot: a table of one row, which is broadcast."""
    return evaluate(entries.crossJoin(F.broadcast(snapshot.limit(1))), rules)


class Chain:
    """An editable chain of rules."""

    def __init__(self, rules: list[Rule] = RULES):
        self._rules = list(rules)

    def prepend(self, rule: Rule) -> None:
        self._rules.insert(0, rule)

    def append(self, rule: Rule) -> None:
        self._rules.append(rule)

    def remove(self, name: str) -> bool:
        """Takes out the first rule of this name; whether there was one."""
        at = next((i for i, r in enumerate(self._rules) if r.__name__ == name), None)
        if at is not None:
            del self._rules[at]
        return at is not None

    def names(self) -> list[str]:
        return [r.__name__ for r in self._rules]

    def evaluate(self, entries: DataFrame) -> DataFrame:
        return evaluate(entries, self._rules)
