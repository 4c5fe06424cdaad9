"""The join behind tasks and their log is dealt over parts whose number grows with the tables; bars and markers from one pass."""

import duckdb
import pytest
from pyspark.sql import functions as F

from taskloom.plans import catalogue
from taskloom.sources import adapters as src

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_parts_grow_with_the_tables(spark, monkeypatch):
    few = rows(src.tasks(spark, SF))
    monkeypatch.setattr(src, "MOST", 200, raising=False)
    n = src.table(spark, SF, "orders").count() + src.table(spark, SF, "lineitem").count()
    t = src.tasks(spark, SF)
    assert rows(t) == few
    held = [r["n"] for r in t.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(held) >= 0.8 * n / 200
    assert t.rdd.getNumPartitions() >= n // 200


@pytest.mark.parametrize("most", [200, 1_000_000])
@pytest.mark.parametrize("name", ["N1_gantt_rows", "B2_completed_only", "C11_lifecycle_fill"])
def test_as_the_sql(spark, monkeypatch, name, most):
    monkeypatch.setattr(src, "MOST", most, raising=False)
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    want = con.execute(catalogue.ORACLE_SQL[name]).fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_gantt_joins_once(spark):
    plan = catalogue.QUERIES["N1_gantt_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1
