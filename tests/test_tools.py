"""Table functions: odd cells, and arguments that are turned away."""

import pytest
from pyspark.errors import AnalysisException

from taskloom.operators import tools

CELLS = "cluster_id int, cells array<struct<year:int,category:string,n:bigint,hits:bigint>>"


def test_odd_cells(spark):
    q = spark.createDataFrame([(1, None), (2, []), (3, [(2020, "b", 2, 1), (2021, "a", 2, 0)]), (3, [(2020, None, 5, 0)])], CELLS)
    got = sorted(map(tuple, tools.answered(q).collect()), key=str)
    assert [r[:5] for r in got] == [(3, 4, 2020, 2021, "a"), (3, 5, 2020, 2020, None)] and [r[6] for r in got] == [0.25, 0.0]
    assert sorted(map(tuple, tools.years_of(q, 1).collect())) == [(3, 2020, 5), (3, 2021, 2)]


def test_wrong_arguments(spark):
    tools.register(spark)
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM cluster_size('text')").collect()
