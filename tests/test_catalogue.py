"""Every query of the engine's own operators against its oracle SQL, at the smallest scale."""

import math
import os

import duckdb
import pandas as pd
import pytest

from taskloom.plans.catalogue import ORACLE_SQL, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.sql(f"create view {t.split('.')[0]} as select * from '{DIR}/{t}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DIR).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda f: sorted((tuple(map(plain, r)) for r in f[columns].astype(object).itertuples(index=False)), key=repr)
    assert rows(ours) == rows(theirs)
