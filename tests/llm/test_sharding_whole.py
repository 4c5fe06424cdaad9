"""Groups of equal texts stay whole where many rows have copies."""

import pytest
from pyspark.sql import functions as F

from taskloom.llm import sharding

N, SHARDS = 2400, 24


@pytest.mark.parametrize("hot, copies", [(0, 2), (N // 3, 3), (N // 3, 1)])
def test_groups_stay_whole(spark, hot, copies):
    docs = spark.range(N).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.when(F.col("id") < hot, -1).otherwise(F.floor(F.col("id") / copies)).cast("string")).alias("text"))
    rows = sharding.shard_documents(docs, n_shards=SHARDS).select("doc_id", "shard", "slot").join(docs, "doc_id").collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(SHARDS) for k in range(N // SHARDS)]
    shards = {}
    for r in rows:
        shards.setdefault(r.text, set()).add(r.shard)
    if hot:
        assert len(shards.pop("t-1")) == hot // (N // SHARDS)
    # at most one group is cut at the end of each shard
    assert sum(len(s) > 1 for s in shards.values()) < SHARDS
