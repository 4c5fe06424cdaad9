"""Results of several scans agree with one scan's on a source whose row order changes with every scan."""

import pytest
from pyspark.sql import functions as F

from taskloom.llm import decontaminate, licenses, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def unstable(spark):
    """A table dealt anew on each scan: by a random number, over more partitions than it had."""

    def made():
        docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
        return docs.withColumn("_r", F.rand()).repartition(7, "_r").sortWithinPartitions("_r").drop("_r")

    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield made
    spark.conf.unset("spark.sql.exchange.reuse")


def rows(df):
    return sorted(map(str, df.collect()))


def test_decontamination(spark, unstable):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = rows(decontaminate.contamination_digest(unstable(), bench))
    many = rows(decontaminate.contamination_digest(unstable(), bench, block_bytes=20_000))
    assert many == one and len(one) == 200
    assert rows(decontaminate.remove_spans(unstable(), bench, block_bytes=20_000)) == rows(decontaminate.remove_spans(unstable(), bench))


def test_licenses(unstable):
    one = rows(licenses.license_digest(unstable()))
    assert rows(licenses.license_digest(unstable(), block=20)) == one and len(one) == 200


def test_a_radius_without_a_plan_is_an_error(spark):
    nodes = spark.createDataFrame([(1,), (2**24,), (-1,)], "fp long")
    assert simhash.plan(nodes, 3, 20)[1]
    with pytest.raises(ValueError):
        simhash.plan(nodes, 3, 24)
