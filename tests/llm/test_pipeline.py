"""The pipeline's stages: columns stay, decisions take effect."""

import corpus_pipeline
from taskloom.llm import decontaminate, quality, secrets

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR).cache()
        assert sorted(out.columns) == sorted(columns) and out.count() <= before
        if name == "quality_rules":
            kept = quality.quality_digest(docs, spark.read.parquet(f"{DIR}/labels.parquet")).where("kept").count()
            assert out.count() == kept
        if name == "decontamination":
            assert decontaminate.contamination_digest(out, bench).where("contaminated").count() == 0
        if name == "secret_scan":
            assert secrets.secret_digest(out).where("spans <> ''").count() == 0
        docs, before = out, out.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert last.count() == before and corpus_pipeline.run(spark, DIR).count() == before
