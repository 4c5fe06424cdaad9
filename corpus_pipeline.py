"""Corpus pipeline: each stage reads what the one before it kept.

Defined results: null and empty texts fail the quality rules, so later stages meet them only if called alone (see each
operator); repeated rows and equal ids are judged each on its own, then near-duplicates keep one of equal rows; empty
tables give empty tables; extra columns of any name stay.  One document, of any length, is held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taskloom.llm import decontaminate, piece_codec, quality, secrets, simhash
from taskloom.llm.queries import vocabulary
from taskloom.llm.scratch import clear, fresh_path, made


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the likelihood ratio reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their 5-word shingles and more) stays: the one of least id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return secrets.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and of the decoded text of each document."""
    return piece_codec.round_trip(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("encoding", encoding),
]
#: Hashing and tokenization can't be stated in SQL; tests/llm/test_pipeline_brute.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, each written to shared storage; what a stage and the one before it left there goes when it is done."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), set()
    for name, stage in STAGES:
        before = made()
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        clear(spark, keep=before - last | {path})
        last = {path}
    return docs
