"""Grouped corpus statistics, vector search, tiering and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import cosine


def first_seen(papers: DataFrame) -> DataFrame:
    """One paper a text: the first by id."""
    return papers.groupBy(F.xxhash64("text"), F.length("text")).agg(F.min("paper_id").alias("paper_id")).select("paper_id")


def dominant_category(papers: DataFrame) -> DataFrame:
    counts = papers.groupBy("cluster_id", "category").agg(F.count("*").alias("_c"))
    r = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("_c"), "category"))
    return counts.withColumn("_r", r).where("_r = 1").select("cluster_id", "category")


def trend(papers: DataFrame) -> DataFrame:
    """growing, declining or stagnating, by years on both sides of the upper median year.

    Counts by year first, so a cluster of any size is a few rows."""
    by_year = papers.groupBy("cluster_id", "year").agg(F.count("*").alias("_c"))
    run = F.sum("_c").over(W.partitionBy("cluster_id").orderBy("year"))
    all_ = F.sum("_c").over(W.partitionBy("cluster_id"))
    x = by_year.withColumns({"_run": run, "n": all_})
    mid = F.min(F.when(F.col("_run") >= F.floor(F.col("n") / 2) + 1, F.col("year"))).over(W.partitionBy("cluster_id"))
    g = x.withColumn("_mid", mid).groupBy("cluster_id").agg(F.max("n").alias("n"), F.sum(F.when(F.col("year") >= F.col("_mid"), F.col("_c")).otherwise(0)).alias("newer"), F.sum(F.when(F.col("year") < F.col("_mid"), F.col("_c")).otherwise(0)).alias("older"))
    kind = F.when(F.col("n") < 4, "insufficient data").when(F.col("newer") > 1.5 * F.col("older"), "growing").when(F.col("newer") < 0.6 * F.col("older"), "declining").otherwise("stagnating")
    return g.select("cluster_id", kind.alias("trend"))


def keyword_rate(papers: DataFrame, keywords: list[str]) -> DataFrame:
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(F.lower("text"), F.lit(k))
    return papers.groupBy("cluster_id").agg(F.round(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), 3).alias("rate"))


def profile(papers: DataFrame, keywords: list[str]) -> DataFrame:
    base = papers.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("year").alias("from_year"), F.max("year").alias("to_year"))
    return base.join(dominant_category(papers), "cluster_id").join(trend(papers), "cluster_id").join(keyword_rate(papers, keywords), "cluster_id")


def year_histogram(papers: DataFrame, last: int = 5) -> DataFrame:
    return papers.groupBy("year").agg(F.count("*").alias("n")).orderBy(F.desc("year")).limit(last)


def first_keyword(papers: DataFrame, keywords: list[str]) -> DataFrame:
    found = F.coalesce(*[F.when(F.contains(F.lower("text"), F.lit(k)), F.lit(k)) for k in keywords])
    return papers.withColumn("keyword", found).where(F.col("keyword").isNotNull()).groupBy("keyword").agg(F.count("*").alias("n"))


def density(papers: DataFrame) -> DataFrame:
    """sparse, moderate or dense against the median cluster size (noise left out)."""
    c = papers.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("n"))
    m = c.agg(F.median("n").alias("_m"))
    return c.crossJoin(F.broadcast(m)).select("cluster_id", "n", F.when(F.col("n") < 0.4 * F.col("_m"), "sparse").when(F.col("n") > 1.8 * F.col("_m"), "dense").otherwise("moderate").alias("density"))


def cosine_topk(vectors: DataFrame, query_id: int, k: int = 5) -> DataFrame:
    """Nearest vectors by cosine; one broadcast query row."""
    q = vectors.where(F.col("vec_id") == query_id).limit(1).select(F.col("embedding").alias("_q"))
    return vectors.join(F.broadcast(q)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("_q")), 5).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def tiers(papers: DataFrame, gap_clusters: list[int]) -> DataFrame:
    """Reading tiers: core, survey, gap, frontier and rest; with the size of each paper's cluster (null for noise)."""
    t = trend(papers)
    size = papers.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("_n"))
    top = size.withColumn("_top", F.row_number().over(W.orderBy(F.desc("_n"), "cluster_id")) <= 3)
    thr = F.broadcast(papers.where("cluster_id >= 0").agg(F.coalesce(F.max("year") - 1, F.lit(2023)).alias("_thr")))
    x = papers.join(F.broadcast(t), "cluster_id", "left").join(F.broadcast(top), "cluster_id", "left").crossJoin(thr)
    tier = (
        F.when(F.col("cluster_id") < 0, 5).when(F.coalesce("_top", F.lit(False)) & (F.col("year") <= F.col("_thr") - 2), 1).when((F.col("year") >= F.col("_thr")) & (F.col("trend") == "growing"), 4)
        .when(F.col("cluster_id").isin(gap_clusters), 3).otherwise(2)
    )
    return x.select("paper_id", "cluster_id", "year", tier.alias("tier"), F.col("_n").alias("cluster_size"))


def select_by_budget(tiered: DataFrame, target: int, shares: dict[int, float] | None = None) -> DataFrame:
    """The first of each tier, in the tier's own order, up to its budget."""
    shares = shares or {1: 0.20, 2: 0.25, 3: 0.25, 4: 0.20, 5: 0.10}
    most = {t: max(1, round(target * s)) for t, s in shares.items()}
    budget = F.expr("CASE tier " + " ".join(f"WHEN {t} THEN {n}" for t, n in most.items()) + " END")
    key = F.when(F.col("tier") == 1, F.col("year")).when(F.col("tier") == 2, -F.col("cluster_size")).when(F.col("tier").isin(3, 4), -F.col("year")).otherwise(0)
    r = F.row_number().over(W.partitionBy("tier").orderBy(key, "paper_id"))
    # the literal bound lets each partition keep its own first few before the shuffle: no tier is ranked whole
    few = tiered.withColumn("_r", r).where(F.col("_r") <= max(most.values()))
    return few.where(F.col("_r") <= budget).select("paper_id", "tier", F.col("_r").alias("rank"))


def reading_order(selected: DataFrame) -> DataFrame:
    key = F.when(F.col("tier") == 1, F.col("year")).when(F.col("tier") == 4, -F.col("year")).otherwise(0)
    return selected.select("paper_id", "tier", F.row_number().over(W.orderBy("tier", key, "paper_id")).alias("reading_order"))


def connects(papers: DataFrame, most: int = 3) -> DataFrame:
    """Up to ``most`` other papers of the same cluster, first by id: from the first few of each cluster, without pairing it with itself."""
    lead = papers.where("cluster_id >= 0").withColumn("_r", F.row_number().over(W.partitionBy("cluster_id").orderBy("paper_id"))).where(F.col("_r") <= most + 1)
    lists = lead.groupBy("cluster_id").agg(F.array_sort(F.collect_list("paper_id")).alias("_l"))
    own = papers.where("cluster_id >= 0").join(F.broadcast(lists), "cluster_id")
    return own.select("paper_id", F.array_join(F.slice(F.array_except("_l", F.array("paper_id")), 1, most), ",").alias("connects"))
