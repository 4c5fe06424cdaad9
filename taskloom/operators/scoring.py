"""Gap evidence, novelty, hypothesis ranking and milestones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import clamp
from .corpus import dominant_category, keyword_rate, trend


def gaps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, [0, 2]), (1, [1, 2]), (2, [3, 99])], "gap_id int, clusters array<int>")


def gap_clusters(g: DataFrame, papers: DataFrame) -> DataFrame:
    sizes = papers.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return g.select("gap_id", F.posexplode("clusters").alias("pos", "cluster_id")).join(sizes, "cluster_id")


def gap_papers(g: DataFrame, papers: DataFrame) -> DataFrame:
    each = g.select("gap_id", F.explode(F.array_distinct("clusters")).alias("cluster_id"))
    return papers.join(F.broadcast(each), "cluster_id")


def gap_recent(g: DataFrame, papers: DataFrame, most: int = 8) -> DataFrame:
    r = F.row_number().over(W.partitionBy("gap_id").orderBy(F.desc("year"), "paper_id"))
    return gap_papers(g, papers).withColumn("_r", r).where(F.col("_r") <= most).select("gap_id", "paper_id")


def clusters(papers: DataFrame, words: list[str]) -> DataFrame:
    return papers.groupBy("cluster_id").agg(F.count("*").alias("n")).join(trend(papers), "cluster_id").join(keyword_rate(papers, words), "cluster_id")


def gap_evidence(g: DataFrame, papers: DataFrame, words: list[str]) -> DataFrame:
    return _evidence(g, clusters(papers, words)).withColumn("avg_papers", F.round("avg_papers", 4))


def _evidence(g: DataFrame, c: DataFrame) -> DataFrame:
    e = g.select("gap_id", (F.size("clusters") > 1).alias("multi"), F.explode("clusters").alias("cluster_id")).join(c, "cluster_id", "left")
    return e.groupBy("gap_id").agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_papers"), F.coalesce(F.min("rate"), F.lit(0.0)).alias("min_repro"), F.count_if(F.col("trend") == "stagnating").alias("stagnating"), F.first("multi").alias("multi"), F.count("n").alias("n_clusters"))


def gap_categories(g: DataFrame, papers: DataFrame) -> DataFrame:
    """How many distinct dominant categories the clusters of each gap have."""
    each = g.select("gap_id", F.explode("clusters").alias("cluster_id"))
    return each.join(dominant_category(papers), "cluster_id", "left").groupBy("gap_id").agg(F.count_distinct("category").alias("n_categories"))


def novelty(g: DataFrame, papers: DataFrame, words: list[str]) -> DataFrame:
    """Six signals of each gap and their weighted sum, clamped to 0..1."""
    c = clusters(papers, words)
    ends = c.agg(F.min("n").alias("_lo"), F.max("n").alias("_hi"))
    x = _evidence(g, c).join(gap_categories(g, papers), "gap_id").crossJoin(F.broadcast(ends))
    s = x.select(
        "gap_id",
        F.round(F.when(F.col("_hi") == F.col("_lo"), 0.5).otherwise(1 - F.try_divide(F.col("avg_papers") - F.col("_lo"), F.col("_hi") - F.col("_lo"))), 4).alias("sparsity"),
        F.round(F.col("stagnating") / F.greatest("n_clusters", F.lit(1)), 4).alias("recency"), F.round(1 - F.col("min_repro"), 4).alias("repro_gap"),
        F.round(F.least(F.lit(1.0), (F.col("n_clusters") - 1) / 3), 4).alias("distance"), F.round(F.least(F.lit(1.0), F.when(F.col("multi"), 0.4).otherwise(0.0) + 0.2 * F.col("n_categories")), 4).alias("overlap"),
    )
    return s.withColumn("novelty", F.round(clamp(0.2 * F.col("sparsity") + 0.2 * F.col("recency") + 0.15 * F.col("repro_gap") + 0.15 * F.col("distance") + 0.15 * F.col("overlap") + 0.15 * 0.5, 0, 1), 4))


def hypotheses(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(k.alias("id"), (k % 7).alias("gap_id"), F.col("p_brand").alias("method"), F.round(k * 37 % 101 / 100.0, 4).alias("novelty"), F.round(F.col("p_size") % 11 / 10.0, 4).alias("feasibility"), F.round(k * 13 % 51 / 50.0, 4).alias("impact"))


def composite(h: DataFrame) -> DataFrame:
    return h.withColumn("score", F.round(0.4 * F.col("novelty") + 0.3 * F.col("feasibility") + 0.3 * F.col("impact"), 4))


def diversity(h: DataFrame) -> DataFrame:
    """From the third of a method on, 0.05 less.

    Only the first two of each method escape it: they are found by aggregation (a first, then a first of the rest), so no
    method is ranked whole in one task."""
    at = F.struct((-F.col("score")).alias("s"), "id")
    first = h.groupBy("method").agg(F.min(at).alias("_1"))
    second = h.join(F.broadcast(first), "method").where(at > F.col("_1")).groupBy("method").agg(F.min(at).alias("_2"))
    free = F.broadcast(first.join(second, "method", "left"))
    escapes = (F.col("id") == F.col("_1.id")) | F.coalesce(F.col("id") == F.col("_2.id"), F.lit(False))
    return h.join(free, "method").withColumn("adjusted", F.round(F.when(escapes, F.col("score")).otherwise(F.greatest(F.lit(0.0), F.col("score") - 0.05)), 4)).drop("_1", "_2")


def shortlist(h: DataFrame, n: int, most: int = 2) -> DataFrame:
    r = F.row_number().over(W.partitionBy("gap_id").orderBy(F.desc("score"), "id"))
    return h.withColumn("_r", r).where(F.col("_r") <= most).orderBy(F.desc("score"), "id").limit(n).drop("_r")


def milestones(selected: DataFrame, weeks: int) -> DataFrame:
    """Weeks of each non-empty tier, evenly."""
    t = selected.select("tier").distinct()
    k, each = F.row_number().over(W.orderBy("tier")), F.greatest(F.lit(1), F.floor(F.lit(weeks) / F.count("*").over(W.partitionBy(F.lit(1)))))
    return t.select("tier", ((k - 1) * each + 1).cast("int").alias("week_start"), F.least(F.lit(weeks), k * each).cast("int").alias("week_end"))


def weekly(selected: DataFrame, weeks: int) -> DataFrame:
    """The papers of each week: every tier's, in order, cut evenly over its weeks; what doesn't divide is left out."""
    n = selected.groupBy("tier").agg(F.count("*").alias("_n"))
    span = milestones(selected, weeks).join(n, "tier").withColumn("_weeks", F.col("week_end") - F.col("week_start") + 1)
    each = span.select("tier", "week_start", "_weeks", F.greatest(F.lit(1), F.floor(F.col("_n") / F.greatest(F.lit(1), F.col("_weeks")))).alias("_each"))
    x = selected.join(F.broadcast(each), "tier").withColumn("_k", F.floor((F.col("rank") - 1) / F.col("_each")))
    return x.where(F.col("_k") < F.col("_weeks")).select((F.col("week_start") + F.col("_k")).cast("int").alias("week"), "tier", "paper_id")


def title_match(papers: DataFrame, titles: list[str], most: int = 5, head: int = 30) -> DataFrame:
    """First paper by id whose text holds the head of each title, for the first ``most`` titles that one holds.

    One aggregation with a column a title: no join."""
    text = F.lower("text")
    found = papers.agg(*[F.min(F.when(F.contains(text, F.lit(x.lower()[:head])), F.col("paper_id"))).alias(f"_{i}") for i, x in enumerate(titles)])
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(x).alias("title"), F.col(f"_{i}").alias("paper_id")) for i, x in enumerate(titles)])
    return found.select(F.inline(F.slice(F.filter(rows, lambda r: r["paper_id"].isNotNull()), 1, most)))
