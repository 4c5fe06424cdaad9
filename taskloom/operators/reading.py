"""Reading lists, annotations, coverage and links between papers, gaps and hypotheses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .corpus import trend

#: Defaults of an annotation's fields: fixed values.
DEFAULTS = {"why_read": "Core paper in the research area.", "key_takeaway": "See abstract.", "reading_note": "Focus on methodology.", "estimated_mins": 45, "difficulty": "medium", "priority": "high"}
#: Progress after each stage, in percent: fixed values.
PROGRESS = [("query_reformulation", 8.0), ("arxiv_retrieval", 20.0), ("embedding_generation", 38.0), ("clustering", 50.0), ("cluster_labeling", 62.0), ("gap_detection", 76.0), ("hypothesis_generation", 86.0), ("roadmap_building", 94.0), ("report_generation", 100.0)]


def with_cluster(papers: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each paper's cluster label; papers without one are Unclustered."""
    return papers.join(clusters.select("cluster_id", "label"), "cluster_id", "left").withColumn("label", F.coalesce("label", F.lit("Unclustered")))


def annotate(papers: DataFrame, annotations: DataFrame, defaults: dict = DEFAULTS) -> DataFrame:
    """Papers (paper_id, title) with the annotation's fields, each with its own default."""
    have = [c for c in defaults if c in annotations.columns]
    x = papers.select("paper_id", "title").join(annotations.select("paper_id", *have), "paper_id", "left")
    field = lambda c, v: (F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v)).alias(c)
    return x.select("paper_id", F.substring("title", 1, 80).alias("one_line_summary"), *[field(c, v) for c, v in defaults.items()])


def hypothesis_links(hypotheses: DataFrame, chosen: DataFrame) -> DataFrame:
    """Related papers of each hypothesis that are on the list, in their order, comma-joined; empty where none is."""
    each = hypotheses.select("hypothesis_id", F.posexplode_outer("related").alias("pos", "paper_id"))
    met = each.join(chosen.select("paper_id", F.lit(True).alias("_on")).distinct(), "paper_id", "left")
    lists = met.groupBy("hypothesis_id").agg(F.sort_array(F.collect_list(F.when(F.col("_on"), F.struct("pos", "paper_id")))).alias("_l"))
    return lists.select("hypothesis_id", F.array_join(F.transform("_l", lambda x: x["paper_id"].cast("string")), ",").alias("papers"))


def gap_coverage(gaps: DataFrame, clusters: DataFrame, ordered: DataFrame, most: int = 6) -> DataFrame:
    """The first listed papers (paper_id, cluster_id, reading_order) of each gap's clusters, cluster by cluster; clusters of one label count as the first of them."""
    first = clusters.groupBy("label").agg(F.min("cluster_id").alias("_owner"))
    named = clusters.join(first, "label").select("cluster_id", "_owner")
    each = gaps.select("gap_id", F.posexplode("clusters").alias("pos", "_owner"))
    met = ordered.join(F.broadcast(named), "cluster_id").join(F.broadcast(each), "_owner")
    r = F.row_number().over(W.partitionBy("gap_id").orderBy("pos", "reading_order"))
    return met.withColumn("rank", r).where(F.col("rank") <= most).select("gap_id", "rank", "paper_id")


def zipped(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows of equal position; what one side has more is left out."""
    return left.join(right, pos)


def stage_peaks(stages: DataFrame, peaks: DataFrame) -> DataFrame:
    """Stages with their resource peaks, a dash where none was seen."""
    shown = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.format_string("%.1f%%", F.col(c))).alias(c)
    return stages.join(peaks, "stage", "left").select("stage", "duration_s", shown("cpu_peak"), shown("ram_peak"))


def week_milestones(milestones: DataFrame) -> DataFrame:
    """The milestone of each week; of several the last one."""
    each = milestones.where("week_start <= week_end").select("tier", F.explode(F.sequence("week_start", "week_end")).alias("week"))
    return each.groupBy("week").agg(F.max("tier").alias("tier"))


def _first_of_cluster(papers: DataFrame, clusters: DataFrame, key, most: int) -> DataFrame:
    """The first ``most`` papers of each of a few clusters (cluster_id, pos)."""
    r = F.row_number().over(W.partitionBy("cluster_id").orderBy(key, "paper_id"))
    return papers.join(F.broadcast(clusters), "cluster_id").withColumn("_r", r).where(F.col("_r") <= most).select("paper_id", "pos", F.col("_r").alias("rank"))


def reading_list(papers: DataFrame, gap_clusters: list[int], most: int = 20) -> DataFrame:
    """The simple list: two oldest of the three largest clusters, eight newest of the gaps' clusters, two newest of the first two growing ones; each paper once, where it comes first."""
    size = papers.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("_n"))
    large = size.orderBy(F.desc("_n"), "cluster_id").limit(3).withColumn("pos", F.row_number().over(W.orderBy(F.desc("_n"), "cluster_id"))).select("cluster_id", "pos")
    growing = trend(papers).where("cluster_id >= 0 AND trend = 'growing'").orderBy("cluster_id").limit(2).withColumn("pos", F.row_number().over(W.orderBy("cluster_id"))).select("cluster_id", "pos")
    newest = papers.where(F.col("cluster_id").isin(gap_clusters)).orderBy(F.desc("year"), "paper_id").limit(8)
    newest = newest.select("paper_id", F.lit(1).alias("pos"), F.row_number().over(W.orderBy(F.desc("year"), "paper_id")).alias("rank"))
    parts = [_first_of_cluster(papers, large, F.col("year"), 2), newest, _first_of_cluster(papers, growing, F.desc("year"), 2)]
    rows = None
    for k, part in enumerate(parts):  # 18 rows at most from here on
        part = part.select(F.struct(F.lit(k).alias("part"), "pos", "rank").alias("_at"), "paper_id")
        rows = part if rows is None else rows.unionByName(part)
    once = rows.groupBy("paper_id").agg(F.min("_at").alias("_at")).orderBy("_at").limit(most)
    return once.select("paper_id", F.row_number().over(W.orderBy("_at")).cast("int").alias("position"))


def fill_coverage(selected: DataFrame, papers: DataFrame, gap_clusters: list[int], target: int, flex: int = 5) -> DataFrame:
    """``selected`` (paper_id, tier, rank) and unseen papers of the gaps' clusters by id while there are fewer than
    ``target + flex``, then cut to ``target``: position and paper."""
    chosen = selected.orderBy("tier", "rank").limit(target + flex)
    chosen = chosen.select("paper_id", F.row_number().over(W.orderBy("tier", "rank")).alias("position"))
    unseen = papers.where(F.col("cluster_id").isin(gap_clusters)).join(F.broadcast(chosen.select("paper_id")), "paper_id", "left_anti").orderBy("paper_id").limit(target + flex)
    more = unseen.select("paper_id", F.row_number().over(W.orderBy("paper_id")).alias("_r")).crossJoin(F.broadcast(chosen.agg(F.count("*").alias("_n"))))
    both = chosen.unionByName(more.select("paper_id", (F.col("_n") + F.col("_r")).cast("int").alias("position")))
    return both.where(F.col("position") <= target).select("paper_id", F.col("position").cast("int").alias("position"))


def keyword_bands(papers: DataFrame, keywords: list[str], most: int = 3) -> DataFrame:
    """Per cluster: share of papers with a keyword, its band, and the keywords that most papers were counted for."""
    found = F.coalesce(*[F.when(F.contains(F.lower("text"), F.lit(k)), F.lit(i)) for i, k in enumerate(keywords)])
    by = papers.groupBy("cluster_id", found.alias("_k")).agg(F.count("*").alias("_c"))
    lists = F.sort_array(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct((-F.col("_c")).alias("c"), "_k"))))
    g = by.groupBy("cluster_id").agg(F.sum("_c").alias("_n"), F.coalesce(F.sum(F.when(F.col("_k").isNotNull(), F.col("_c"))), F.lit(0)).alias("hits"), lists.alias("_l"))
    rate = F.col("hits") / F.col("_n")
    band = F.when(rate >= 0.6, "HIGH").when(rate >= 0.3, "MEDIUM").otherwise("LOW")
    name = F.array(*[F.lit(k) for k in keywords])
    top = F.array_join(F.transform(F.slice("_l", 1, most), lambda x: F.concat(F.element_at(name, x["_k"] + 1), F.lit(":"), (-x["c"]).cast("string"))), ",")
    return g.select("cluster_id", "hits", F.round(rate, 2).alias("rate"), band.alias("band"), top.alias("top"))


def first_hypotheses(hypotheses: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` by place, then by novelty."""
    few = hypotheses.orderBy("id").limit(most)
    return few.select("id", "novelty", F.row_number().over(W.orderBy(F.desc("novelty"), "id")).cast("int").alias("rank"))


def assembled(shortlist: DataFrame, domains: list[str]) -> DataFrame:
    """Ids of hypotheses by place and gap; an unknown impact domain becomes applied, a missing estimate 0.5."""
    place = F.row_number().over(W.orderBy(F.desc("score"), "id"))
    return shortlist.select("id", F.format_string("H%02d_%d", place, F.col("gap_id")).alias("hypothesis_id"), F.when(F.col("domain").isin(domains), F.col("domain")).otherwise("applied").alias("domain"), F.coalesce("estimate", F.lit(0.5)).alias("estimate"))


def progress(events: DataFrame) -> DataFrame:
    """Progress of stage events (stage, shift), between 0 and 100."""
    table = events.sparkSession.createDataFrame(PROGRESS, "stage string, pct double")
    return events.join(F.broadcast(table), "stage").select("stage", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("pct") + F.col("shift"))).alias("progress_pct"))
