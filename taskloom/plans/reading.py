"""Queries of reading lists, gaps, hypotheses and scalar functions beyond the catalogue's first ones, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as fx
from ..operators import corpus, reading, scoring
from ..sources import adapters as src
from .catalogue import _dom, _gp, _hy, _sel, _trend, P, T, WORDS, query, with_

_cl = "cl(cluster_id, label) AS (SELECT DISTINCT cluster_id::INT, 'label ' || (cluster_id % 8) FROM papers WHERE cluster_id BETWEEN 0 AND 8)"
CL = lambda s, d: P(s, d).where("cluster_id BETWEEN 0 AND 8").select("cluster_id").distinct().withColumn("label", F.concat(F.lit("label "), (F.col("cluster_id") % 8).cast("string")))
SEL = lambda s, d: corpus.select_by_budget(T(s, d), 40)

query("C3_cluster_label", with_("SELECT paper_id, coalesce(label, 'Unclustered') AS label FROM papers p LEFT JOIN cl ON cl.cluster_id = p.cluster_id", "papers", more=_cl))(lambda s, d: reading.with_cluster(P(s, d), CL(s, d)).select("paper_id", "label"))
query("C4_annotations", """SELECT d.doc_id AS paper_id, substr(d.lang || ' ' || d.source, 1, 80) AS one_line_summary, 'Core paper in the research area.' AS why_read, 'See abstract.' AS key_takeaway, 'Focus on methodology.' AS reading_note,
 coalesce(20 + l.quality, 45)::INT AS estimated_mins, coalesce(CASE WHEN l.toxic = 1 THEN 'hard' END, 'medium') AS difficulty, 'high' AS priority FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id""")(
    lambda s, d: reading.annotate(src.table(s, d, "documents").select(F.col("doc_id").alias("paper_id"), F.concat_ws(" ", "lang", "source").alias("title")),
                                  src.table(s, d, "labels").groupBy(F.col("doc_id").alias("paper_id")).agg((F.max("quality") + 20).alias("estimated_mins"), F.max("toxic").alias("t")).select("paper_id", "estimated_mins", F.when(F.col("t") == 1, "hard").alias("difficulty"))).withColumn("estimated_mins", F.col("estimated_mins").cast("int")))
HY = [("H01_0", [0, 5, 1, 999999]), ("H02_1", [7, 7, 3]), ("H03_2", [])]
query("C6_hypothesis_links", with_("SELECT h AS hypothesis_id, coalesce((SELECT string_agg(p, ',' ORDER BY i) FROM (SELECT unnest(r) AS p, generate_subscripts(r, 1) AS i) WHERE p IN (SELECT paper_id FROM se)), '') AS papers FROM (VALUES ('H01_0', [0, 5, 1, 999999]::BIGINT[]), ('H02_1', [7, 7, 3]), ('H03_2', [])) v(h, r)", "papers", more=_sel))(
    lambda s, d: reading.hypothesis_links(s.createDataFrame(HY, "hypothesis_id string, related array<bigint>"), SEL(s, d)))
_ord = _sel + ", od AS (SELECT paper_id, cluster_id, row_number() OVER (ORDER BY tier, CASE WHEN tier = 1 THEN year WHEN tier = 4 THEN -year ELSE 0 END, paper_id) AS reading_order FROM se)"


def _ordered(s, d):
    x = SEL(s, d).join(T(s, d).select("paper_id", "year", "cluster_id"), "paper_id")
    return corpus.reading_order(x).join(x.select("paper_id", "cluster_id"), "paper_id")


query("C8_gap_coverage", with_("""SELECT gap_id, rank::INT AS rank, paper_id FROM (SELECT gap_id, paper_id, row_number() OVER (PARTITION BY gap_id ORDER BY pos, reading_order) AS rank FROM od JOIN (SELECT c.cluster_id, o.owner FROM cl c JOIN (SELECT label, min(cluster_id) AS owner FROM cl GROUP BY 1) o ON o.label = c.label) m ON m.cluster_id = od.cluster_id JOIN gc ON gc.cluster_id = m.owner) WHERE rank <= 6""", "papers", more=_ord + ", " + _gp + ", " + _cl))(
    lambda s, d: reading.gap_coverage(scoring.gaps(s), CL(s, d), _ordered(s, d)))
query("C12_zip", "SELECT l.i AS pos, a, b FROM (VALUES (0, 'x'), (1, 'y'), (2, 'z')) l(i, a) JOIN (VALUES (0, 1), (1, 2)) r(i, b) ON l.i = r.i")(lambda s, d: reading.zipped(s.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "pos int, a string"), s.createDataFrame([(0, 1), (1, 2)], "pos int, b int")))
query("C13_stage_peaks", with_("SELECT t.stage_group AS stage, t.total_s AS duration_s, coalesce(printf('%.1f%%', p.c), '-') AS cpu_peak, coalesce(printf('%.1f%%', p.r), '-') AS ram_peak FROM (SELECT stage_group, round(sum(estimated_s), 3)::DOUBLE AS total_s FROM task_defs GROUP BY 1) t LEFT JOIN (SELECT (['retrieval','embedding','report'])[1 + seq % 3] AS stage, floor(max(cpu_pct)) AS c, max(ram_pct) AS r FROM telemetry GROUP BY 1) p ON p.stage = t.stage_group", "task_defs", "telemetry"))(
    lambda s, d: reading.stage_peaks(src.task_defs(s).groupBy(F.col("stage_group").alias("stage")).agg(F.round(F.sum("estimated_s"), 3).alias("duration_s")),
                                     src.telemetry(s, d).groupBy(F.element_at(F.array(F.lit("retrieval"), F.lit("embedding"), F.lit("report")), (F.col("seq") % 3 + 1).cast("int")).alias("stage")).agg(F.floor(F.max("cpu_pct")).cast("double").alias("cpu_peak"), F.max("ram_pct").alias("ram_peak"))))
query("C14_week_milestones", with_("SELECT w::INT AS week, max(tier) AS tier FROM (SELECT tier, unnest(range(ws, least(8, we) + 1)) AS w FROM (SELECT tier, (row_number() OVER (ORDER BY tier) - 1) * greatest(1, 8 // count(*) OVER ()) + 1 AS ws, row_number() OVER (ORDER BY tier) * greatest(1, 8 // count(*) OVER ()) AS we FROM (SELECT DISTINCT tier FROM se))) GROUP BY 1", "papers", more=_sel))(lambda s, d: reading.week_milestones(scoring.milestones(SEL(s, d), 8)))
_k = "CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN {i}" for i, w in enumerate(WORDS)) + " END"
_names = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
query("D9_keyword_bands", with_(f"SELECT cluster_id, hits, round(hits / n, 2)::DOUBLE AS rate, CASE WHEN hits / n >= 0.6 THEN 'HIGH' WHEN hits / n >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS band, coalesce(top, '') AS top FROM (SELECT cluster_id, count(*) AS n, count({_k}) AS hits FROM papers GROUP BY 1) LEFT JOIN (SELECT cluster_id, string_agg(({_names})[k + 1] || ':' || c, ',' ORDER BY c DESC, k) AS top FROM (SELECT cluster_id, {_k} AS k, count(*) AS c FROM papers GROUP BY 1, 2) WHERE k IS NOT NULL GROUP BY 1) USING (cluster_id)", "papers"))(lambda s, d: reading.keyword_bands(P(s, d), WORDS))
query("F6_G2_M16_reading_list", with_("""SELECT paper_id, row_number() OVER (ORDER BY part, pos, rank)::INT AS position FROM (SELECT paper_id, part, pos, rank FROM (
 SELECT paper_id, 0 AS part, pos, row_number() OVER (PARTITION BY p.cluster_id ORDER BY year, paper_id) AS rank FROM papers p JOIN (SELECT cluster_id, row_number() OVER (ORDER BY count(*) DESC, cluster_id) AS pos FROM papers WHERE cluster_id >= 0 GROUP BY 1 QUALIFY pos <= 3) USING (cluster_id) QUALIFY rank <= 2
 UNION ALL SELECT paper_id, 1, 1, row_number() OVER (ORDER BY year DESC, paper_id) AS rank FROM papers WHERE cluster_id IN (0, 1, 2, 3) QUALIFY rank <= 8
 UNION ALL SELECT paper_id, 2, pos, row_number() OVER (PARTITION BY p.cluster_id ORDER BY year DESC, paper_id) AS rank FROM papers p JOIN (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) AS pos FROM tr WHERE cluster_id >= 0 AND trend = 'growing' QUALIFY pos <= 2) USING (cluster_id) QUALIFY rank <= 2) QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY part, pos, rank) = 1) QUALIFY position <= 20""", "papers", more=_trend))(lambda s, d: reading.reading_list(P(s, d), [0, 1, 2, 3]))
query("G6_coverage_fill", with_("SELECT paper_id, row_number() OVER (ORDER BY part, tier, r, paper_id)::INT AS position FROM (SELECT paper_id, 0 AS part, tier, r FROM se UNION ALL SELECT paper_id, 1, 0, 0 FROM papers WHERE cluster_id IN (0, 2) AND paper_id NOT IN (SELECT paper_id FROM se)) QUALIFY position <= 45", "papers", more=_sel))(lambda s, d: reading.fill_coverage(SEL(s, d), P(s, d), [0, 2], 45))
query("G7_gap_categories", with_("SELECT gap_id, count(DISTINCT category) AS n_categories FROM gc LEFT JOIN dom USING (cluster_id) GROUP BY 1", "papers", more=_gp + ", " + _dom))(lambda s, d: scoring.gap_categories(scoring.gaps(s), P(s, d)))
query("F7_first_hypotheses", with_("SELECT id, novelty, row_number() OVER (ORDER BY novelty DESC, id)::INT AS rank FROM (SELECT * FROM h ORDER BY id LIMIT 5)", more=_hy))(lambda s, d: reading.first_hypotheses(scoring.hypotheses(src.table(s, d, "part"))))
query("F8_first_gaps", "SELECT region.r_regionkey AS gap_id FROM region ORDER BY 1 LIMIT 6")(lambda s, d: src.table(s, d, "region").select(F.col("r_regionkey").alias("gap_id")).orderBy("gap_id").limit(6))
_dm = "(['theory','applied','odd','social'])[1 + id % 4]"
query("M10_M6_assembled", with_(f"SELECT id, printf('H%02d_%d', row_number() OVER (ORDER BY score DESC, id), gap_id) AS hypothesis_id, CASE WHEN {_dm} IN ('theory','social') THEN {_dm} ELSE 'applied' END AS domain, CASE WHEN id % 3 = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS estimate FROM (SELECT * FROM (SELECT * FROM hc QUALIFY row_number() OVER (PARTITION BY gap_id ORDER BY score DESC, id) <= 2) ORDER BY score DESC, id LIMIT 10)", more=_hy))(
    lambda s, d: reading.assembled(scoring.shortlist(scoring.composite(scoring.hypotheses(src.table(s, d, "part"))), 10).withColumns({"domain": F.element_at(F.array(*[F.lit(x) for x in ("theory", "applied", "odd", "social")]), (F.col("id") % 4 + 1).cast("int")), "estimate": F.when(F.col("id") % 3 == 0, 0.25)}), ["theory", "social", "applied"]))
query("M17_progress", "SELECT p.stage, greatest(0.0, least(100.0, p.pct + v.s))::DOUBLE AS progress_pct FROM (VALUES " + ", ".join(f"('{a}', {b})" for a, b in reading.PROGRESS) + ") p(stage, pct) JOIN (VALUES ('clustering', 5.5), ('report_generation', 3.0), ('query_reformulation', -20.0)) v(stage, s) ON v.stage = p.stage")(lambda s, d: reading.progress(s.createDataFrame([("clustering", 5.5), ("report_generation", 3.0), ("query_reformulation", -20.0)], "stage string, shift double")))
query("N4_summary", with_("SELECT tier, count(*) AS n, string_agg(paper_id::VARCHAR, ',' ORDER BY r) AS papers FROM se GROUP BY 1", "papers", more=_sel))(lambda s, d: SEL(s, d).groupBy("tier").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "paper_id"))), lambda x: x["paper_id"].cast("string")), ",").alias("papers")))

# --- scalar functions ------------------------------------------------------------------------
query("H2_last_of_split", "SELECT page_id, (string_split(url, '/'))[-1] AS tail, regexp_replace(html[1:60], '\\s+', ' ', 'g') AS head FROM pages")(lambda s, d: src.table(s, d, "pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("tail"), F.regexp_replace(F.substring("html", 1, 60), r"\s+", " ").alias("head")))
query("H5_H6_formats", with_("SELECT name, array_to_string(list_transform(string_split(name, '_'), lambda x: upper(x[1]) || x[2:]), ' ') AS title, printf('%.1f s', estimated_s) AS shown FROM task_defs", "task_defs"))(lambda s, d: src.task_defs(s).select("name", fx.title(F.col("name")).alias("title"), F.format_string("%.1f s", "estimated_s").alias("shown")))
query("H10_dates", with_("SELECT task_id, strftime(queued_at, '%Y-%m-%d') AS day, year(queued_at)::INT AS y FROM tasks", "tasks"))(lambda s, d: src.tasks(s, d).select("task_id", F.date_format("queued_at", "yyyy-MM-dd").alias("day"), F.year("queued_at").alias("y")))
query("H12_half_even", "SELECT p_partkey AS id, round_even(p_partkey / 8.0, 2)::DOUBLE AS r FROM part")(lambda s, d: src.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.bround(F.col("p_partkey") / 8.0, 2).alias("r")))
query("H17_years", with_("SELECT cluster_id, unnest(range(lo, hi + 1))::INT AS year FROM (SELECT cluster_id, min(year) AS lo, max(year) AS hi FROM papers GROUP BY 1)", "papers"))(lambda s, d: P(s, d).groupBy("cluster_id").agg(F.min("year").alias("lo"), F.max("year").alias("hi")).select("cluster_id", F.explode(F.sequence("lo", "hi")).alias("year")))
query("H18_map_items", "SELECT user_id, string_agg(event_type || ':' || c, ',' ORDER BY c DESC, event_type) AS items FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1")(
    lambda s, d: fx.items_by_value(src.table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "c"))).alias("m")), "m").select("user_id", "items"))
query("H19_A5_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS line FROM events")(lambda s, d: src.table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("line")))
query("H4_fences", "SELECT i AS id, CASE i WHEN 0 THEN '[1]' WHEN 1 THEN '{\"a\": 2}' ELSE 'plain' END AS content FROM range(3) t(i)")(lambda s, d: s.createDataFrame([(0, "```json\n[1]\n```"), (1, "```\n{\"a\": 2}\n```"), (2, " plain ")], "id bigint, raw string").select("id", fx.unfenced(F.col("raw")).alias("content")))
