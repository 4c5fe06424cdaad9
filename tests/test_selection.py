"""Tier 2 goes by cluster size, then paper_id."""

from taskloom.operators import corpus, scoring


def test_tier_2_takes_papers_of_larger_clusters_first(spark):
    rows = [(k, 5, 2022) for k in range(5)] + [(k, 7, 2022) for k in range(50, 59)] + [(k, 6, 2022) for k in range(100, 106)] + [(999, 7, 2024), (1000, -1, 2022)]
    papers = spark.createDataFrame(rows, "paper_id long, cluster_id int, year int")
    tiered = corpus.tiers(papers, [])
    sizes = {5: 5, 6: 6, 7: 10}
    tier = {r.paper_id: r.tier for r in tiered.collect()}
    second = sorted((p for p in rows if tier[p[0]] == 2), key=lambda p: (-sizes[p[1]], p[0]))
    want = [p[0] for p in second[:10]]
    assert len(second) > 10
    selected = corpus.select_by_budget(tiered, 40)
    assert [r.paper_id for r in selected.where("tier = 2").orderBy("rank").collect()] == want
    years = tiered.select("paper_id", "year", "cluster_id")
    assert {r.paper_id for r in corpus.reading_order(selected.join(years, "paper_id")).where("tier = 2").collect()} == set(want)
    weeks = scoring.weekly(selected, 8).where("tier = 2").orderBy("week").collect()
    assert [want.index(r.paper_id) for r in sorted(weeks, key=lambda r: (r.week, want.index(r.paper_id)))] == list(range(len(weeks)))
