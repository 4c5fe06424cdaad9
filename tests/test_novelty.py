"""Cross-domain overlap counts the dominant categories of a gap's clusters."""

from taskloom.operators import scoring


def test_overlap_counts_categories(spark):
    papers = spark.createDataFrame([(10 * k + i, "x", c, 2020 + i, k) for k, c in enumerate(["a", "b", "a", "c", "d"]) for i in range(4)], "paper_id long, text string, category string, year int, cluster_id int")
    gaps = spark.createDataFrame([(0, [0, 1]), (1, [0, 2]), (2, [0, 1, 3, 4]), (3, [3, 99]), (4, [1])], "gap_id int, clusters array<int>")
    got = {r.gap_id: r for r in scoring.novelty(gaps, papers, ["x"]).collect()}
    assert {k: r.overlap for k, r in got.items()} == {0: 0.8, 1: 0.6, 2: 1.0, 3: 0.6, 4: 0.2}
    for r in got.values():
        whole = 0.2 * r.sparsity + 0.2 * r.recency + 0.15 * r.repro_gap + 0.15 * r.distance + 0.15 * r.overlap + 0.15 * 0.5
        assert abs(r.novelty - min(1, max(0, whole))) <= 0.0001
