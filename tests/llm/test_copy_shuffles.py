"""What the near-copy stage moves: edges drawn anew between labels, and no texts but those that are counted out."""

import random

from taskloom.llm import scratch, simhash


def test_edges_of_a_large_group_are_few_after_the_first_round(spark, monkeypatch):
    rng = random.Random(6)
    pairs = [(a, b) for a in range(40) for b in range(a)] + [(k, k + 1) for k in range(100, 160)] + [(300, 200), (300, 201), (301, 201), (400, 400)]
    number = {n: rng.randrange(10**9) for p in pairs for n in p}
    given = [(number[a], number[b]) for a, b in pairs for _ in range(3)] + [(number[b], number[a]) for a, b in pairs]
    sizes, real = [], simhash.cut

    def cut(df, label):
        out = real(df, label)
        if label == "edges":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(simhash, "cut", cut)
    found = {r.node: r.comp for r in simhash.components(spark.createDataFrame(given, "a long, b long")).collect()}
    groups = [range(40), range(100, 161), (200, 201, 300, 301), (400,)]
    assert found == {number[n]: min(number[m] for m in g) for g in groups for n in g}
    # the same pair is one edge, and a group of 40 with all its pairs is one node when the round is over
    assert sizes[0] == len(pairs) and sum(sizes[1:]) < 60


def test_texts_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(300)]
        other = list(base)
        for i in range(20, 300, 40):
            other[i] = f"w{rng.randrange(3000)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    rows.append(rows[0])
    plans, real = {}, simhash.cut

    def cut(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, label)

    monkeypatch.setattr(simhash, "cut", cut)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        got = [r.doc_id for r in kept.select("doc_id").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange hashpartitioning" not in plan
    # only texts of doubtful pairs pass this join
    assert "BroadcastHashJoin" in plans["simhash-sets"]
    assert len(got) == len(set(got)) and {2 * k for k in range(60)} <= set(got)


def test_picked_by_mask(spark):
    ids = sorted({(p << 33) + k for p in range(3) for k in (0, 1, 62, 63, 64, 127, 128, 200)} | set(range(500, 700)))
    wanted = [x for k, x in enumerate(ids) if k % 3]
    rows = spark.createDataFrame([(x, f"text {x}") for x in ids], "_rid long, body string")
    got = scratch.picked(rows, spark.createDataFrame([(x,) for x in [*wanted, *wanted, 450]], "_rid long"))
    assert got.columns == ["_rid", "body"]
    assert sorted(r._rid for r in got.collect()) == wanted
    assert scratch.picked(rows, spark.createDataFrame([], "_rid long")).count() == 0
