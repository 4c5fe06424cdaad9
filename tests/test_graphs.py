"""Frontier graphs: waves and the one-task tail agree with a plain walk; long chains, dense layers, cycles, odd rows."""

import random

import pytest

from taskloom.operators import dag

DEFS = "name string, estimated_s double"
EDGES = "src string, dst string"


def plain(defs, edges):
    """Level, cost and best predecessor by visiting nodes whose dependencies are all done."""
    own = {}
    for n, s in defs:
        if n is not None:
            own[n] = max(own.get(n, -1e300), 1.0 if s is None else s)
    pairs = {(a, b) for a, b in edges if a in own and b in own}
    before = {n: [a for a, b in pairs if b == n] for n in own}
    out, left = {}, set(own)
    while ready := {n for n in left if all(a in out for a in before[n])}:
        new = {}
        for n in ready:
            if before[n]:
                cost, pred = min((-out[a][1], a) for a in before[n])
                new[n] = (max(out[a][0] for a in before[n]) + 1, own[n] - cost, pred)
            else:
                new[n] = (0, own[n], None)
        out.update(new)
        left -= ready
    return out


def relaxed(spark, defs, edges, tail):
    done = dag.relaxed(spark.createDataFrame(defs, DEFS), spark.createDataFrame(edges, EDGES), tail)
    return {r.name: (r.level, r.cost, r.pred) for r in done.collect()}


@pytest.mark.parametrize("tail", [4, 10_000])
def test_against_a_plain_walk(spark, tail):
    rng = random.Random(5)
    defs = [(f"n{i}", rng.choice([None, 1.0, 2.5, 0.5])) for i in range(14)] + [("n3", 9.0), (None, 1.0), ("alone", 4.0)]
    edges = [tuple(sorted((rng.randrange(14), rng.randrange(14)))) for _ in range(18)]
    edges = [(f"n{a}", f"n{b}") for a, b in edges if a != b] + [("n1", "nowhere"), ("nowhere", "n2"), (None, "n4"), ("n0", "n13"), ("n0", "n13")]
    assert relaxed(spark, defs, edges, tail) == plain(defs, edges)
    # a cycle and what lies behind it have no level
    loop = [*edges, ("n12", "n9"), ("n9", "n12")]
    assert relaxed(spark, defs, loop, tail) == plain(defs, loop)
    names = {n for n, _ in defs}
    left = {r.name for r in dag.cyclic_members(spark.createDataFrame(defs, DEFS), spark.createDataFrame(loop, EDGES), tail).collect()}
    assert left - {None} == names - {None} - set(plain(defs, loop))


def test_a_thousand_levels(spark):
    defs = [(f"n{i:04d}", 1.0) for i in range(1200)]
    edges = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(1199)]
    d, e = spark.createDataFrame(defs, DEFS), spark.createDataFrame(edges, EDGES)
    assert dag.summary(d, e).first().asDict() == {"nodes": 1200, "edges": 1199, "levels": 1200, "max_parallelism": 1}
    r = dag.critical_path(d, e).first()
    assert r.path == ">".join(n for n, _ in defs) and r.cost == 1200.0
    assert [x.position for x in dag.positions(d, e).orderBy("name").collect()] == list(range(1, 1201))


def test_dense_layers(spark):
    """Ten layers of twelve: 12 ** 10 paths, none of which is listed."""
    defs = [(f"{a:02d}-{b:02d}", float(b + 1)) for a in range(10) for b in range(12)]
    edges = [(f"{a:02d}-{b:02d}", f"{a + 1:02d}-{c:02d}") for a in range(9) for b in range(12) for c in range(12)]
    d, e = spark.createDataFrame(defs, DEFS), spark.createDataFrame(edges, EDGES)
    for tail in (1000, 10_000):
        r = dag.critical_path(d, e, tail).first()
        assert r.path == ">".join(f"{a:02d}-11" for a in range(10)) and r.cost == 120.0


def test_added_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], EDGES)
    make = lambda *rows: spark.createDataFrame(list(rows), EDGES)
    for more, fits in [([("c", "a")], False), ([("q", "q")], False), ([("a", "c")], True), ([("c", "x"), ("y", "a")], False), ([("c", "x")], True)]:
        got, ok = dag.add_edges(edges, make(*more))
        assert ok == fits and got.count() == 3 + (len(more) if ok else 0)


def test_empty(spark):
    d, e = spark.createDataFrame([], DEFS), spark.createDataFrame([], EDGES)
    assert dag.relaxed(d, e).collect() == [] and dag.critical_path(d, e).collect() == [] and dag.dependents(e).collect() == []


@pytest.mark.parametrize("tail, hold", [(3, 5), (10_000, 5), (10_000, 200_000)])
def test_groups_that_no_edge_crosses(spark, monkeypatch, tail, hold):
    monkeypatch.setattr(dag, "HOLD", hold)
    rng = random.Random(6)
    defs, edges = [], [("a1", "nowhere", "a"), (None, "a2", "a"), ("x", "y", None), ("y", "z", None), ("x", "z", None)]
    for g in "abcdefgh":
        defs += [(f"{g}{i}", rng.choice([None, 1.0, 2.5, 0.5]), g) for i in range(9)]
        edges += [(f"{g}{a}", f"{g}{b}", g) for a, b in (sorted((rng.randrange(9), rng.randrange(9))) for _ in range(9)) if a != b]
    defs += [("a3", 9.0, "a"), (None, 1.0, "b"), ("alone", 4.0, "i"), *((n, 1.0, None) for n in "xyz")]
    loop = [*edges, ("c8", "c2", "c"), ("c2", "c8", "c"), ("d1", "d1", "d")]
    d = spark.createDataFrame(defs, DEFS + ", grp string")
    for rows in (edges, loop):
        e = spark.createDataFrame(rows, EDGES + ", grp string")
        want = plain([x[:2] for x in defs], [x[:2] for x in rows])
        assert {r.name: (r.level, r.cost, r.pred) for r in dag.relaxed(d, e, tail, "grp").collect()} == want
        assert dag.critical_path(d, e, tail, "grp").collect() == dag.critical_path(d, e, tail).collect()
        assert sorted(dag.dependents(e, "grp", tail).collect()) == sorted(dag.dependents(e.where("src IS NOT NULL")).collect())
    e = spark.createDataFrame(edges, EDGES + ", grp string")
    for more, fits in [([("c8", "c2", "c"), ("c2", "c8", "c")], False), ([("d1", "d1", "d")], False), ([("a0", "a8", "a"), ("q", "r", "q")], True)]:
        got, ok = dag.add_edges(e, spark.createDataFrame(more, EDGES + ", grp string"), "grp", tail)
        assert ok == fits and got.distinct().count() == len({*edges, *(more if ok else ())})
