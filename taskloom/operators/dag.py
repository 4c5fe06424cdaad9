"""Dependency graphs of any size over tables: ``defs`` (name, estimated_s) and ``edges`` (src, dst: dst depends on src).

Graphs are worked off by frontiers.  A wave takes the nodes whose dependencies are all done, hands what they carry along
their edges, and counts down what the others wait for; each wave is a stored table, so lineage stays short and a lost
executor loses nothing.  Once the edges that are left are few (``TAIL``, counted), one task finishes them: long thin tails
cost no wave each, and the result is the same.  Paths are never listed; a node keeps its best predecessor only.

Where the tables have a column that no edge crosses (``within``: the same value at both ends of each edge), rows are dealt by
it once, and tasks work off many small groups at a time, wave by wave in numpy.  Groups of over ``tail`` edges (for pairs:
``WIDE``) go the way above.

Defined results: edges with an end outside ``defs`` and repeated edges are ignored; nodes on a cycle or behind one have no
level; a missing time counts as 1; ties of cost go to the predecessor of least name; null names are no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .segments import Segments

#: Edges that one task finishes.
TAIL = 200_000
#: Rows of small groups that are worked off together, edges of a group whose pairs one task lists, and pairs held at once.
HOLD, WIDE, PAIRS = 200_000, 2_000, 4_000_000


def inside(defs: DataFrame, edges: DataFrame) -> DataFrame:
    """Different edges between nodes of ``defs``."""
    names = defs.select("name").distinct()
    one = edges.select("src", "dst").distinct().join(names.withColumnRenamed("name", "src"), "src", "left_semi")
    return one.join(names.withColumnRenamed("name", "dst"), "dst", "left_semi").select("src", "dst")


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rest of a graph in one task: rows of waiting and frontier nodes (dst null) and of their edges."""
    rows = pd.concat(list(batches), ignore_index=True)
    nodes = {r.name_: r for r in rows[rows.dst.isna()].itertuples(index=False)}
    after: dict[str, list[str]] = {}
    for s, d in rows.loc[rows.dst.notna(), ["name_", "dst"]].itertuples(index=False):
        after.setdefault(s, []).append(d)
    open_ = {n: int(r.open) for n, r in nodes.items() if pd.isna(r.level)}
    best = {n: (r.less, r.pred) for n, r in nodes.items() if pd.isna(r.level) and r.less == r.less and r.less is not None}
    own = {n: r.own for n, r in nodes.items()}
    now = {n: r.cost for n, r in nodes.items() if not pd.isna(r.level)}
    level = max((int(r.level) for r in nodes.values() if not pd.isna(r.level)), default=-1)
    out = []
    while now:
        level += 1
        for s, cost in now.items():
            for d in after.get(s, ()):
                open_[d] -= 1
                if d not in best or (-cost, s) < best[d]:
                    best[d] = (-cost, s)
        ready = sorted({d for s in now for d in after.get(s, ()) if open_[d] == 0})
        now = {d: own[d] - best[d][0] for d in ready}
        out += [(d, level, now[d], best[d][1]) for d in ready]
    yield pd.DataFrame(out, columns=["name", "level", "cost", "pred"]).astype({"level": "int32"})


def _batches(batches: Iterator[pa.RecordBatch], weight) -> Iterator[pa.Table]:
    """Rows sorted by ``_g``, some whole groups at a time; ``weight`` of a group's rows says how many it counts for."""
    kept: list[pa.RecordBatch] = []
    held = 0
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column("_g").to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]])
        if kept and kept[-1].column("_g")[-1].as_py() != g[0] and held >= HOLD:
            yield pa.Table.from_batches(kept)
            kept, held = [], 0
        at = 0
        for k in range(1, len(cuts)):
            held += weight(int(cuts[k] - cuts[k - 1]))
            if held >= HOLD and k < len(cuts) - 1:
                yield pa.Table.from_batches([*kept, b.slice(at, cuts[k] - at)])
                kept, held, at = [], 0, cuts[k]
        kept.append(b.slice(at))
    if kept:
        yield pa.Table.from_batches(kept)


def _coded(*columns: pa.ChunkedArray) -> tuple[list[np.ndarray], pa.Array]:
    """Strings as their places in the sorted list of all of them (nulls: -1), and that list."""
    names = pa.chunked_array([c for x in columns for c in x.chunks], type=columns[0].type).combine_chunks().dictionary_encode()
    order = pc.sort_indices(names.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    at = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False)
    codes = np.where(at >= 0, rank[at] if len(rank) else -1, -1)
    ends = np.cumsum([len(x) for x in columns])
    return np.split(codes, ends[:-1]), names.dictionary.take(pa.array(order))


def _out(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different edges by source: sources and targets in order, and where each source's begin."""
    src, dst = np.divmod(np.unique(src * n + dst), n) if n else (src, dst)
    return src, dst, np.searchsorted(src, np.arange(n + 1))


def _steps(first: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all edges that leave ``nodes``, and which of these each leaves."""
    size = first[nodes + 1] - first[nodes]
    of = np.repeat(np.arange(len(nodes)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[nodes][of], of


def _waves(batches: Iterator[pa.RecordBatch], implied: bool = False) -> Iterator[pa.RecordBatch]:
    """Level, cost and predecessor of the nodes (rows without ``dst``) of small groups; nodes that no order reaches have no level.

    ``implied``: the ends of all edges are nodes."""
    for rows in _batches(batches, lambda n: n):
        (name, dst), names = _coded(rows.column("name"), rows.column("dst"))
        n, edge = len(names), rows.column("edge").to_numpy()
        group = np.zeros(n, dtype=np.int64)
        group[name[name >= 0]] = rows.column("_g").to_numpy()[name >= 0]
        own = np.full(n, -np.inf)
        given = rows.column("own").to_numpy()
        node = ~edge & (name >= 0)
        both = edge & (name >= 0) & (dst >= 0)
        timed = node & ~pc.is_null(rows.column("own")).to_numpy()
        np.maximum.at(own, name[timed], given[timed])
        there = np.zeros(n, dtype=bool)
        there[name[node]] = True
        if implied:
            there[name[both]] = there[dst[both]] = True
        untimed = there.copy()
        untimed[name[timed]] = False
        own[untimed] = 1.0
        both[both] = there[name[both]] & there[dst[both]]
        src, to, first = _out(name[both], dst[both], n)
        open_ = np.bincount(to, minlength=n)
        level, less, pred = np.full(n, -1), np.full(n, np.inf), np.full(n, -1)
        front, wave = np.flatnonzero(there & (open_ == 0)), 0
        level[front], less[front] = 0, 0.0
        cost = np.where(level == 0, own, 0.0)
        while len(front):
            wave += 1
            at, of = _steps(first, front)
            s, d = front[of], to[at]
            order = np.lexsort((s, -cost[s], d))
            s, d = s[order], d[order]
            head = np.flatnonzero(np.diff(d, prepend=-1))
            count, s, d = np.diff(head, append=len(d)), s[head], d[head]
            better = (pred[d] < 0) | (-cost[s] < less[d]) | ((-cost[s] == less[d]) & (s < pred[d]))
            less[d[better]], pred[d[better]] = -cost[s[better]], s[better]
            open_[d] -= count
            front = d[open_[d] == 0]
            level[front], cost[front] = wave, own[front] - less[front]
        keep = np.flatnonzero(there)
        reached = level[keep] >= 0
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(keep)), pa.array(level[keep].astype(np.int32), mask=~reached), pa.array(cost[keep], mask=~reached), names.take(pa.array(pred[keep], mask=~(reached & (pred[keep] >= 0)))), pa.array(group[keep])],
            names=["name", "level", "cost", "pred", "_g"],
        )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All that follow each node of small groups along edges."""
    for rows in _batches(batches, lambda n: 1 + n * n * HOLD // PAIRS):
        (name, dst), names = _coded(rows.column("name"), rows.column("dst"))
        n, real = len(names), (name >= 0) & (dst >= 0)
        # a cell for each pair of nodes of one group
        group = np.zeros(n, dtype=np.int64)
        of_row = np.cumsum(np.diff(rows.column("_g").to_numpy(), prepend=0) != 0)
        for ends in (name, dst):
            group[ends[ends >= 0]] = of_row[ends >= 0]
        size = np.bincount(group, minlength=1)
        order, local = np.argsort(group, kind="stable"), np.empty(n, dtype=np.int64)
        local[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        base = np.cumsum(size**2) - size**2
        seen, last = np.zeros(int((size**2).sum()), dtype=bool), np.zeros(int((size**2).sum()), dtype=np.int32)
        root, node, first = _out(name[real], dst[real], n)
        to = node
        while len(root):
            cell = base[group[root]] + local[root] * size[group[root]] + local[node]
            last[cell] = np.arange(len(cell))
            new = ~seen[cell] & (last[cell] == np.arange(len(cell)))
            seen[cell] = True
            root, node = root[new], node[new]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(root)), names.take(pa.array(node))], names=["root", "node"])
            at, of = _steps(first, node)
            root, node = root[of], to[at]


def _parted(tables: list[DataFrame], within: str, most: int) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """``tables`` (the last one holds edges) with ``_g``, a hash of their group: those of groups of ``most`` edges or fewer, and the others if there are any.

    Groups of equal hash count as one, which changes no result."""
    tables = [t.withColumn("_g", F.xxhash64(F.col(within))) for t in tables]
    large = cut(tables[-1].groupBy("_g").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("_g"), "graph-large")
    if not large.limit(1).count():
        return tables, None
    return [t.join(large, "_g", "left_anti") for t in tables], [t.join(large, "_g", "left_semi") for t in tables]


def _by_groups(defs: DataFrame | None, edges: DataFrame, within: str, tail: int) -> DataFrame:
    """What ``relaxed`` gives, and ``_g``; nodes that no order reaches have no level.  Without ``defs`` all ends of edges are nodes."""
    none = F.lit(None)
    implied = defs is None
    if implied:
        defs = edges.select(F.col("src").alias("name"), none.cast("double").alias("estimated_s"), within).limit(0)
    small, large = _parted([defs.select("name", F.col("estimated_s").cast("double").alias("own"), within), edges.select("src", "dst", within)], within, tail)
    nodes = small[0].select("_g", "name", none.cast("string").alias("dst"), "own", F.lit(False).alias("edge"))
    rows = nodes.unionByName(small[1].select("_g", F.col("src").alias("name"), "dst", none.cast("double").alias("own"), F.lit(True).alias("edge")))
    done = rows.repartition("_g").sortWithinPartitions("_g").mapInArrow(lambda b: _waves(b, implied), "name string, level int, cost double, pred string, _g long")
    if large:
        if implied:
            large[0] = large[1].select(F.explode(F.array("src", "dst")).alias("name"), none.cast("double").alias("own"), "_g")
        named = large[0].where("name IS NOT NULL").groupBy("name").agg(F.first("_g").alias("_g"))
        done = done.unionByName(named.join(relaxed(large[0].withColumnRenamed("own", "estimated_s"), large[1], tail), "name", "left").select("name", "level", "cost", "pred", "_g"))
    return done


def relaxed(defs: DataFrame, edges: DataFrame, tail: int = TAIL, within: str | None = None) -> DataFrame:
    """(name, level, cost, pred) of every node that an order reaches: longest distance from a root, most time of any path that ends there, and the node before on that path.

    With ``within`` also ``_g``, a hash of the node's group."""
    if within:
        return cut(_by_groups(defs, edges, within, tail).where("level IS NOT NULL"), "graph-done")
    names = defs.where("name IS NOT NULL").groupBy("name").agg(F.coalesce(F.max("estimated_s"), F.lit(1.0)).cast("double").alias("own"))
    live = cut(inside(defs, edges), "graph-edges")
    waits = live.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("open"))
    none = F.lit(None)
    state = names.join(waits, "name", "left").select("name", "own", F.coalesce("open", F.lit(0)).alias("open"), none.cast("struct<less:double,pred:string>").alias("best"))
    root = F.col("open") == 0
    state = cut(state.select("*", F.when(root, 0).alias("level"), F.when(root, F.col("own")).alias("cost"), none.cast("string").alias("pred")), "graph-state")
    done, wave, stored = [state.where("level = 0").select("name", "level", "cost", "pred")], 0, live.count()
    while True:
        front, waiting = state.where(F.col("level") == wave), state.where("level IS NULL")
        if not front.limit(1).count() or not waiting.limit(1).count():
            break
        # edges of nodes done in earlier waves are behind
        left = live.join(state.select(F.col("name").alias("src")), "src", "left_semi")
        n = left.count()
        if n <= tail:
            rows = state.where((F.col("level") == wave) | F.col("level").isNull()).select(F.col("name").alias("name_"), none.cast("string").alias("dst"), "own", "open", "best.less", "best.pred", F.col("level").cast("double").alias("level"), "cost")
            rows = rows.unionByName(left.select(F.col("src").alias("name_"), "dst"), allowMissingColumns=True)
            done.append(rows.coalesce(1).mapInPandas(_finish, "name string, level int, cost double, pred string"))
            break
        if 2 * n < stored:
            live, stored = cut(left, "graph-edges"), n
        wave += 1
        sent = live.join(front.select(F.col("name").alias("src"), "cost"), "src")
        got = sent.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("_met"), F.min(F.struct((-F.col("cost")).alias("less"), F.col("src").alias("pred"))).alias("_best"))
        step = waiting.join(got, "name", "left").withColumns({"open": F.col("open") - F.coalesce("_met", F.lit(0)), "best": F.least("best", "_best")})
        ready = F.col("open") == 0
        state = cut(step.select("name", "own", "open", "best", F.when(ready, wave).alias("level"), F.when(ready, F.col("own") - F.col("best.less")).alias("cost"), F.when(ready, F.col("best.pred")).alias("pred")), "graph-state")
        done.append(state.where(F.col("level") == wave).select("name", "level", "cost", "pred"))
    return cut(reduce(DataFrame.unionByName, done), "graph-done")


def levels(defs: DataFrame, edges: DataFrame, tail: int = TAIL, within: str | None = None) -> DataFrame:
    """Longest distance of each node from a root."""
    return relaxed(defs, edges, tail, within).select("name", "level")


def path_costs(defs: DataFrame, edges: DataFrame, tail: int = TAIL, within: str | None = None) -> DataFrame:
    """The most estimated seconds of any path that ends in each node."""
    return relaxed(defs, edges, tail, within).select("name", F.round("cost", 2).alias("cost"))


def positions(defs: DataFrame, edges: DataFrame, tail: int = TAIL, within: str | None = None) -> DataFrame:
    """(name, position, estimated_s): an order to run all nodes in, by level and name, numbered from 1 without one task for all."""
    lead = F.conv(F.rpad(F.hex(F.substring("name", 1, 4).cast("binary")), 8, "0"), 16, 10).cast("long")
    rows = levels(defs, edges, tail, within).select("name", "level", (F.col("level").cast("long") * (1 << 32) + lead).alias("_k"), F.lit(1).alias("_all"))
    place = Segments(rows, ["_all"], ["_k", "name"]).running({"position": ("count", F.lit(1))}).done()
    return place.join(defs.select("name", "estimated_s"), "name").select("name", F.col("position").cast("int").alias("position"), "estimated_s")


def critical_path(defs: DataFrame, edges: DataFrame, tail: int = TAIL, within: str | None = None) -> DataFrame:
    """The path of most time, as one row: names joined by ``>`` and its cost.  Ties go to the end of least name.

    It is read backwards from its end by pointers of 1, 2, 4, ... steps."""
    done = relaxed(defs, edges, tail, within)
    end = cut(done.orderBy(F.desc("cost"), "name").limit(1), "graph-end")
    if within:  # the path lies in its end's group
        done = cut(done.join(F.broadcast(end.select("_g")), "_g", "left_semi"), "graph-group")
    end = end.select("name")
    jump, seen, n = cut(done.select("name", "pred").where("pred IS NOT NULL"), "graph-jumps"), end, -1
    while n != (n := seen.count()):
        more = seen.join(jump, "name").select(F.col("pred").alias("name"))
        seen = cut(seen.unionByName(more).distinct(), "graph-path")
        jump = cut(jump.join(jump.select(F.col("name").alias("pred"), F.col("pred").alias("_p")), "pred").select("name", F.col("_p").alias("pred")), "graph-jumps")
    path = done.join(seen, "name", "left_semi")
    return path.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "name"))), lambda x: x["name"]), ">").alias("path"), F.round(F.max("cost"), 2).alias("cost")).where("path <> ''")


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(label, node): all that follow the nodes of ``start`` (label, node) along edges, ``start`` itself only if it lies on a cycle.

    A wave joins the edges of new nodes only; no pair between other nodes is made."""
    edges = cut(edges.select("src", "dst").distinct(), "graph-edges")
    front, parts = cut(start.select("label", "node").distinct(), "graph-front"), []
    seen = None
    while True:
        step = front.join(edges, front["node"] == edges["src"]).select("label", F.col("dst").alias("node")).distinct()
        if seen is not None:
            step = step.join(seen, ["label", "node"], "left_anti")
        front = cut(step, "graph-front")
        if not front.limit(1).count():
            break
        parts.append(front)
        # a few large tables instead of one a wave
        seen = front if seen is None else seen.unionByName(front)
        if len(parts) % 8 == 0:
            seen = cut(seen, "graph-seen")
    return seen if seen is not None else front


def dependents(edges: DataFrame, within: str | None = None, wide: int = WIDE) -> DataFrame:
    """(root, node): all that transitively depend on root.

    Paths double in length each round until no pair is new, so cycles end too; pairs are kept, never paths.  With ``within``, edges
    of a null end give none."""
    if within:
        (small,), large = _parted([edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", within)], within, wide)
        found = small.select("_g", F.col("src").alias("name"), "dst").repartition("_g").sortWithinPartitions("_g").mapInArrow(_pairs, "root string, node string")
        return found.unionByName(dependents(large[0])) if large else found
    reach = cut(edges.select(F.col("src").alias("root"), F.col("dst").alias("node")).distinct(), "graph-pairs")
    n = -1
    while n != (n := reach.count()):
        far = reach.select("root", F.col("node").alias("_m")).join(reach.select(F.col("root").alias("_m"), "node"), "_m").select("root", "node")
        reach = cut(reach.unionByName(far).distinct(), "graph-pairs")
    return reach


def direct(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, name): what depends on each of ``roots`` (name) directly."""
    return edges.join(roots.select(F.col("name").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("root"), F.col("dst").alias("name"))


def ready(defs: DataFrame, edges: DataFrame, done: DataFrame) -> DataFrame:
    """Nodes not in ``done`` (name) whose dependencies all are."""
    unmet = edges.join(done.select(F.col("name").alias("src")), "src", "left_anti").select(F.col("dst").alias("name"))
    return defs.select("name").join(done.select("name"), "name", "left_anti").join(unmet, "name", "left_anti")


def summary(defs: DataFrame, edges: DataFrame, tail: int = TAIL, within: str | None = None) -> DataFrame:
    """One row: nodes, edges, levels and the most nodes of one level."""
    width = levels(defs, edges, tail, within).groupBy("level").agg(F.count("*").alias("c")).agg(F.count("*").alias("levels"), F.max("c").alias("max_parallelism"))
    counts = edges.agg(F.count("*").alias("edges"))
    return defs.agg(F.count("*").alias("nodes")).crossJoin(counts).crossJoin(width)  # one row each


def isolated(defs: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name")))
    return defs.select("name").join(ends, "name", "left_anti")


def cyclic_members(defs: DataFrame, edges: DataFrame, tail: int = TAIL, within: str | None = None) -> DataFrame:
    """Nodes that no order reaches: those on a cycle, and what depends on them."""
    return defs.select("name").join(levels(defs, edges, tail, within), "name", "left_anti")


def add_edges(edges: DataFrame, more: DataFrame, within: str | None = None, tail: int = TAIL) -> tuple[DataFrame, bool]:
    """``edges`` (without a cycle) with ``more``, and True; if that makes a cycle, ``edges`` as they were, and False.

    Only what the new edges lead to is walked: a cycle must pass one of them and come back to its source."""
    if within:  # all nodes of the groups get a level, or there is a cycle
        columns = ["src", "dst", within]
        both = edges.select(*columns).unionByName(more.select(*columns))
        back = _by_groups(None, both, within, tail).where("level IS NULL").limit(1).count()
        return (edges.select(*columns), False) if back else (both.distinct(), True)
    both = edges.select("src", "dst").unionByName(more.select("src", "dst")).distinct()
    start = more.select(F.col("src").alias("label"), F.col("dst").alias("node"))
    back = reached(both, start).unionByName(start).where("label = node").limit(1).count()
    return (edges.select("src", "dst"), False) if back else (both, True)


def validate(defs: DataFrame, edges: DataFrame, most_levels: int = 10, tail: int = TAIL, within: str | None = None) -> DataFrame:
    """Warnings: isolated nodes, and more than ``most_levels`` levels."""
    alone = isolated(defs, edges).select(F.concat(F.lit("isolated: "), F.col("name")).alias("warning"))
    deep = levels(defs, edges, tail, within).agg((F.max("level") + 1).alias("_n")).where(F.col("_n") > most_levels).select(F.concat(F.lit("levels: "), F.col("_n").cast("string")).alias("warning"))
    return alone.unionByName(deep)
