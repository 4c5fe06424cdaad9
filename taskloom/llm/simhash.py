"""SimHash near-duplicates by the generalised pigeonhole.

Fingerprints are made by built-in functions: each 4-word shingle's 64-bit hash votes on 64 bits, two
counters a column.  Equal fingerprints become one node.  Bits are grouped so that correlated ones share
a partition; each partition i gets its own threshold t_i with sum(t_i) = radius - partitions + 1, so two
fingerprints within the radius agree within t_i in some partition.  Number of partitions and
thresholds come from a dynamic programme over candidate counts, estimated from how often all fingerprints
agree in each partition.  Every fingerprint is filed under its own partition value and probes all values
within t_i of it; what meets there is verified in numpy.

A filing place sends on a spanning forest of its verified links, not all pairs.  Where links are only probable until texts are
compared, the forest's pairs are compared first, then all pairs that still lie between two groups.  A place with more than
``PLACE`` fingerprints is dealt over a grid of cells: each holds a part of the filed ones and sees a part of the probes,
so every pair meets in some cell and no task holds the whole place.  A cell takes its probes ``HOLD`` rows at a
time.  Components are found by joins of labels and edges, with the state written to shared storage after each round,
and edges are drawn anew between the labels, so that few are left after the first; in these joins one side has one row a key, and a hub on the other is split by Spark's adaptive skew join.
Documents of hot fingerprints, and nodes of hot components, get their names by broadcast (``hot_join``).

Defined results: null, empty and blank texts have fingerprint zero and link like any other; a text of one
to three words is one shingle; repeated rows share a component; null ids count only if a component has no
other; extra columns of any name are ignored; an empty table gives an empty result.  One document's words are held by
one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts
from .scratch import cut, hot_join, picked, small
from .text import SPACED_WORDS, ascii_lower, words

SHINGLE = 4
RADIUS = 4
PLACE = 4096
#: Rows of one filing place that are held at once.
HOLD = 262_144
#: Candidate pairs that are verified at once.
PAIRS = 262_144
#: A key with over one in so many rows is hot.
HOT_SHARE = 1000
#: Of the near copies that ``keep_one`` removes.
COPY_RADIUS, CHECK_SHINGLE = 8, 5
#: Bits of its check prints, 64 a column.  One in ten differs at a similarity of 0.8 (half of the share that isn't common):
#: 51, with a deviation of 7.  Up to ``CHECK_SURE`` (nearly three deviations less) is a link, from there to ``CHECK_ALLOW``
#: (two more) the sets of shingles themselves decide.
CHECK_BITS, CHECK_SURE, CHECK_ALLOW = 512, 32, 65
CHECKS = [f"c{k}" for k in range(1, CHECK_BITS // 64 + 1)]
#: Columns of nodes whose pairs weren't all compared: tree, members of the set, and those of them that another node has.
REST = ["tree", "size", "shared"]
#: What a probe costs, in comparisons.
PROBE_COST = 200
_LANES = (1 << 32) | 1


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``_rid``, key and ``fp`` (the 64 bits as a signed long) of every row."""
    w = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(key).alias("_key"), words(ascii_lower(F.col(text)), SPACED_WORDS).alias("_w"))
    more = "".join(f", get(_w, i + {j})" for j in range(1, SHINGLE))
    hashes = F.expr(
        f"CASE WHEN size(_w) >= {SHINGLE} THEN slice(transform(_w, (x, i) -> xxhash64(concat_ws(' ', x{more}))), 1, size(_w) - {SHINGLE - 1}) "
        "WHEN size(_w) > 0 THEN array(xxhash64(array_join(_w, ' '))) ELSE CAST(array() AS ARRAY<BIGINT>) END"
    )
    each = w.select("_rid", "_key", F.explode_outer(hashes).alias("h"))
    # bits i and i + 32 are counted in the two halves of one long
    votes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_LANES))).alias(f"_v{i}") for i in range(32)]
    got = each.groupBy("_rid", "_key").agg(F.count("h").alias("_n"), *votes)
    half = lambda i: F.coalesce(F.col(f"_v{i}").bitwiseAND(F.lit(0xFFFFFFFF)) if i < 32 else F.shiftrightunsigned(f"_v{i - 32}", 32), F.lit(0))
    fp = F.lit(0).cast("long")
    for i in range(64):
        bit = 1 << i if i < 63 else -(1 << 63)
        fp = fp.bitwiseOR(F.when(2 * half(i) > F.col("_n"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return got.select("_rid", F.col("_key").alias(key), fp.alias("fp"))


def correlated_groups(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """64 bits in ``parts`` groups of near-equal size; a group takes the bit most correlated with it.

    ``together``: how often bits i and j are both set, over ``n`` fingerprints."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = list(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        first = max(left, key=lambda b: (sum(corr[b, c] for c in left), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            nearest = max(left, key=lambda b: (sum(corr[b, c] for c in group), -b))
            group.append(nearest)
            left.remove(nearest)
        groups.append(sorted(group))
    return groups


def allocate(agree: list[float], widths: list[int], n: int, radius: int) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost whose sum is radius - parts + 1 (-1: partition isn't probed).

    ``agree``: pairs of fingerprints that agree in each partition."""
    total = radius - len(widths) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for pairs, width in zip(agree, widths):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(radius, 3) + 1):
                ball = sum(comb(width, k) for k in range(t + 1))
                here = cost + ball * (PROBE_COST * n + pairs)
                if used + t not in step or here < step[used + t][0]:
                    step[used + t] = (here, [*chosen, t])
        best = step
    return best.get(total, (float("inf"), []))  # too few partitions for thresholds of three at most


def _packed(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), dtype=np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def plan(nodes: DataFrame, n: int, radius: int) -> tuple[list[list[int]], list[int]]:
    """Bit groups and thresholds for these fingerprints; reads all of them, collects 4096 counts and a few sums."""

    def joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(range(4096), type=pa.int32()), pa.array(total.ravel().astype(np.int64))], names=["cell", "c"])

    together = np.zeros(4096)
    for r in nodes.select("fp").mapInArrow(joint, "cell int, c bigint").groupBy("cell").agg(F.sum("c").alias("c")).collect():
        together[r["cell"]] = r["c"]
    choices = [correlated_groups(together.reshape(64, 64), n, parts) for parts in range(2, 7)]
    flat = [g for c in choices for g in c]

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for i, g in enumerate(flat):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int32)), pa.array(_packed(fp, g))], names=["part", "value"])

    met = nodes.select("fp").mapInArrow(values, "part int, value bigint").groupBy("part", "value").agg(F.count("*").alias("c"))
    agree = {r["part"]: r["s"] for r in met.groupBy("part").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("s")).collect()}
    at, best = 0, None
    for groups in choices:
        cost, chosen = allocate([agree.get(at + k, 0.0) for k in range(len(groups))], [len(g) for g in groups], n, radius)
        at += len(groups)
        if best is None or cost < best[0]:
            best = (cost, groups, chosen)
    if best[0] == float("inf"):
        raise ValueError(f"no partition of 64 bits has thresholds that find all pairs within {radius} bits")
    return best[1], best[2]


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (least member of each tree) after linking places ``i`` and ``j``."""
    while True:
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def _apart(rows: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Differing bits of the check prints of nodes ``i`` and ``j`` (rows: fingerprint, then check prints); many beyond the radius."""
    d = np.bitwise_count(rows[i, 1:] ^ rows[j, 1:]).sum(axis=1, dtype=np.int64)
    return np.where(np.bitwise_count(rows[i, 0] ^ rows[j, 0]) <= radius, d, 1 << 40)


def _least_forest(pairs: np.ndarray, label: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """Of ``pairs`` (rows: distance, node, node) a spanning forest of least distances between the trees of ``label``.

    ``more`` is set for the nodes of pairs between trees that aren't in it."""
    pairs = pairs[:, label[pairs[1]] != label[pairs[2]]]
    pairs = pairs[:, np.lexsort((pairs[2], pairs[1], pairs[0]))]
    label, taken, left = label.copy(), [], np.arange(pairs.shape[1])
    while len(left):
        first = np.full(len(label), pairs.shape[1])
        for end in (1, 2):  # the nearest pair of each tree
            np.minimum.at(first, label[pairs[end, left]], left)
        new = np.unique(first[first < pairs.shape[1]])
        taken.append(new)
        label = _joined(label, pairs[1, new], pairs[2, new])
        left = left[label[pairs[1, left]] != label[pairs[2, left]]]
    if not taken:
        return pairs
    chosen = np.concatenate(taken)
    if more is not None:
        more[np.delete(pairs[1:], chosen, axis=1)] = True
    return pairs[:, chosen]


def _between(rows: np.ndarray, filed: np.ndarray, tree: np.ndarray, size: np.ndarray, shared: np.ndarray, radius: int, allow: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (node, node) of one place that lie in different trees and may be links, some at a time."""
    data = np.flatnonzero(filed)
    for a in range(0, len(rows), 256):
        near = np.bitwise_count(rows[a : a + 256, None, 0] ^ rows[None, data, 0]) <= radius
        i, j = np.nonzero(near & (tree[a : a + 256, None] != tree[None, data]))
        i, j = i + a, data[j]
        for k in range(0, len(i), PAIRS):
            x, y = i[k : k + PAIRS], j[k : k + PAIRS]
            # two filed nodes meet twice; what two sets have in common others share too
            ok = (~filed[x] | (x < y)) & (9 * np.minimum(shared[x], shared[y]) >= 4 * (size[x] + size[y]))
            x, y = x[ok], y[ok]
            ok = _apart(rows, x, y, radius) <= allow
            if ok.any():
                yield x[ok], y[ok]


def _forest(rows: np.ndarray, filed: np.ndarray, radius: int, sure: int = 0, allow: int = 0, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (node, node, whether sure) of one place.

    Sure ones: each node with the least one of its tree; links are dropped as soon as they are in the forest.  Others, of
    over ``sure`` differing bits: pairs that join those trees, of least distances.  ``more`` is set for the nodes of any
    others of them."""
    label = np.arange(len(rows))
    data = np.flatnonzero(filed)
    doubt = np.zeros((3, 0), dtype=np.int64)
    for a in range(0, len(rows), 256):
        i, j = np.nonzero(np.bitwise_count(rows[a : a + 256, None, 0] ^ rows[None, data, 0]) <= radius)
        i, j = i + a, data[j]
        for k in range(0, len(i), PAIRS):
            x, y = i[k : k + PAIRS], j[k : k + PAIRS]
            open_ = label[x] != label[y]  # what is in one tree needs no more links
            x, y = x[open_], y[open_]
            d = _apart(rows, x, y, radius)
            ok, open_ = d <= sure, (d > sure) & (d <= allow)
            if ok.any():
                label = _joined(label, x[ok], y[ok])
            if open_.any():
                doubt = np.concatenate([doubt, np.stack([d[open_], x[open_], y[open_]])], axis=1)
                if doubt.shape[1] > 2 * len(rows) + PAIRS:
                    doubt = _least_forest(doubt, label, more)
    doubt = _least_forest(doubt, label, more)
    out = np.flatnonzero(label != np.arange(len(rows)))
    return np.concatenate([out, doubt[1]]), np.concatenate([label[out], doubt[2]]), np.arange(len(out) + doubt.shape[1]) < len(out)


def links(nodes: DataFrame, groups: list[list[int]], thresholds: list[int], radius: int, place: int = PLACE, sure: int = 0, allow: int = 0, hold: int = HOLD) -> DataFrame:
    """Verified links (a, b) that connect all nodes within ``radius`` of each other.

    ``nodes``: column ``fp`` and any number of check prints, 64 bits each; check prints of linked nodes differ by ``sure``
    bits together at most.  A node is its ``fp``, or a struct of all columns where there are check prints; then column ``sure``
    is false for pairs that differ by more, ``allow`` at most, and would join further nodes.  Where a place has more such pairs
    than a spanning forest, their nodes come paired with themselves, with ``sure`` null.  If ``nodes`` has the columns
    ``REST`` too, all pairs of different trees within ``allow`` bits are given instead, none of them sure, but for those whose
    sets can't have enough in common (``shared``: members that another node has)."""
    names, trees = [c for c in nodes.columns if c not in REST], "tree" in nodes.columns
    carried = [*names, *REST] if trees else names
    kinds = ", ".join(f"{c} bigint" for c in carried)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own_columns = [b.column(c) for c in carried]
            fp = own_columns[0].to_numpy(zero_copy_only=False).view(np.uint64)
            for part, (bits, t) in enumerate(zip(groups, thresholds)):
                own = _packed(fp, bits)
                for k in range(t + 1):
                    for flip in combinations(range(len(bits)), k):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(fp), part, np.int32)), pa.array(own ^ np.int64(sum(1 << f for f in flip))), pa.array(np.full(len(fp), k == 0)), *own_columns],
                            names=["part", "value", "filed", *carried],
                        )

    rows = nodes.mapInArrow(probes, f"part int, value bigint, filed boolean, {kinds}")
    sizes = rows.where("filed").groupBy("part", "value").agg(F.count("*").alias("_c")).where(F.col("_c") > place)
    sizes = cut(sizes.select("part", "value", F.ceil(F.col("_c") / place).cast("int").alias("_blocks")), "simhash-large")
    if sizes.limit(1).count():
        large, _ = small(sizes, 100_000)
        rows = rows.join(large, ["part", "value"], "left")
        # a grid of cells: rows by where a node is filed, columns by where it probes; a filed node also probes the other rows
        deal = lambda seed: F.pmod(F.xxhash64(*names, F.lit(seed)), F.col("_blocks")).cast("int")
        rows = rows.withColumns({"_f": deal(1), "_p": deal(2)})
        cells = F.expr(
            """CASE WHEN _blocks IS NULL THEN array(named_struct('block', 0, 'filed', filed)) ELSE concat(
                 IF(filed, transform(sequence(0, _blocks - 1), q -> named_struct('block', _f * _blocks + q, 'filed', true)), cast(array() as array<struct<block:int,filed:boolean>>)),
                 transform(filter(sequence(0, _blocks - 1), g -> NOT filed OR g <> _f), g -> named_struct('block', g * _blocks + _p, 'filed', false))) END"""
        )
        rows = rows.select("part", "value", *carried, F.explode(cells).alias("_s")).select("part", "value", "_s.block", "_s.filed", *carried)
    else:
        rows = rows.select("part", "value", F.lit(0).alias("block"), "filed", *carried)

    ends = [f"{e}_{c}" for e in "ab" for c in names]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = lambda parts: tuple(np.concatenate(x) for x in zip(*parts))

        def whole() -> Iterator[tuple[np.ndarray, ...]]:
            """Batches cut between places; of a place with over ``hold`` rows, its filed rows with some of the others at a time."""
            kept: list[tuple[np.ndarray, ...]] = []
            held = 0
            for b in batches:
                now = tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "value", "block", "filed", *carried))
                if not len(now[0]):
                    continue
                change = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0) | (np.diff(now[2]) != 0)) + 1
                head = kept[-1] if kept else None
                if head is not None and any(head[c][-1] != now[c][0] for c in range(3)):
                    yield joined(kept)
                    kept, held = [], 0
                if len(change):
                    yield joined([*kept, tuple(x[: change[-1]] for x in now)])
                    kept, held = [tuple(x[change[-1] :] for x in now)], len(now[0]) - change[-1]
                else:
                    kept.append(now)
                    held += len(now[0])
                if held > hold and not kept[-1][3][-1]:
                    full = joined(kept)  # filed rows come first, so these are all of the place
                    yield full
                    kept = [tuple(x[full[3]] for x in full)]
                    held = len(kept[0][0])
            if kept:
                yield joined(kept)

        def made(node: np.ndarray, i: np.ndarray, j: np.ndarray, ok: pa.Array) -> pa.RecordBatch:
            # the lesser node first, by the first print that differs
            swap = np.zeros(len(i), dtype=bool)
            for c in range(node.shape[1] - 1, -1, -1):
                x, y = node[i, c], node[j, c]
                swap = np.where(x == y, swap, x > y)
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            return pa.RecordBatch.from_arrays([*[pa.array(node[k, c].view(np.int64)) for k in (i, j) for c in range(node.shape[1])], ok], names=[*ends, "sure"])

        for part, value, block, filed, *prints in whole():
            node = np.stack([x.view(np.uint64) for x in prints[: len(names)]], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(part) != 0) | (np.diff(value) != 0) | (np.diff(block) != 0)) + 1, [len(node)]])
            size = np.diff(cuts)
            if trees:
                for g in np.flatnonzero(size > 1):
                    s = slice(cuts[g], cuts[g + 1])
                    for i, j in _between(node[s], filed[s], *(x[s] for x in prints[-3:]), radius, allow):
                        yield made(node[s], i, j, pa.array(np.zeros(len(i), dtype=bool)))
                continue
            more = np.zeros(len(node), dtype=bool)
            few = np.repeat(size <= 8, size)
            place_of = np.repeat(np.arange(len(size)), size)
            a, b, c = [], [], []
            for d in range(1, min(8, len(node))):
                i = np.flatnonzero(few[:-d] & (place_of[:-d] == place_of[d:]) & (filed[:-d] | filed[d:]))
                apart = _apart(node, i, i + d, radius)
                i, apart = i[apart <= allow], apart[apart <= allow]
                a.append(i)
                b.append(i + d)
                c.append(apart <= sure)
            for g in np.flatnonzero(size > 8):
                s = slice(cuts[g], cuts[g + 1])
                if filed[s].any():
                    x, y, z = _forest(node[s], filed[s], radius, sure, allow, more[s])
                    a.append(x + cuts[g])
                    b.append(y + cuts[g])
                    c.append(z)
            i, j, ok = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, c))
            if len(i):
                yield made(node, i, j, pa.array(ok))
            if more.any():
                k = np.flatnonzero(more)
                yield made(node, k, k, pa.nulls(len(k), pa.bool_()))

    dealt = rows.repartition("part", "value", "block").sortWithinPartitions("part", "value", "block", F.desc("filed"), *carried)
    found = dealt.mapInArrow(verify, ", ".join(f"{e} bigint" for e in ends) + ", sure boolean").distinct()
    if len(names) == 1:
        return found.drop("sure").toDF("a", "b")
    return found.select(*[F.struct(*[F.col(f"{e}_{c}").alias(c) for c in names]).alias(e) for e in "ab"], "sure")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes with an edge (columns a, b): comp is the least node in reach.

    In each round nodes fall to their least neighbour, pointers are followed to their ends, and edges that still lie between
    two ends are drawn between those, each once.  Nodes at least halve in two rounds, and edges never grow."""
    once = lambda e: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, state = cut(once(edges), "edges"), None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
        while True:
            far = up.select(F.col("node").alias("comp"), F.col("comp").alias("_far"))
            step = cut(up.join(far, "comp").select("node", F.col("comp").alias("_old"), F.col("_far").alias("comp")), "labels")
            up = step.select("node", "comp")
            if not step.where(F.col("_old") != F.col("comp")).limit(1).count():
                break
        if state is None:
            state = up
        else:
            far = up.select(F.col("node").alias("comp"), F.col("comp").alias("_far"))
            state = cut(state.join(far, "comp", "left").select("node", F.coalesce("_far", "comp").alias("comp")), "labels")
        for end in ("a", "b"):
            edges = edges.join(up.select(F.col("node").alias(end), F.col("comp").alias("_far")), end).withColumn(end, F.col("_far")).drop("_far")
        edges = cut(once(edges.where("a != b")), "edges")
        if not edges.limit(1).count():
            return state


def _grouped(prints: DataFrame, names: list[str], radius: int, sure: int = 0, allow: int = 0, decide: Callable[[DataFrame, DataFrame], DataFrame] | None = None, shares: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """A table of nodes: ``node``, the least ``_id`` in reach as ``component_id``, and whether over a thousandth of the rows have the node.

    ``prints``: columns ``names`` (fingerprint and check prints) and ``_id``.  ``decide`` takes the links that aren't sure and
    the nodes with their least ids, and returns the true ones; ``shares`` takes some nodes and all with their least ids, and
    gives the size of each one's set and how much of it others of them share."""
    node = F.col(names[0]) if len(names) == 1 else F.struct(*names)
    nodes = cut(prints.groupBy(*names).agg(F.min("_id").alias("_least"), F.count("*").alias("_rows")).withColumn("node", node), "simhash-nodes")
    n, rows = nodes.agg(F.count("*"), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    heavy = (F.col("_rows") * HOT_SHARE > rows).alias("heavy")
    alone = nodes.select("node", F.col("_least").alias("component_id"), heavy)
    if n < 2:
        return cut(alone, "simhash-groups")
    groups, thresholds = plan(nodes, n, radius)
    edges = cut(links(nodes.select(*names), groups, thresholds, radius, sure=sure, allow=allow), "simhash-links")
    if decide:
        true = decide(edges.where("NOT sure").select("a", "b"), nodes.select("node", "_least"))
        left = edges.where("sure IS NULL").select(F.col("a").alias("node"))
        edges = cut(edges.where("sure").select("a", "b").unionByName(true), "simhash-true")
        if left.limit(1).count():
            # pairs that a forest left out, as far as the true ones don't join their trees
            tree = left.withColumn("tree", F.monotonically_increasing_id())
            if edges.limit(1).count():
                known = components(edges)
                joined = cut(known.join(left, "node"), "simhash-joined")
                named = joined.groupBy("comp").agg(F.min("node").alias("_first"))
                ids = cut(tree, "simhash-tree")
                first = joined.join(named, "comp").join(ids.select(F.col("node").alias("_first"), F.col("tree").alias("_tree")), "_first").select("node", "_tree")
                tree = ids.join(first, "node", "left").select("node", F.coalesce("_tree", "tree").alias("tree"))
                edges = known.select(F.col("node").alias("a"), F.col("comp").alias("b"))  # joins the same nodes, with fewer edges
            tree = cut(tree, "simhash-rest")
            bounds = shares(tree.select("node"), nodes.select("node", "_least")) if shares else tree.select("node", F.lit(1 << 32).alias("size"), F.lit(1 << 32).alias("shared"))
            rest = links(cut(tree.join(bounds, "node").select("node.*", *REST), "simhash-bounds"), groups, thresholds, radius, sure=sure, allow=allow)
            rest = cut(rest.select("a", "b"), "simhash-between")
            edges = cut(edges.unionByName(decide(rest, nodes.select("node", "_least"))), "simhash-all")
    if not edges.limit(1).count():
        return cut(alone, "simhash-groups")
    label = cut(components(edges).join(nodes.select("node", "_least"), "node"), "simhash-labels")
    least = cut(label.groupBy("comp").agg(F.min("_least").alias("component_id"), F.count("*").alias("_c")), "simhash-least")
    named = hot_join(label.select("node", "comp"), least, "comp", F.col("_c") * HOT_SHARE > label.count()).select("node", F.col("component_id").alias("_far"))
    return cut(nodes.join(named, "node", "left").select("node", F.coalesce("_far", "_least").alias("component_id"), heavy), "simhash-groups")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row a document: fingerprint in hex and the least id of its component."""
    prints = cut(fingerprints(docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text")), "_text", "_id"), "simhash")
    found = _grouped(prints, ["fp"], radius)
    named = hot_join(prints.select("_id", F.col("fp").alias("node")), found, "node", F.col("heavy"))
    return named.select(F.col("_id").alias(key), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


class _Hashes(dict):
    """Hash of each word seen; long words aren't kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        made = xxhash.xxh64_intdigest(word, seed=42)
        if len(word) <= 64:
            self[word] = made
        return made


_HASHES = _Hashes()


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    """One value for each ``k`` words in a row; for all of them where there are fewer."""
    k = min(k, len(h))
    out = np.zeros(max(0, len(h) - k + 1) if k else 0, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0x100000001B3) + h[j : j + len(out)]
    return out


def _majority(parts: list[np.ndarray]) -> int:
    """Bits set in more than half of the hashes of all parts."""
    votes, n = np.zeros(64, dtype=np.int64), 0
    for h in parts:
        n += len(h)
        for a in range(0, len(h), 100_000):
            some = np.ascontiguousarray(h[a : a + 100_000])
            votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def _least(h: np.ndarray) -> list[int]:
    """One bit of each of ``CHECK_BITS`` least values of the hashes, each in an order of its own, 64 a signed long."""
    scale = _mixed(np.arange(CHECK_BITS, dtype=np.uint64), 3) | np.uint64(1)
    low = np.full(CHECK_BITS, ~np.uint64(0))
    for a in range(0, len(h), 2048):
        np.minimum(low, (scale[:, None] * h[None, a : a + 2048]).min(axis=1), out=low)
    return np.packbits((low >> np.uint64(20)).astype(np.uint8) & np.uint8(1), bitorder="little").view(np.int64).tolist()


def sketch(text: str) -> tuple[int, ...]:
    """Fingerprint over words (once) and word pairs (twice), and check prints over the set of 5-word shingles, as signed longs."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if len(_HASHES) > 500_000:
        _HASHES.clear()
    h = np.array([_HASHES[x] for x in w], dtype=np.uint64)
    with np.errstate(over="ignore"):
        pairs = _mixed(_shingles(h, 2), 1)
        return _majority([h, pairs, pairs]), *_least(_mixed(_shingles(h, CHECK_SHINGLE), 2))


def _sets(ends: DataFrame, nodes: DataFrame, own: DataFrame) -> DataFrame:
    """The set ``_s`` of 5-word shingles of each node of ``ends``, from its text of least id."""
    ends = cut(ends.join(nodes, "node").select("node", F.col("_least._rid").alias("_rid")), "simhash-doubt")
    more = "".join(f", get(_w, i + {j})" for j in range(1, CHECK_SHINGLE))
    shingles = F.expr(
        f"CASE WHEN size(_w) < {CHECK_SHINGLE} THEN array(xxhash64(array_join(_w, ' '))) ELSE "
        f"array_distinct(slice(transform(_w, (x, i) -> xxhash64(concat_ws(' ', x{more}))), 1, size(_w) - {CHECK_SHINGLE - 1})) END"
    )
    found = picked(own.select("_rid", "_text"), ends).join(ends, "_rid").select("node", words(ascii_lower(F.col("_text")), SPACED_WORDS).alias("_w"))
    return cut(found.select("node", shingles.alias("_s")), "simhash-sets")


def _shares(ends: DataFrame, nodes: DataFrame, own: DataFrame) -> DataFrame:
    """Of each node's set, its ``size`` and how many members (``shared``) another node of ``ends`` has too."""
    sets = _sets(ends, nodes, own).withColumn("_i", F.monotonically_increasing_id())
    sets = cut(sets, "simhash-numbered")
    alone = sets.select("_i", F.explode("_s").alias("_x")).groupBy("_x").agg(F.min("_i").alias("_i"), F.count("*").alias("_c")).where("_c = 1").groupBy("_i").agg(F.count("*").alias("_n"))
    size = F.size("_s").cast("long")
    return sets.join(alone, "_i", "left").select("node", size.alias("size"), (size - F.coalesce("_n", F.lit(0))).alias("shared"))


def _alike(pairs: DataFrame, nodes: DataFrame, own: DataFrame) -> DataFrame:
    """Those ``pairs`` (a, b) of nodes whose texts, of least id each, share 0.8 of their sets of 5-word shingles."""
    if not pairs.limit(1).count():
        return pairs
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets(ends, nodes, own)
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("_s").alias("_x")), "a").join(sets.select(F.col("node").alias("b"), F.col("_s").alias("_y")), "b")
    # the common ones are at least 4/5 of all of both
    return met.where("9 * size(array_intersect(_x, _y)) >= 4 * (size(_x) + size(_y))").select("a", "b")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = COPY_RADIUS, sure: int = CHECK_SURE, allow: int = CHECK_ALLOW) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one of least id (of equal rows one; null ids last).

    Near copies share at least 0.8 of their sets of 5-word shingles.  Such a pair's fingerprints over single shingles differ by
    ten bits and more of 64, which no pigeonhole reaches at a bearable cost; so candidates come from a fingerprint over
    words and word pairs, which a changed word alters less (``radius`` bits), and are verified by ``CHECK_BITS`` min-wise
    bits of their sets of 5-word shingles: a link if ``sure`` of them differ or fewer; up to ``allow``, pairs of least
    distance that would join two groups in a filing place are counted out over the sets themselves.  Rows are numbered and
    stored once; from then on numbers are joined, and no text is shuffled but those that are counted out.
    Groups are chains of such links.  All columns stay, whatever their names; null, empty and blank texts are copies of
    each other; no documents give no rows."""
    names = ["fp", *CHECKS]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.monotonically_increasing_id().alias("_rid"))
    rows = cut(rows, "simhash-rows")  # a number stays with its row, whatever the order of a later scan
    key_, text_ = (F.col("_row").getField(c) for c in (key, text))
    own = rows.select("_rid", key_.isNull().alias("_null"), key_.alias("_key"), F.xxhash64(text_).alias("_th"), text_.alias("_text"))

    def work(texts):
        made = [sketch(t) for t in texts]
        return {c: [m[k] for m in made] for k, c in enumerate(names)}

    prints = map_texts(own, "_text", ["_null", "_key", "_th", "_rid"], ", ".join(f"{c} long" for c in names), work)
    prints = cut(prints.select(*names, F.struct("_null", "_key", "_th", "_rid").alias("_id")), "simhash")
    chosen = _grouped(prints, names, radius, sure, allow, lambda pairs, nodes: _alike(pairs, nodes, own), lambda ends, nodes: _shares(ends, nodes, own))
    return picked(rows, chosen.select("component_id._rid")).select("_row.*")
