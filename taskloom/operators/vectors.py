"""Embedding, projection and density clustering of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed(papers: DataFrame, encoder: Callable[[list[str]], np.ndarray], text: str = "text", batch: int = 32) -> DataFrame:
    """``papers`` with ``embedding``: unit vectors of an injected encoder, which gets ``batch`` texts a call."""

    @F.pandas_udf("array<float>")
    def work(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            made = []
            for a in range(0, len(some), batch):
                v = np.asarray(encoder(some.iloc[a : a + batch].fillna("").tolist()), dtype=np.float64)
                made += list((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32))
            yield pd.Series(made)

    return papers.withColumn("embedding", work(text))


def project(vectors: DataFrame, k: int = 2, column: str = "embedding") -> DataFrame:
    """(vec_id, x): the first ``k`` principal components, for display; it stands in for a neighbour-graph projection.

    The covariance is one aggregate of d x d sums, so vectors of any number are read in place."""
    d = len(vectors.select(column).first()[0])

    def sums(batches):
        total, n = np.zeros((d + 1, d + 1)), 0
        for b in batches:
            v = np.stack(b[column].to_numpy()).astype(np.float64) if len(b) else np.zeros((0, d))
            v = np.hstack([v, np.ones((len(v), 1))])
            total += v.T @ v
            n += len(v)
        yield pd.DataFrame({"cell": np.arange((d + 1) ** 2), "s": total.ravel()})

    cells = vectors.select(column).mapInPandas(sums, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()  # (d + 1) squared rows
    total = np.zeros((d + 1) ** 2)
    for r in cells:
        total[r["cell"]] = r["s"]
    total = total.reshape(d + 1, d + 1)
    n = max(total[d, d], 1.0)
    mean = total[d, :d] / n
    values, axes = np.linalg.eigh(total[:d, :d] / n - np.outer(mean, mean))
    axes = axes[:, np.argsort(-values)[:k]]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)  # a sign that doesn't depend on the solver

    @F.pandas_udf("array<double>")
    def along(column_: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(column_.to_numpy()) - mean) @ axes))

    return vectors.select("vec_id", along(column).alias("x"))


def _mutual_tree(points: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree (from, to, weight) of mutual reachability distances, by Prim: memory is linear in the points."""
    n = len(points)
    norm = (points**2).sum(axis=1)
    far = lambda i: np.sqrt(np.maximum(norm + norm[i] - 2 * points @ points[i], 0))
    core = np.array([np.partition(far(i), min(samples, n - 1))[min(samples, n - 1)] for i in range(n)])
    best, by, out = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    at, edges = 0, []
    for _ in range(n - 1):
        out[at] = False
        d = np.maximum(np.maximum(far(at), core), core[at])
        nearer = out & (d < best)
        best[nearer], by[nearer] = d[nearer], at
        nxt = int(np.where(out, best, np.inf).argmin())
        edges.append((by[nxt], nxt, best[nxt]))
        at = nxt
    a, b, w = zip(*edges)
    return np.array(a), np.array(b), np.array(w)


def density_labels(points: np.ndarray, least: int | None = None, samples: int = 2) -> np.ndarray:
    """Cluster of each point by density hierarchy and excess of mass; -1 is noise.  ``least``: smallest cluster, max(3, n // 20)."""
    n = len(points)
    least = least or max(3, n // 20)
    if n < least or n < 2:
        return np.full(n, -1)
    a, b, w = _mutual_tree(np.asarray(points, dtype=np.float64), samples)
    # the merge hierarchy: nodes n.. are merges, in order of distance
    up, kids, height, size = np.arange(2 * n - 1), {}, np.zeros(2 * n - 1), np.ones(2 * n - 1, int)

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, e in enumerate(np.argsort(w, kind="stable")):
        x, y, new = top(a[e]), top(b[e]), n + k
        kids[new], height[new], size[new] = (x, y), w[e], size[x] + size[y]
        up[x] = up[y] = new
    lam = lambda h: 1.0 / h if h > 0 else 1e12

    def leaves(x):
        stack, got = [x], []
        while stack:
            y = stack.pop()
            if y < n:
                got.append(y)
            else:
                stack += kids[y]
        return got

    # condensed tree: a cluster lives on while only one child is large enough
    children: dict[int, list[int]] = {0: []}
    stability, member, birth, root_of = {0: 0.0}, {}, {0: 0.0}, {0: 2 * n - 2}
    stack = [(2 * n - 2, 0)]
    while stack:
        x, c = stack.pop()
        if x < n:
            member[x] = c
            continue
        l, r = kids[x]
        at = lam(height[x])
        big = [y for y in (l, r) if size[y] >= least]
        if len(big) == 2:
            stability[c] += size[x] * (at - birth[c])
            for y in big:
                new = len(children)
                children[new], stability[new], birth[new], root_of[new] = [], 0.0, at, y
                children[c].append(new)
                stack.append((y, new))
        else:
            for y in (l, r):
                if y in big:
                    stack.append((y, c))
                else:
                    stability[c] += size[y] * (at - birth[c])
                    for p in leaves(y):
                        member[p] = c
    chosen: set[int] = set()
    for c in sorted(children, reverse=True):
        below = sum(stability[k] for k in children[c])
        if c and (not children[c] or stability[c] >= below):
            drop = [*children[c]]
            while drop:
                k = drop.pop()
                chosen.discard(k)
                drop += children[k]
            chosen.add(c)
        else:
            stability[c] = max(stability[c], below) if c else below
    out = np.full(n, -1)
    for label, c in enumerate(sorted(chosen)):
        out[leaves(root_of[c])] = label
    return out


def cluster(vectors: DataFrame, by: str, column: str = "embedding", samples: int = 2) -> DataFrame:
    """(by, vec_id, cluster) for each group of column ``by``, say the papers of one search.

    A group is clustered by one task, in time that grows with its square and memory with its size; it is meant for groups
    of some thousands at most.  Groups run side by side."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        labels = density_labels(np.stack(group[column].to_numpy()), samples=samples)
        return pd.DataFrame({by: group[by], "vec_id": group["vec_id"], "cluster": labels.astype(np.int32)})

    kind = vectors.schema[by].dataType.simpleString()
    return vectors.select(by, "vec_id", column).groupBy(by).applyInPandas(one, f"{by} {kind}, vec_id long, cluster int")
