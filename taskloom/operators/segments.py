"""Ordered scans over keys of any size: a hot key's rows are cut into chunks by time, and chunks hand on what they carry.

A key with more rows than one task should hold (``most``, or a ``SHARE`` of all rows if that is more) is cut at quantiles of
its times; other keys are one chunk.  A window then runs inside a chunk, never over the key.  What it needs from earlier
chunks comes in one of two ways, both exact:

* ``running``: sums, counts, greatest, least and last known values.  Each chunk is reduced to one row; these rows (at most
  ``1 / SHARE`` hot keys of as many chunks) are scanned in order; a chunk's rows take up what the chunks before it carry.
* ``with_halo``: windows of a fixed number of rows.  The last rows before a chunk are added to it as marked rows; the
  window runs over both, and the marked rows are dropped.

Rows of equal time stay in one chunk, so a single time that holds most rows of a key is the one case that isn't cut.
Defined results: null keys are one key; null times come first and stay in the first chunk; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of one key that one task takes without being cut, and the share of all rows that a chunk aims at beyond it.
MOST = 1_000_000
SHARE = 1 / 256
CHUNK = "_chunk"


def _place(t: DataFrame, at: str) -> Column:
    """The number that chunks are cut by: microseconds of a time, or the number itself."""
    if t.schema[at].dataType.typeName() not in ("timestamp", "timestamp_ntz", "date"):
        return F.col(f"`{at}`").cast("long")
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(`{at}` AS TIMESTAMP_NTZ))")


class Segments:
    """A table cut for ordered scans: ``key`` and ``order`` (the first is a time or a whole number) say what a scan goes along."""

    def __init__(self, t: DataFrame, key: list[str], order: list[str], most: int = MOST, share: float = SHARE, like: Segments | None = None):
        """``like``: a cut of as many or more rows a key; if that found no hot key, none is looked for here."""
        self.key, self.order, self.hot, self.bound = key, order, None, most
        if like is not None and like.hot is None:
            self.rows = t.withColumn(CHUNK, F.lit(0))
            return
        counts = t.groupBy(*key).agg(F.count("*").alias("_n"))
        total = counts.agg(F.sum("_n")).first()[0] or 0
        self.bound = max(most, int(total * share))
        # at most 1 / share keys are over the bound
        hot = counts.where(F.col("_n") > self.bound).collect()
        self.hot = t.sparkSession.createDataFrame([r[:-1] for r in hot], counts.drop("_n").schema) if hot else None
        if not hot:
            self.rows = t.withColumn(CHUNK, F.lit(0))
            return
        cells = int(max(r["_n"] for r in hot) // self.bound) + 1
        marked = self._with(t.withColumn("_at", _place(t, order[0])), self.hot.withColumn("_hot", F.lit(True)), key)
        cuts = marked.where("_hot").groupBy(*key).agg(F.array_distinct(F.percentile_approx("_at", [k / cells for k in range(1, cells)], 100 * cells)).alias("_cuts"))
        # as rows, so that every use of the table is cut alike
        cuts = t.sparkSession.createDataFrame(cuts.collect(), cuts.schema)
        cut = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_at"))), F.lit(0))
        self.rows = self._with(marked.drop("_hot"), cuts, key).withColumn(CHUNK, F.when(F.col("_cuts").isNull() | F.col("_at").isNull(), 0).otherwise(cut)).drop("_at", "_cuts")

    @staticmethod
    def _with(t: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
        """``t`` with the columns of ``small`` (a row a hot key or chunk, so bounded), nulls of ``on`` being equal."""
        other = F.broadcast(small.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], *[c for c in small.columns if c not in on]))
        met = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(on)]
        cond = met[0]
        for m in met[1:]:
            cond &= m
        return t.join(other, cond, "left").drop(*[f"_k{i}" for i in range(len(on))])

    def _hot_rows(self, t: DataFrame) -> DataFrame:
        return self._with(t, self.hot.withColumn("_hot", F.lit(True)), self.key).where("_hot").drop("_hot")

    def window(self, backwards: bool = False):
        """Rows of one chunk in order."""
        return W.partitionBy(*self.key, CHUNK).orderBy(*[F.desc(c) if backwards else F.asc(c) for c in self.order])

    def over(self, rows: DataFrame) -> Segments:
        """The same cut of other columns: ``rows`` was made from this table's."""
        out = object.__new__(Segments)
        out.__dict__ = self.__dict__ | {"rows": rows}
        return out

    def running(self, values: dict[str, tuple[str, Column]], upto: int = 0, backwards: bool = False) -> Segments:
        """Adds for each name the ``sum``, ``count``, ``max``, ``min`` or ``last`` (not null) of a column over the rows of the key up to this one (``upto=-1``: before it).

        ``backwards`` goes from the last row: over this row and those after it."""
        t = self.rows.withColumns({f"_v_{n}": c for n, (_, c) in values.items()})
        here = self.window(backwards).rowsBetween(W.unboundedPreceding, upto)
        inside = {n: _reduced(kind, f"_v_{n}", here) for n, (kind, _) in values.items()}
        if self.hot is None:
            empty = {n: F.coalesce(c, F.lit(0)) if values[n][0] in ("sum", "count") else c for n, c in inside.items()}
            return self.over(t.withColumns(empty).drop(*[f"_v_{n}" for n in values]))
        last = F.struct(*self.order)
        own = self._hot_rows(t).groupBy(*self.key, CHUNK).agg(*[_chunked(kind, f"_v_{n}", last, backwards).alias(f"_v_{n}") for n, (kind, _) in values.items()])
        ahead = W.partitionBy(*self.key).orderBy(F.desc(CHUNK) if backwards else F.asc(CHUNK)).rowsBetween(W.unboundedPreceding, -1)
        carry = own.select(*self.key, CHUNK, *[_merged(kind, f"_v_{n}", ahead).alias(f"_c_{n}") for n, (kind, _) in values.items()])
        t = self._with(t.withColumns(inside), carry, [*self.key, CHUNK])
        both = {n: _combined(kind, F.col(f"_c_{n}"), F.col(n)) for n, (kind, _) in values.items()}
        return self.over(t.withColumns(both).drop(*[f"_{a}_{n}" for a in "vc" for n in values]))

    def windowed(self, n: int, make, backwards: bool = False) -> Segments:
        """Adds columns that look at ``n`` rows before (``backwards``: after) each row: ``make(window)`` gives them by name."""
        if self.hot is None:
            return self.over(self.rows.withColumns(make(self.window(backwards))))
        step = -1 if backwards else 1
        near = W.partitionBy(*self.key, CHUNK).orderBy(*[F.asc(c) if backwards else F.desc(c) for c in self.order])
        # of each chunk's edge at most n rows, and of those before a chunk the n nearest
        edges = self._hot_rows(self.rows).withColumn("_e", F.row_number().over(near)).where(F.col("_e") <= n)
        packed = edges.groupBy(*self.key, CHUNK).agg(F.array_sort(F.collect_list(F.struct((F.col("_e") * -1).alias("_e"), F.struct(*[c for c in self.rows.columns if c != CHUNK]).alias("_row")))).alias("_edge"))
        ahead = W.partitionBy(*self.key).orderBy(F.col(CHUNK) * step).rowsBetween(W.unboundedPreceding, -1)
        halo = packed.withColumn("_near", F.flatten(F.collect_list("_edge").over(ahead))).select(*self.key, F.col(CHUNK).alias("_to"), F.explode(F.expr(f"slice(_near, greatest(size(_near) - {n}, 0) + 1, {n})")).alias("_x"))
        halo = halo.select("_x._row.*", F.col("_to").alias(CHUNK), F.lit(True).alias("_halo"))
        both = self.rows.withColumn("_halo", F.lit(False)).unionByName(halo)
        return self.over(both.withColumns(make(self.window(backwards))).where(~F.col("_halo")).drop("_halo"))

    def done(self) -> DataFrame:
        return self.rows.drop(CHUNK)


def _reduced(kind: str, value: str, w) -> Column:
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}[kind](value).over(w)


def _chunked(kind: str, value: str, last: Column, backwards: bool) -> Column:
    if kind == "last":
        return (F.min_by if backwards else F.max_by)(value, F.when(F.col(value).isNotNull(), last))
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](value)


def _merged(kind: str, value: str, ahead) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(ahead)
    return {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[kind](value).over(ahead)


def _combined(kind: str, before: Column, inside: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))
    return {"max": F.greatest, "min": F.least, "last": lambda b, i: F.coalesce(i, b)}[kind](before, inside)
