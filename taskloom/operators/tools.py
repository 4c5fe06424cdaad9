"""Questions about a cluster as table functions for SQL, called once a row of a table of questions by LATERAL.

A question carries its cluster's cells: counts and keyword hits by year and category, a few rows whatever the cluster's size,
counted by Spark (``cells``).  The functions are small; they name their argument and result types in ``analyze``, so a
wrong argument is an error before anything runs.  Null or empty cells give no row.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, IntegralType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def cells(papers: DataFrame, keywords: list[str]) -> DataFrame:
    """(cluster_id, cells): array of (year, category, n, hits) of each cluster."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(F.lower("text"), F.lit(k))
    cube = papers.groupBy("cluster_id", "year", "category").agg(F.count("*").alias("n"), F.count_if(F.coalesce(hit, F.lit(False))).alias("hits"))
    return cube.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("year", "category", "n", "hits"))).alias("cells"))


def _checked(argument: AnalyzeArgument) -> None:
    kind = argument.dataType
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and kind.elementType.names == ["year", "category", "n", "hits"]):
        raise ValueError("cells are an array of (year, category, n, hits)")


def _row(**columns: DataType) -> StructType:
    return StructType([StructField(n, t) for n, t in columns.items()])


def _gives(**columns: DataType):
    """An ``analyze`` for functions of cells alone."""

    def analyze(cells: AnalyzeArgument) -> AnalyzeResult:
        _checked(cells)
        return AnalyzeResult(_row(**columns))

    return staticmethod(analyze)


@udtf
class ClusterSize:
    """Papers, first and last year."""

    analyze = _gives(n=LongType(), from_year=IntegerType(), to_year=IntegerType())

    def eval(self, cells):
        if cells:
            years = [c.year for c in cells if c.year is not None]
            yield sum(c.n for c in cells), min(years, default=None), max(years, default=None)


@udtf
class ClusterCategory:
    """The category of most papers; ties go to the least name."""

    analyze = _gives(category=StringType())

    def eval(self, cells):
        if cells:
            counts = Counter()
            for c in cells:
                counts[c.category] += c.n
            yield (min(counts, key=lambda k: (-counts[k], k is not None, k or "")),)


@udtf
class ClusterTrend:
    """growing, declining or stagnating, by papers on both sides of the upper median year."""

    analyze = _gives(trend=StringType())

    def eval(self, cells):
        if cells:
            by_year = Counter()
            for c in cells:
                by_year[c.year] += c.n
            n, run, middle = sum(by_year.values()), 0, None
            for year in sorted(by_year):
                run += by_year[year]
                if run >= n // 2 + 1:
                    middle = year
                    break
            newer = sum(k for y, k in by_year.items() if y >= middle)
            older = n - newer
            yield ("insufficient data" if n < 4 else "growing" if newer > 1.5 * older else "declining" if newer < 0.6 * older else "stagnating",)


@udtf
class ClusterRate:
    """Share of papers with a keyword."""

    analyze = _gives(rate=DoubleType())

    def eval(self, cells):
        if cells:
            yield (sum(c.hits for c in cells) / sum(c.n for c in cells),)


@udtf
class ClusterYears:
    """The last years with papers, latest first, as many rows as asked for."""

    @staticmethod
    def analyze(cells: AnalyzeArgument, last: AnalyzeArgument) -> AnalyzeResult:
        _checked(cells)
        if not isinstance(last.dataType, IntegralType):
            raise ValueError("the number of years is a whole number")
        return AnalyzeResult(_row(year=IntegerType(), n=LongType()))

    def eval(self, cells, last):
        by_year = Counter()
        for c in cells or ():
            by_year[c.year] += c.n
        yield from sorted(by_year.items(), reverse=True)[: last or 0]


TOOLS = {"cluster_size": ClusterSize, "cluster_category": ClusterCategory, "cluster_trend": ClusterTrend, "cluster_rate": ClusterRate, "cluster_years": ClusterYears}


def register(spark: SparkSession) -> None:
    """Makes the tools known to SQL."""
    for name, tool in TOOLS.items():
        spark.udtf.register(name, tool)


def answered(questions: DataFrame) -> DataFrame:
    """(cluster_id, n, from_year, to_year, category, trend, rate) of each question (cluster_id, cells)."""
    register(questions.sparkSession)
    return questions.sparkSession.sql(
        "SELECT q.cluster_id, s.n, s.from_year, s.to_year, c.category, t.trend, round(r.rate, 3) AS rate "
        "FROM {q} q, LATERAL cluster_size(q.cells) s, LATERAL cluster_category(q.cells) c, LATERAL cluster_trend(q.cells) t, LATERAL cluster_rate(q.cells) r",
        q=questions,
    )


def years_of(questions: DataFrame, last: int = 5) -> DataFrame:
    """(cluster_id, year, n): the last years of each question's cluster."""
    register(questions.sparkSession)
    return questions.sparkSession.sql(f"SELECT q.cluster_id, y.year, y.n FROM {{q}} q, LATERAL cluster_years(q.cells, {int(last)}) y", q=questions)
