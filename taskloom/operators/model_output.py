"""What comes back from injected model calls: parsing with defaults, fallbacks, retries.  No call is made here."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import unfenced

#: Fields of a gap: fixed defaults.
GAP = "title:string,description:string,supporting_clusters:array<int>,confidence:double,suggested_methodology:string"
METHOD = "methodology_type string, description string, steps array<string>, estimated_months int, compute_requirements string"
NO_GAP = "Gap detection parsing failed"


def expanded_queries(raw: Column, reply: Column) -> Column:
    """The raw query and the listed ones; the raw one alone if the reply is no list of strings."""
    listed = F.from_json(unfenced(reply), "array<string>")
    return F.concat(F.array(raw), F.coalesce(F.filter(listed, lambda x: x.isNotNull()), F.array().cast("array<string>")))


def parse_gaps(replies: DataFrame, most: int = 6) -> DataFrame:
    """Gaps of each reply (reply_id, reply), the first ``most``; a placeholder with the reply's head where none can be read."""
    listed = F.from_json(unfenced(F.col("reply")), f"array<struct<{GAP}>>")
    x = replies.withColumn("_l", listed)
    none = F.array().cast("array<int>")
    placeholder = F.array(F.struct(F.lit(NO_GAP).alias("title"), F.substring("reply", 1, 300).alias("description"), none.alias("supporting_clusters"), F.lit(0.0).alias("confidence"), F.lit("empirical analysis").alias("suggested_methodology")))
    each = x.select("reply_id", F.posexplode(F.coalesce(F.slice("_l", 1, most), placeholder)).alias("gap_id", "g"))
    return each.select("reply_id", "gap_id", F.coalesce("g.title", F.concat(F.lit("Gap "), F.col("gap_id").cast("string"))).alias("title"), F.coalesce("g.description", F.lit("")).alias("description"), F.coalesce("g.supporting_clusters", none).alias("supporting_clusters"),
                       F.coalesce("g.confidence", F.lit(0.5)).alias("confidence"), F.coalesce("g.suggested_methodology", F.lit("empirical analysis")).alias("suggested_methodology"))


def parse_method(reply: Column, kinds: list[str]) -> Column:
    """A methodology plan; an unknown kind becomes empirical_analysis, missing fields have their defaults."""
    m = F.coalesce(F.from_json(unfenced(reply), METHOD), F.from_json(F.lit("{}"), METHOD))
    kind = F.when(m["methodology_type"].isin(kinds), m["methodology_type"]).otherwise("empirical_analysis")
    return F.struct(kind.alias("methodology_type"), F.coalesce(m["description"], F.lit("")).alias("description"), F.coalesce(m["steps"], F.array().cast("array<string>")).alias("steps"), F.coalesce(m["estimated_months"], F.lit(6)).alias("estimated_months"), F.coalesce(m["compute_requirements"], F.lit("Unknown")).alias("compute_requirements"))


def cluster_label(reply: Column, cluster_id: Column) -> Column:
    """The label of a reply, or Cluster and its number."""
    got = F.regexp_replace(reply, r"^[\s\"]+|[\s\"]+$", "")
    return F.when(F.coalesce(got, F.lit("")) == "", F.concat(F.lit("Cluster "), cluster_id.cast("string"))).otherwise(got)


def cluster_summary(clusters: DataFrame, cluster_id: int) -> DataFrame:
    """One line on a cluster, or that there is none: the lookup tool of the gap search."""
    one = clusters.where(F.col("cluster_id") == cluster_id).limit(1).select(F.format_string("Cluster %d: '%s' papers %d years %d-%d category %s trend %s", "cluster_id", "label", "n", "from_year", "to_year", "category", "trend").alias("summary"))
    found = one.agg(F.max("summary").alias("summary"))
    return found.select(F.coalesce("summary", F.lit(f"No cluster found with ID {cluster_id}.")).alias("summary"))


def with_retries(call: Callable[[], object], retries: int, base: float = 2.0, wait: Callable[[float], None] = time.sleep, on: Callable[[str, int, Exception | None], None] | None = None):
    """Calls up to ``retries`` + 1 times, waiting base * 2 ** (attempt - 1) between; the last error is raised.  ``on`` hears of start, complete and fail; its own errors are ignored."""

    def tell(what: str, attempt: int, error: Exception | None = None) -> None:
        try:
            if on:
                on(what, attempt, error)
        except Exception:  # noqa: BLE001
            pass

    for attempt in range(1, retries + 2):
        tell("start", attempt)
        try:
            out = call()
        except Exception as error:  # noqa: BLE001
            tell("fail", attempt, error)
            if attempt > retries:
                raise
            wait(base * 2 ** (attempt - 1))
        else:
            tell("complete", attempt)
            return out
