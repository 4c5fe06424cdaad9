"""Quality rules: rule-based counts and a hashed n-gram log-likelihood ratio, on built-in functions only.

n-grams (words, word pairs and word endings) are hashed into ``buckets``.  Two multinomials are counted:
over all documents (raw corpus) and over documents that labels call good (trusted target).  A document's
score is the mean over its n-grams of log P(target) - log P(raw), so it doesn't depend on length; documents
whose score is under a fixed threshold are dropped.

Counting the corpus aggregates by bucket before the shuffle, so what moves is at most ``buckets`` rows a
task.  Scoring takes the ``buckets`` weights (a size fixed by parameter) as one scalar, and needs no join and no
shuffle at all: each document is folded where it was read.

Trusted labels: the ``MOST_LABELS`` labelled ids of smallest hash at most, so that their table may be
broadcast.  With no trusted label or no document, all weights are 0 and only the rules decide.

Defined results: null text has no words and fails the rules; repeated rows are judged each; contradicting
labels of one id: any good, non-toxic one counts; an empty or null text has no n-grams and scores 0; no documents
give no rows; extra columns of any name are ignored.  One document's words are held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut
from .text import SPACED_WORDS, gram_hashes, words

BUCKETS = 1 << 16
SMOOTH = 1.0
MOST_LABELS = 200_000
#: Least mean log-likelihood ratio of documents that stay.
THRESHOLD = -0.7
LEAST_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20


def _grams(buckets: int) -> Column:
    """Buckets of all n-grams of the word array ``_w``."""
    pairs = F.expr("slice(_p2, 1, greatest(size(_p2) - 1, 0))")
    return F.transform(F.concat(F.col("_p1"), pairs, F.col("_p3")), lambda h: F.pmod(h, F.lit(buckets)))


def _with_grams(docs: DataFrame, text: str, keep: list[str], buckets: int) -> DataFrame:
    # the row id keeps the optimizer from copying the word split into what is built on it
    split = docs.select(*keep, F.monotonically_increasing_id().alias("_rid"), F.col(text).alias("_t"), words(F.col(text), SPACED_WORDS).alias("_w"))
    ends = F.expr("transform(_w, x -> xxhash64(right(x, 3), 3))")
    hashed = split.select(*keep, "_rid", "_t", "_w", gram_hashes("_w", 1).alias("_p1"), gram_hashes("_w", 2).alias("_p2"), ends.alias("_p3"))
    return hashed.withColumn("_g", _grams(buckets))


def gram_weights(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, smooth: float = SMOOTH, most_labels: int = MOST_LABELS) -> DataFrame:
    """One row: ``weights``, an array of ``buckets`` log-likelihood ratios."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col(key).isNotNull()).select(F.col(key).alias("_good")).distinct()
    good = good.orderBy(F.xxhash64("_good"), "_good").limit(most_labels)
    own = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    marked = own.join(F.broadcast(good), F.col("_key") == F.col("_good"), "left").withColumn("_target", F.col("_good").isNotNull().cast("long"))
    each = _with_grams(marked, "_text", ["_target"], buckets).select("_rid", "_target", F.explode_outer("_g").alias("bucket")).where(F.col("bucket").isNotNull() & (F.col("_rid") >= 0))
    counts = cut(each.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_target").alias("target")), "gram-counts")
    raw, target = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    if not target:
        ratio = F.lit(0.0)
    else:
        ratio = F.log((F.col("target") + smooth) / (target + smooth * buckets)) - F.log((F.col("raw") + smooth) / (raw + smooth * buckets))
    # a dense array: buckets that no n-gram met weigh 0 and are never asked for
    every = docs.sparkSession.range(0, buckets, 1, 1).select(F.col("id").alias("bucket")).join(counts, "bucket", "left")
    pairs = every.agg(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce(ratio, F.lit(0.0)).alias("weight")))).alias("_s"))
    return cut(pairs.select(F.col("_s.weight").alias("weights")), "gram-weights")


def quality_digest(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, buckets: int = BUCKETS, threshold: float = THRESHOLD, with_row: bool = False) -> DataFrame:
    """One row a document: counts, the rules' verdict, score and whether it is kept."""
    # key columns in one: no name of the user's can clash
    docs_ = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or [key]]).alias("_id"), F.col(f"`{text}`").alias("_text"))
    # one value, fixed in size, held by the plan itself: no join, and no copy of it in each row
    weights = gram_weights(docs, labels, text, key, buckets).scalar()
    base = _with_grams(docs_, "_text", ["_id"], buckets).withColumn("_h", gram_hashes("_w", REPEAT_WINDOW)).withColumn("_h", F.expr(f"slice(_h, 1, greatest(size(_h) - {REPEAT_WINDOW - 1}, 0))"))
    base = base.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    repeated = F.expr(
        f"""CASE WHEN size(array_distinct(_h)) = size(_h) THEN 0L ELSE aggregate(
              transform(array(array_sort(transform(_h, (h, i) -> struct(h, i)))), s ->
                array_sort(transform(filter(s, (e, k) -> e.h = get(s, k - 1).h OR e.h = get(s, k + 1).h), e -> e.i)))[0],
              named_struct('n', 0L, 'end', 0),
              (acc, p) -> named_struct('n', acc.n + CAST(p + {REPEAT_WINDOW} - greatest(p, acc.end) AS BIGINT), 'end', p + {REPEAT_WINDOW}),
              acc -> acc.n) END"""
    )
    counted = base.select(
        "_id",
        "_rid",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("_t", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(F.size("_lines") - F.size(F.array_distinct("_lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        "_g",
        weights.alias("_weights"),
    )
    total = F.expr("aggregate(_g, 0D, (acc, b) -> acc + get(_weights, CAST(b AS INT)))")
    scored = counted.withColumn("score", F.when(F.size("_g") > 0, F.round(total / F.size("_g"), 9)).otherwise(0.0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return scored.select("_id.*", *(["_rid"] if with_row else []), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rejected ones; all columns stay.  Nothing is joined: columns ride along with the verdict."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    judged = quality_digest(own, labels.withColumn("_key", F.col(key)), "_text", "_key", ["_row"], with_row=True, **options)
    # a fresh row id beside the verdict keeps the filter above the folds: pushed below, it would hold them inlined, each as often as it is named
    return judged.withColumn("_last", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("_last") >= 0)).select("_row.*")
