"""Benchmark decontamination with a broadcast hash set of normalised n-grams, on built-in functions only.

Benchmark texts are cut into windows of ``n`` words (a shorter item is one window).  Each document place
is first probed with the hash of its next two words against the windows' openings, so that only a few
places go on to the full n-gram hash; hits are compared as words, not only as hashes.

The set is dealt by hash over blocks of about ``BLOCK_BYTES``, by its measured size, and each block is broadcast
to a scan of its own: one block, so one scan, for any benchmark of usual size, and a scan more for each further
block.  Ahead of several scans rows are numbered and stored once (one write of the texts), so that hits of all scans
meet whatever order the source has.  Documents are never shuffled by their words at any size.  What leaves a scan is a
row of length 0 for each document (from the first scan) and the verified hits, both without the words.

Defined results: null or empty text has no words, no hits and is clean; items without words have no
windows; items with a null id hit but are not listed; repeated rows (also with equal or null ids) are
judged each on its own; equal windows of several items count once and list all of them; with an empty
benchmark every document is clean; no documents give no rows.  Columns of any name may stand beside the text.
One document's hits, and one window's list of items, are held whole by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import cut
from .text import LETTER_WORDS, ascii_lower, gram_hashes, words

WINDOW = 13
#: A document is contaminated if hit words are at least one in so many.
SHARE = 20
#: Bytes of windows that are broadcast to one scan.
BLOCK_BYTES = 32_000_000
#: What a window takes beside its words and item ids.
_ROW = 100


def benchmark_windows(benchmark: DataFrame, text: str = "text", item: str = "item_id", n: int = WINDOW) -> DataFrame:
    """Distinct windows: length, words joined by a space, hash, opening hash and the items that have them."""
    w = benchmark.select(F.col(item).cast("string").alias("_item"), words(ascii_lower(F.col(text)), LETTER_WORDS).alias("_w")).where(F.size("_w") > 0)
    w = w.select("_item", "_w", F.least(F.lit(n), F.size("_w")).alias("len"))
    each = w.select("_item", "len", F.explode(F.expr("transform(sequence(0, size(_w) - len), i -> slice(_w, i + 1, len))")).alias("_g"))
    return each.groupBy(F.array_join("_g", " ").alias("window"), "len").agg(
        F.collect_set("_item").alias("items"),
        F.first(F.xxhash64("_g")).alias("h"),
        F.first(F.expr("if(len = 1, xxhash64(get(_g, 0)), xxhash64(get(_g, 0), get(_g, 1)))")).alias("opening"),
    )


def contamination_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: list[str] | None = None, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Places where a window occurs, and one row of length 0 a document: ``_rid``, ``_id`` (struct of the key columns), n_words, pos, len, items."""
    spark = docs.sparkSession
    found = cut(benchmark_windows(benchmark, n=n), "windows")
    size = F.octet_length("window") + F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x)) + _ROW
    bytes_, single = found.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(F.col("len") == 1), F.lit(False))).first()
    blocks = max(1, -(-bytes_ // block_bytes))
    base = docs.select(F.monotonically_increasing_id().alias("_rid"), F.struct(*[F.col(f"`{c}`") for c in key or ["doc_id"]]).alias("_id"), F.col(f"`{text}`").alias("_body"))
    if blocks > 1:
        # a row's number is its place in a scan, which another scan may not repeat: numbers are stored before the scans
        base = cut(base, "numbered")
    base = base.select("_rid", "_id", words(ascii_lower(F.col("_body")), LETTER_WORDS).alias("_w"))
    kinds = [gram_hashes("_w", 2)] + ([gram_hashes("_w", 1)] if single else [])
    hits = None
    for b in range(blocks):
        table = found.where(F.pmod("h", F.lit(blocks)) == b) if blocks > 1 else found
        openings = F.broadcast(table.groupBy("opening").agg(F.collect_set("len").alias("lens")))
        table = F.broadcast(table.drop("opening"))
        # the place after all others is the document's own row: it has no opening and needs none
        own = [F.array(F.lit(None).cast("long"))] if b == 0 else []
        rows = base.select("_rid", "_id", "_w", F.size("_w").alias("_n"), F.concat(*kinds, *own).alias("_h"))
        each = rows.select("_rid", "_id", "_w", "_n", F.posexplode_outer("_h").alias("_p", "opening"))
        each = each.join(openings, "opening", "left").where(F.col("lens").isNotNull() | F.col("opening").isNull()) if own else each.join(openings, "opening")
        near = each.select("_rid", "_id", "_w", "_n", F.col("opening").isNull().alias("_own"), F.when(F.col("_n") == 0, 0).otherwise(F.expr("try_mod(_p, _n)")).alias("pos"), F.explode(F.coalesce("lens", F.array(F.lit(0)))).alias("len"))
        near = near.where(F.col("_own") | (F.col("pos") + F.col("len") <= F.col("_n"))).withColumn("h", F.when(~F.col("_own"), F.expr("xxhash64(slice(_w, pos + 1, len))")))
        met = near.join(table, ["h", "len"], "left").where(F.col("_own") | (F.array_join(F.expr("slice(_w, pos + 1, len)"), " ") == F.col("window")))
        met = met.select("_rid", "_id", F.col("_n").cast("long").alias("n_words"), F.when(F.col("_own"), 0).otherwise(F.col("pos")).alias("pos"), "len", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        hits = met if hits is None else hits.unionByName(met)
    return hits


def contamination_digest(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: list[str] | None = None, n: int = WINDOW, share: int = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: key columns, words, hit words, items with hits and the verdict."""
    hits = contamination_hits(docs, benchmark, text, key, n, block_bytes).repartition("_rid")
    before = W.partitionBy("_rid").orderBy("pos", "len").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("pos") + F.col("len")
    hits = hits.withColumn("_new", F.greatest(F.lit(0), end - F.greatest(F.col("pos"), F.coalesce(F.max(end).over(before), F.lit(0)))))
    out = hits.groupBy("_rid").agg(F.first("_id").alias("_id"), F.max("n_words").alias("n_words"), F.sum("_new").cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return out.select(
        "_id.*",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def _carried(docs: DataFrame, text: str, key: str) -> DataFrame:
    """All columns in one, beside id, text and the text's hash: no name of the user's can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"), F.xxhash64(f"`{text}`").alias("_th"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without contaminated documents; all columns stay.  Rows are told apart by id and text."""
    own = _carried(docs, text, key)
    bad = contamination_digest(own, benchmark, "_text", ["_key", "_th"], **options).where("contaminated").select(F.col("_key").alias("_bk"), F.col("_th").alias("_bh")).distinct()
    return own.join(bad, F.col("_key").eqNullSafe(F.col("_bk")) & (F.col("_th") == F.col("_bh")), "left_anti").select("_row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with every word inside a benchmark window cut out of the text, with what separates it from the word before."""
    own = _carried(docs, text, key)
    hits = contamination_hits(own, benchmark, "_text", ["_key", "_th"], n, block_bytes).where("len > 0")
    places = hits.groupBy(F.col("_id._key").alias("_bk"), F.col("_id._th").alias("_bh")).agg(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(pos, pos + len - 1)")))).alias("_hit"))
    joined = own.join(places, F.col("_key").eqNullSafe(F.col("_bk")) & (F.col("_th") == F.col("_bh")), "left")
    segments = F.regexp_extract_all("_text", F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$"), F.lit(0))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(_seg) - 1), _hit), i -> get(_seg, i)), '')")
    cut_ = joined.withColumn("_seg", segments).withColumn("_text", F.when(F.col("_hit").isNull(), F.col("_text")).otherwise(kept))
    return cut_.select(*[F.col("_text").alias(text) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
