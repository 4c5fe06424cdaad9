"""License scan by diagonal voting, on built-in functions only.

Every rolling word k-gram of every document is hashed and joined to the k-grams of the license
templates.  A hit at document word ``p`` and template word ``t`` votes for the diagonal ``p - t``.
Votes are gathered by diagonal, neighbouring diagonals of the same template are merged (a dropped or
added word shifts the diagonal), and a merged span counts if its grams, which were compared as words and
not only as hashes, cover enough of the template.

Templates are broadcast ``BLOCK_GRAMS`` places at a time, each block to a scan of its own: one for any usual list; ahead
of several, rows are numbered and stored once, so that votes of all scans meet whatever order the source has.
Only rows whose hash is in the table leave a scan; one extra row a document, which takes no part in the join, carries
its word count from the first scan, so that documents without hits stay in the result.

Defined results: null or empty text has no words and no spans; repeated rows are judged each on its own
(also with equal or null ids); no documents give no rows; equal diagonals tie by template order; extra columns of any
name are ignored.  One document's votes are held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import cut
from .text import LETTER_WORDS, ascii_lower, gram_hashes, joined, words

#: Exact phrases and their labels: fixed values.
PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]
#: License notices, matched approximately, and their labels.
NOTICES = [
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
GRAM = 4
#: Diagonals this far apart or nearer are merged.
GAP = 2
#: Share of a notice's words that verified grams must cover.
COVER = 0.8
#: Template places that are broadcast to one scan (about 100 bytes each).
BLOCK_GRAMS = 200_000
_MARK = -1


def template_grams(phrases=PHRASES, notices=NOTICES, gram: int = GRAM) -> tuple[list[tuple], list[int]]:
    """Template places with their k-gram's words, and the gram lengths in use."""
    rows = [(i, label, text.split(), exact) for i, (text, label, exact) in enumerate([(t, x, True) for t, x in phrases] + [(t, x, False) for t, x in notices])]
    lengths = sorted({min(gram, len(w)) for _, _, w, _ in rows})
    flat = []
    for i, label, w, exact in rows:
        k = min(gram, len(w))
        flat += [(i, label, exact, len(w), k, lengths.index(k), t, w[t : t + k]) for t in range(len(w) - k + 1)]
    return flat, lengths


def _table(spark: SparkSession, flat: list[tuple], lengths: list[int]) -> DataFrame:
    made = spark.createDataFrame(flat, "template int, label string, exact boolean, t_len int, k int, k_index int, t_pos int, gram array<string>")
    # the same fold over words as in gram_hashes
    hashed = F.lit(None).cast("long")
    for k in lengths:
        hashed = F.when(F.col("k") == k, F.expr("xxhash64(" + ", ".join(f"get(gram, {j})" for j in range(k)) + ")")).otherwise(hashed)
    return made.select("template", "label", "exact", "t_len", "k", "k_index", "t_pos", F.array_join("gram", " ").alias("gram"), hashed.alias("h"))


def _hits(docs: DataFrame, text: str, key: list[str], phrases, notices, gram: int, block: int) -> DataFrame:
    """Verified votes, and one row of template -1 a document (from the first scan)."""
    flat, lengths = template_grams(phrases, notices, gram)
    base = docs.select(F.monotonically_increasing_id().alias("_rid"), F.struct(*[F.col(f"`{c}`") for c in key]).alias("_id"), F.col(f"`{text}`").alias("_body"))
    if len(flat) > block:
        # a row's number is its place in a scan, which another scan may not repeat: numbers are stored before the scans
        base = cut(base, "numbered")
    base = base.select("_rid", "_id", words(ascii_lower(F.col("_body")), LETTER_WORDS).alias("_w"))
    out = None
    for b in range(0, max(1, len(flat)), block):
        table = F.broadcast(_table(docs.sparkSession, flat[b : b + block], lengths))
        # the place after all others is the document's own row: it has no hash and needs none
        own = [F.array(F.lit(None).cast("long"))] if b == 0 else []
        rows = base.select("_rid", "_id", "_w", F.size("_w").alias("_n"), F.concat(*[gram_hashes("_w", k) for k in lengths], *own).alias("_h"))
        each = rows.select("_rid", "_id", "_w", "_n", F.posexplode_outer("_h").alias("_p", "h"))
        met = each.join(table, "h", "left").where(F.col("template").isNotNull() | F.col("h").isNull()) if own else each.join(table, "h")
        met = met.withColumn("_pos", F.col("_p") - F.col("_n") * F.col("k_index"))
        met = met.where(F.col("h").isNull() | (F.array_join(F.expr("slice(_w, greatest(_pos, 0) + 1, k)"), " ") == F.col("gram")))
        met = met.select(
            "_rid", "_id", F.col("_n").cast("long").alias("_n"), F.coalesce("template", F.lit(_MARK)).alias("template"), "label", F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("t_len", F.lit(0)).alias("t_len"),
            F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("t_pos", F.lit(0)).alias("t_pos"), F.coalesce("_pos", F.lit(0)).alias("_pos"), F.coalesce(F.col("_pos") - F.col("t_pos"), F.lit(0)).alias("_diag"),
        )
        out = met if out is None else out.unionByName(met)
    return out


def license_spans(docs: DataFrame, text: str = "text", key: list[str] | None = None, *, phrases=PHRASES, notices=NOTICES, gram: int = GRAM, gap: int = GAP, cover: float = COVER, block: int = BLOCK_GRAMS) -> DataFrame:
    """Spans (``_rid``, ``_id`` with the key columns, template, label, exact, first_word, end_word, score), and a row with template -1 for each document."""
    hits = _hits(docs, text, key or ["doc_id"], phrases, notices, gram, block).repartition("_rid")
    own = ["_rid", "_id", "_n", "template", "label", "exact", "t_len", "k"]
    lines = hits.groupBy(*own, "_diag").agg(F.collect_set("t_pos").alias("_t"), F.min("_pos").alias("_from"), F.max("_pos").alias("_to"))
    by = W.partitionBy("_rid", "template").orderBy("_diag")
    apart = F.col("exact") | (F.col("_diag") - F.lag("_diag").over(by) > gap)
    lines = lines.withColumn("_new", F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).withColumn("_group", F.sum("_new").over(by))
    spans = lines.groupBy(*own, "_group").agg(F.flatten(F.collect_list("_t")).alias("_t"), F.min("_from").alias("first_word"), (F.max("_to") + F.max("k")).alias("end_word"))
    covered = F.size(F.array_distinct(F.expr("flatten(transform(_t, p -> sequence(p, p + greatest(k, 1) - 1)))")))
    spans = spans.withColumn("score", F.when(F.col("template") == _MARK, 0.0).otherwise(covered / F.greatest("t_len", F.lit(1))))
    good = F.when(F.col("exact"), F.col("score") == 1.0).otherwise((F.col("score") >= cover) & (F.col("end_word") - F.col("first_word") <= 2 * F.col("t_len")))
    return spans.where((F.col("template") == _MARK) | good).select("_rid", "_id", F.col("_n").alias("n_words"), "template", "label", "exact", F.col("first_word").cast("long").alias("first_word"), F.col("end_word").cast("long").alias("end_word"), "score")


def license_digest(docs: DataFrame, text: str = "text", key: list[str] | None = None, **options) -> DataFrame:
    """One row a document: exact phrases' places and labels, and all labels with the best score."""
    spans = license_spans(docs, text, key, **options)
    base = F.col("exact")
    return spans.groupBy("_rid", "_id").agg(
        F.max("n_words").alias("n_words"),
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.least(F.lit(1.0), F.max("score")).alias("score"),
    ).select("_id.*", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
