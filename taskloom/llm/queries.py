"""The queries of the numbered operators over the driver's tables, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontaminate, html_text, licenses, merkle, piece_codec, quality, secrets, sharding, simhash, token_counts, token_store


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark, sf_dir):
    return licenses.license_digest(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontaminate.contamination_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_sentencepiece(spark, sf_dir):
    return piece_codec.round_trip(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_token_store(spark, sf_dir):
    return token_store.token_store(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_quality_rules(spark, sf_dir):
    return quality.quality_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_sharding(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_secret_scan(spark, sf_dir):
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


def op10_chat_format(spark, sf_dir):
    says = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id bigint, turn bigint, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    words = vocabulary("byte_bpe_50k.json")
    return chat.read_conversations(chat.pack_conversations(rows, words), words).drop("pack")


def op11_alignment(spark, sf_dir):
    return align.align_digest(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_html_text(spark, sf_dir):
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.verified(_table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_decontamination, op3_sentencepiece, op4_token_store, op5_quality_rules, op6_sharding, op7_simhash, op8_token_counts, op9_secret_scan, op10_chat_format, op11_alignment, op12_html_text, op13_merkle_manifest, pipeline)}

_W = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _merkle_sql(doc_levels: int = 8, group_levels: int = 4) -> str:
    """Levels written out, each a grouping of eight: enough for 8**8 documents a language and 8**4 languages."""

    def field(c):
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def leaf(text):
        return "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"

    def levels(name, n):
        """name0 (g, r, h): level after level, with the siblings of each node; a lone node stays as it is."""
        out = []
        for k in range(n):
            run = "PARTITION BY g, r // 8 ORDER BY r ROWS BETWEEN"
            out.append(
                f"{name}{k}s AS (SELECT *, count(*) OVER (PARTITION BY g) > 1 AS more, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, "
                f"coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k})"
            )
            out.append(f"{name}{k + 1} AS (SELECT g, r // 8 AS r, CASE WHEN any_value(more) THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h FROM {name}{k}s GROUP BY 1, 2)")
        return out

    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda s, c: list_reduce([xor(s, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"l AS (SELECT doc_id, lang, {leaf('text')} AS h, CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS t FROM documents)",
        "own AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS r FROM l)",
        "d0 AS (SELECT g, r, h FROM own)",
        *levels("d", doc_levels),
        f"t0 AS (SELECT 0 AS g, g AS r, h FROM d{doc_levels})",
        *levels("t", group_levels),
        f"f0 AS (SELECT o.doc_id, o.g, o.r, o.h AS leaf, s.h AS subroot, z.h AS root, o.t AS f, '' AS p FROM own o JOIN d{doc_levels} s USING (g), t{group_levels} z)",
    ]
    steps = [(f"d{k}s", "f.g = s.g AND f.r // {} = s.r".format(8**k)) for k in range(doc_levels)] + [(f"t{k}s", "f.g // {} = s.r".format(8**k)) for k in range(group_levels)]
    for i, (table, on) in enumerate(steps):
        parts.append(f"f{i + 1} AS (SELECT f.doc_id, f.g, f.r, leaf, subroot, root, CASE WHEN more THEN sha256(s.b || f || s.a) ELSE f END AS f, CASE WHEN more THEN p || s.b || s.a ELSE p END AS p FROM f{i} f JOIN {table} s ON {on})")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{len(steps)}"


ORACLE_SQL = {
    "op13_merkle_manifest": _merkle_sql(),
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_W.format(_LOWER)} AS w FROM documents),
b AS (SELECT item_id, {_W.format(_LOWER)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS l, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
        FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT l FROM win),
place AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS g
          FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)),
hit AS (SELECT p.doc_id, p.i, p.l, win.item_id FROM place p JOIN win ON p.g = win.g AND p.l = win.l),
wordhit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS k FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS s FROM hit GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN wordhit USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
