"""Cases beside the main comparisons: blocks, labels, cut edges, kinds of secrets, budgets, keyed access, names, empty tables."""

import base64
import json
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taskloom.llm import chat, decontaminate, licenses, piece_codec, quality, secrets, sharding, simhash, token_counts, token_store
from taskloom.llm.queries import vocabulary

WORDS = vocabulary("byte_bpe_50k.json")


def letters(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


@pytest.fixture(scope="module")
def licensed(spark):
    rng = random.Random(8)
    texts = [None, "", "cc by", "all rights reserved all rights reserved"]
    for text, _ in licenses.NOTICES:
        w = text.split()
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(len(v))] = rng.choice(["x", "odd", ""])
            texts.append("Some words. " + " ".join(v) + " and more, " + rng.choice(["", "CC-BY.", text]))
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()


def test_license_labels_and_scores(licensed):
    texts, docs = licensed
    templates = [(x, t.split(), True) for t, x in licenses.PHRASES] + [(x, t.split(), False) for t, x in licenses.NOTICES]
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.license_digest(docs).collect()}
    blocks = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.license_digest(docs, block=7).collect()}
    for i, t in enumerate(texts):
        w, found = letters(t), []
        for label, own, exact in templates:
            k = min(licenses.GRAM, len(own))
            lines = {}
            for p in range(len(w) - k + 1):
                for q in range(len(own) - k + 1):
                    if w[p : p + k] == own[q : q + k]:
                        lines.setdefault(p - q, []).append((p, q))
            groups = []
            for d in sorted(lines):
                if groups and not exact and d - groups[-1][0] <= licenses.GAP:
                    groups[-1] = (d, groups[-1][1] + lines[d])
                else:
                    groups.append((d, list(lines[d])))
            for _, hits in groups:
                score = len({q + j for _, q in hits for j in range(k)}) / len(own)
                span = max(p for p, _ in hits) + k - min(p for p, _ in hits)
                if score == 1 if exact else score >= licenses.COVER and span <= 2 * len(own):
                    found.append((label, score))
        assert got[i] == blocks[i] == (",".join(sorted({x for x, _ in found})), round(max((s for _, s in found), default=0), 9)), t


def test_decontamination_by_blocks(spark, licensed):
    _, docs = licensed
    bench = spark.createDataFrame([(1, licenses.NOTICES[2][0]), (2, licenses.NOTICES[7][0]), (3, "cc by"), (None, "odd")], "item_id long, text string")
    rows = lambda n: sorted(map(tuple, decontaminate.contamination_digest(docs, bench, block_bytes=n).collect()))
    assert rows(300) == rows(10**9) and any(r[2] for r in rows(10**9))


def test_sharding_cuts_no_group_that_fits(spark):
    rng = random.Random(4)
    texts = [f"t{rng.choice([0, 1, rng.randrange(150)])}" for _ in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.shard for r in sharding.shard_documents(docs, n_shards=6).collect()}
    where = {}
    for k, t in enumerate(texts):
        where.setdefault(t, []).append(rows[k])
    room = len(texts) // 6
    # cut edges of a star from each group's main shard; groups larger than a shard can't do better than whole shards
    cut = sum(len(s) - max(s.count(x) for x in set(s)) for s in where.values())
    least = sum(max(0, len(s) - room) for s in where.values())
    assert cut <= least + 6 * max(len(s) for s in where.values() if len(s) <= room)
    assert sum(len(set(s)) > 1 for s in where.values() if len(s) <= room) < 6


def test_secret_kinds():
    body = "aB3" * 10
    npm = "npm_" + body + secrets._base62(zlib.crc32(body.encode()))
    head = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt, odd = f"{head({'alg': 'HS256'})}.{head({'sub': 1})}.c2ln", f"{head({'typ': 'x'})}.{head({'sub': 1})}.c2ln"
    kinds = lambda t: [k for *_, k in secrets.find(t) if k not in secrets.BASE]
    assert kinds(f"a {npm} b {jwt} c") == ["npm", "jwt"] and kinds(f"{npm[:-1]}0 {odd}") in ([], ["npm"])
    assert secrets.find("eyJ" * 40_000 + " " + jwt)[-1][2] == "jwt"  # linear in a run without a dot


def test_budgets(spark):
    lib = Tokenizer.from_file(WORDS)
    texts = ["it's <|endoftext|> you're  \n\n here", None, "", "word\n" * 20_000, "漢字 и  ещё"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for budget in (0, 1, 5):
        for r in token_counts.truncate(docs, WORDS, budget).collect():
            t = texts[r.doc_id] or ""
            n = lambda s: len(lib.encode(s, add_special_tokens=False).ids)
            assert t.startswith(r.text) and n(r.text) == r.n_tokens <= budget
            assert all(n(t[:p]) > budget for p in range(len(r.text) + 1, min(len(t), len(r.text) + 60) + 1))
    with pytest.raises(ValueError):
        token_counts.truncate(docs, WORDS, -1)


def test_keyed_access_to_repeated_ids(spark, tmp_path):
    docs = spark.createDataFrame([(5, "a b"), (5, "c"), (5, "a b"), (6, None), (None, "z")], "doc_id long, text string")
    token_store.write_blocks(docs, WORDS, str(tmp_path / "t"))
    got = token_store.get(spark, str(tmp_path / "t"), [5, 6, 7])
    lib = Tokenizer.from_file(WORDS)
    ids = lambda t: [*lib.encode(t, add_special_tokens=False).ids, token_store.END]
    assert sorted(got[5]) == sorted([ids("a b"), ids("a b"), ids("c")]) and got[6] == [[token_store.END]] and 7 not in got
    with pytest.raises(TypeError):
        token_store.write_blocks(docs.withColumn("doc_id", F.col("doc_id").cast("string")), WORDS, str(tmp_path / "s"))


def test_names_and_empty_tables(spark):
    columns = ["_row", "_key", "_th", "_bk", "_text", "_id", "_rid", "_w", "pos", "len", "h", "n_words", "shard", "fp"]
    docs = spark.createDataFrame([(k, f"w{k} " * 3 + " ".join(f"v{k}x{j}" for j in range(30)), *["c"] * len(columns)) for k in (1, 2, 2, None)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in columns))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "v2x1 v2x2")], "item_id long, text string")
    piece = vocabulary("piece_bpe_32k.model")
    whole = [lambda d: quality.keep_good(d, labels), lambda d: decontaminate.remove_contaminated(d, bench), lambda d: decontaminate.remove_spans(d, bench), simhash.keep_one, secrets.redact]
    for f in whole:
        out = f(docs)
        assert out.columns == docs.columns
        r = out.where("doc_id = 1").collect()
        assert len(r) == 1 and all(r[0][c] == "c" for c in columns)
        assert f(docs.limit(0)).count() == 0
    assert decontaminate.remove_contaminated(docs, bench).where("doc_id = 2").count() == 0 and simhash.keep_one(docs).count() == 3
    digests = [licenses.license_digest, lambda d: decontaminate.contamination_digest(d, bench), lambda d: piece_codec.round_trip(d, piece), lambda d: token_store.token_store(d, WORDS), lambda d: quality.quality_digest(d, labels),
               sharding.shard_documents, simhash.near_duplicates, lambda d: token_counts.token_counts(d, WORDS), secrets.secret_digest]
    for f in digests:
        assert f(docs).count() == 4 and f(docs.limit(0)).count() == 0
    assert quality.quality_digest(docs, labels.limit(0)).where("kept").count() == 4
    talk = spark.createDataFrame([(None, None, None, None, "x")], "conv_id long, turn long, role string, text string, pack string")
    assert [tuple(r)[:2] for r in chat.read_conversations(chat.pack_conversations(talk, WORDS), WORDS).collect()] == [(None, 1)]
