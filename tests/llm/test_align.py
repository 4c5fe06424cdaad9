"""Alignment against a plain two-pointer one over the libraries' tokens."""

import collections
import hashlib

import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taskloom.llm import align
from taskloom.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
ODD = [
    (1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "  two   spaces <|endoftext|> <s> </s> <0x41>\n\n\tx"), (5, "x\x00y é́ \U0001F600 日本語"),
    (None, "hello hello"), (6, "　  z\x1cq"), (7, " " * 300), (7, "x" + "\n " * 3_000 + "y"), (8, "a" * 5000), (None, None), (9, "It's the end, isn't it? " * 40),
]


def plain(rows):
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}

    def ends(xs):
        at, out = 0, {}
        for k, x in enumerate(xs):
            at += len(x)
            out[at] = k
        return out

    docs, counts = [], collections.Counter()
    for key, text in rows:
        docs.append((key, [], [], [], []))
        if not text:
            continue
        ids, b_ids = lib.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        one = [bytes(back[c] for c in lib.id_to_token(i)) for i in ids]
        two = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if not b"".join(one) == b"".join(two) == (" " + text).encode():
            continue
        a_end, b_end = ends(one), ends(two)
        a_at = b_at = 0
        groups, links = [], []
        for e in sorted(set(a_end) & set(b_end)):
            groups.append((ids[a_at : a_end[e] + 1], b_ids[b_at : b_end[e] + 1]))
            links.append((ids[a_end[e]], b_ids[b_end[e]]))
            a_at, b_at = a_end[e] + 1, b_end[e] + 1
        counts.update(links)
        docs[-1] = (key, ids, b_ids, groups, links)
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    shown = [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d[3]) for d in docs]
    digests = [hashlib.sha256(s.encode()).hexdigest() if d[1] else "" for s, d in zip(shown, docs)]
    return sorted(((k, len(i), len(b), len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), s) for (k, i, b, g, x), s in zip(docs, digests)), key=str), docs


def test_digest_against_plain(spark):
    docs = spark.createDataFrame([(k, t, 0, "x") for k, t in ODD], "doc_id long, text string, links int, _rid string")
    assert sorted(map(tuple, align.align_digest(docs, A, B).collect()), key=str) == plain(ODD)[0]
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, align.align_digest(table, A, B).collect()), key=str) == plain([tuple(r) for r in table.collect()])[0]
    assert align.align_digest(docs.limit(0), A, B).collect() == []


def test_groups_and_links(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(ODD)], "doc_id long, text string")
    made = align.aligned(align.tokens(docs, A, B)).select("doc_id", align.groups().alias("groups"), align.links().alias("links"))
    want = {i: d for i, d in enumerate(plain(ODD)[1])}
    for r in made.collect():
        assert [(g.a, g.b) for g in r.groups] == want[r.doc_id][3]
        assert [(c // align.SHIFT, c % align.SHIFT) for c in r.links] == want[r.doc_id][4]
    pairs = align.pair_counts(made)
    assert pairs.count() <= align.most_pairs(A, B)
    assert pairs.groupBy((F.col("code") % align.SHIFT).alias("b")).agg(F.max(F.col("best").cast("int")).alias("x")).where("x = 0").count() == 0
