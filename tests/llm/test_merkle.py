"""Merkle manifest against a plain one: nulls, ties, repeats, many groups, and buckets that are split to the last digit."""

import hashlib
import random
import zlib

from taskloom.llm import merkle


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(r):
    return digest("".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in merkle.FIELDS))


def lowered(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    trees = []
    for g in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        members = sorted(groups[g], key=lambda t: t[:3])
        trees.append((members, levels([t[2] for t in members])))
    top = levels([t[-1][0] for _, t in trees])
    root, out = top[-1][0], []
    for at, (members, own) in enumerate(trees):
        for i, (known, _, node, r) in enumerate(members):
            path = []
            for tree, j in ((own, i), (top, at)):
                for x in tree[:-1]:
                    b = j // 8 * 8
                    path.append(("".join(x[b:j]), "".join(x[j + 1 : b + 8])))
                    j //= 8
            h = leaf({**r, "text": lowered(r["text"])}) if known and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 else node
            for a, b in path:
                h = digest(a + h + b)
            out.append((r["doc_id"], node, own[-1][0], root, digest("".join(a + b for a, b in path)), h, h == root))
    return sorted(out, key=str)


def test_manifest_against_plain(spark):
    rng = random.Random(3)
    ids = [None, 1, 1, 1, 5, 70000, -9, 2**62, -(2**63)]
    langs = [None, "", "en", "=x", "en\0", "zz", *map(str, range(12))]
    rows = [(rng.choice(ids), rng.choice([None, "", "A b", "é" * 5]), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, 3]), i, "x") for i in range(160)]
    # one language of over 4,096 leaves: two rounds of blocks
    rows += [(i * 37, f"T {i}", "long", "s", 3, i, "x") for i in range(4500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank long, `key` string").repartition(5)
    want = plain([r.asDict() for r in docs.collect()])
    assert sorted(map(tuple, merkle.verified(docs).collect()), key=str) == want
    small = docs.where("lang is null or lang != 'long'")
    want = plain([r.asDict() for r in small.collect()])
    # equal rows over the bound are told apart by their last digit
    assert sorted(map(tuple, merkle.verified(small, most=8).collect()), key=str) == want


def test_manifest_of_nothing_and_of_one(spark):
    docs = spark.createDataFrame([(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle.verified(docs.limit(0)).collect() == []
    (one,) = merkle.verified(docs).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root == digest("-----") and one.proof_sha256 == digest("") and one.verified
