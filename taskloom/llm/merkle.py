"""Merkle manifest of a dataset: a trie of base-8 rank digits over the documents of each group, and one over the groups.

A document is a leaf: the SHA-256 of its fields (``-`` for null, else UTF-8 length, ``:`` and value).  In a group (a
language) leaves stand by id; every eight consecutive nodes become their hash until one is left, the group's subroot.
Subroots, in order of group, become the root likewise.  Ranks come from digit histograms (``ranks``).  Nodes are keyed by
their rank digits and reduced from the longest prefix: four digits at once, up to 4,096 nodes a block, so the tree of
30 billion documents takes three rounds.  Proofs go down again: a block hands each node the siblings of all levels above,
so no proof is ever shuffled for a single document.

Defined results: a null group is a group of its own and comes first; null ids come first in their group; equal ids go by
leaf, and rows equal in all fields take consecutive places; a group of one leaf has that leaf as its subroot and no
siblings below it; empty texts count as ``0:``; no documents give no rows; columns beside the fields are ignored, whatever
their names.  A text of any length is one SHA-256 and held by one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import BITS, MOST, ranked
from .scratch import cut
from .text import ascii_lower

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT_BITS = 3
FANOUT = 1 << FANOUT_BITS
#: Levels that one block reduces: 4,096 nodes.
STEPS = 4
BLOCK_BITS = FANOUT_BITS * STEPS
#: A document is tampered with where this divides the CRC-32 of its decimal id.
TAMPER = 3
_NO_ID = -(1 << 52)
_LEVELS = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(fields: Sequence[str], changed: dict[str, Column] | None = None) -> Column:
    """The leaf of a row; ``changed`` puts other values in place of fields."""
    return hashed(*[field((changed or {}).get(f, F.col(f"`{f}`"))) for f in fields])


def _halved(level: str, k: int) -> tuple[str, str]:
    """SQL of the siblings before and after the node above leaf ``i``, ``k`` levels up, joined."""
    at = f"shiftright(i, {FANOUT_BITS * k})"
    begin = f"shiftleft(shiftright(i, {FANOUT_BITS * (k + 1)}), {FANOUT_BITS})"
    return f"array_join(slice({level}, {begin} + 1, {at} - {begin}), '')", f"array_join(slice({level}, {at} + 2, {begin} + {FANOUT} - 1 - {at}), '')"


def _blocks(nodes: DataFrame, depths: DataFrame, done: int, more: Sequence[str]) -> DataFrame:
    """Blocks of ``nodes`` (group, rank, node, more): group, block, items in order of rank, the ``h`` levels inside and their top node.

    ``depths`` (group, depth): levels of each group's tree, ``done`` of which lie below."""
    each = nodes.join(depths, "group").where(F.col("depth") >= done)
    cells = each.groupBy("group", F.shiftright("rank", BLOCK_BITS).alias("block"), F.least(F.lit(STEPS), F.col("depth") - done).alias("h"))
    out = cells.agg(F.array_sort(F.collect_list(F.struct("rank", "node", *more))).alias("items")).withColumn("x0", F.col("items.node"))
    for k in range(STEPS):
        level = f"transform(sequence(0, (size(x{k}) - 1) div {FANOUT}), i -> sha2(cast(array_join(slice(x{k}, i * {FANOUT} + 1, {FANOUT}), '') as binary), 256))"
        out = out.withColumn(f"x{k + 1}", F.when(F.col("h") > k, F.expr(level)))
    return out.withColumn("top", F.get(F.coalesce(*[F.col(f"x{k}") for k in range(STEPS, -1, -1)]), F.lit(0)))


def grow(nodes: DataFrame, depths: DataFrame, deepest: int, more: Sequence[str], label: str) -> tuple[list[DataFrame], DataFrame]:
    """All rounds of blocks over ``nodes``, each stored, and (group, top) of every group."""
    rounds, done = [], 0
    while True:
        rounds.append(cut(_blocks(nodes, depths, done, more if not done else ()), label))
        done += STEPS
        if deepest <= done:
            break
        nodes = rounds[-1].join(depths.where(F.col("depth") > done).select("group"), "group", "left_semi").select("group", F.col("block").alias("rank"), F.col("top").alias("node"))
    # a group's last round has one block
    last = [r.join(depths.where((F.col("depth") > t * STEPS) & (F.col("depth") <= (t + 1) * STEPS) | ((F.col("depth") == 0) & F.lit(t == 0))), "group").select("group", "top") for t, r in enumerate(rounds)]
    return rounds, reduce(DataFrame.unionByName, last)


def proofs(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(group, item, levels): for each item of the first round the siblings before and after it, level by level to the root.

    ``above`` (group, up): the levels above each group's own tree."""
    ups = None
    for t in range(len(rounds) - 1, -1, -1):
        own = rounds[t].withColumn("own", F.lit(None).cast(_LEVELS))
        if ups is not None:
            own = own.drop("own").join(ups.select("group", F.col("rank").alias("block"), F.col("levels").alias("own")), ["group", "block"], "left")
        # a block that no further round took is its group's last
        own = own.join(above, "group").withColumn("up", F.coalesce("own", "up"))
        parts = ", ".join(f"if(h > {k}, array(named_struct('before', {b}, 'after', {a})), cast(array() as {_LEVELS}))" for k in range(STEPS) for b, a in [_halved(f"x{k}", k)])
        each = F.expr(f"transform(items, (item, i) -> named_struct('item', item, 'levels', concat({parts}, up)))")
        out = own.select("group", F.inline(each))
        ups = out.select("group", F.col("item.rank").alias("rank"), "levels")
    return out


def _depths(counts: DataFrame) -> DataFrame:
    """Levels until one node is left: the base-8 digits of the last rank; none for a lone node."""
    return counts.select("group", F.when(F.col("n") <= 1, 0).otherwise(F.length(F.conv((F.col("n") - 1).cast("string"), 10, FANOUT))).alias("depth"))


def _tree(rows: DataFrame, order: list[str], more: Sequence[str], label: str, most: int) -> tuple[list[DataFrame], DataFrame]:
    counts = rows.groupBy("group").agg(F.count("*").alias("n"))
    depths = cut(_depths(counts), f"{label}-depths")
    deepest = depths.agg(F.max("depth")).first()[0] or 0
    return grow(ranked(rows, order, most), depths, deepest, more, label)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", changed: Column | None = None, most: int = MOST) -> DataFrame:
    """One row a document: ``key``, leaf, changed (the leaf ``changed`` gives, a second claim about the row), subroot, root, levels.

    ``levels`` holds the siblings before and after the document's node on each level up to the root, digests as hex text."""
    own = docs.select(
        F.monotonically_increasing_id().alias("_rid"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("group"),
        F.col(f"`{key}`").alias("id"),
        leaf(fields).alias("node"),
        (F.lit(None).cast("string") if changed is None else changed).alias("changed"),
    )
    # a null id stands below all others; the key goes on from the id's last bits to the leaf, then to the row
    own = own.withColumn("place", F.coalesce(F.shiftright(F.col("id").cast("long"), BITS), F.lit(_NO_ID)))
    low = F.coalesce(F.lpad(F.hex(F.col("id").cast("long").bitwiseAND((1 << BITS) - 1)), 4, "0"), F.lit("0000"))
    rows = cut(own.withColumn("key", F.concat(low, "node", F.lpad(F.hex("_rid"), 16, "0"))), "merkle-leaves")
    rounds, subroots = _tree(rows, ["id", "node", "_rid"], ["id", "changed"], "merkle-docs", most)
    # groups are ranked by their first six bytes, then by the rest
    bytes_ = F.hex(F.col("name").cast("binary"))
    names = subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("top").alias("node"))
    names = cut(names.withColumn("place", F.conv(F.rpad(F.substring(bytes_, 1, 12), 12, "0"), 16, 10).cast("long")).withColumn("key", bytes_), "merkle-groups")
    tops, root = _tree(names, ["name"], ["name"], "merkle-root", most)
    over = proofs(tops, root.select("group", F.lit(None).cast(_LEVELS).alias("up")).withColumn("up", F.coalesce("up", F.array().cast(_LEVELS))))
    over = over.join(F.broadcast(root.withColumnRenamed("top", "root")), "group")
    over = cut(over.select(F.col("item.name").alias("group"), F.col("item.node").alias("subroot"), F.col("levels").alias("up"), "root"), "merkle-above")
    each = proofs(rounds, over.select("group", "up"))
    return each.join(over.drop("up"), "group").select(F.col("item.id").alias(key), F.col("item.node").alias("leaf"), F.col("item.changed").alias("changed"), "subroot", "root", "levels")


def folded(leaf_: str, levels: str = "levels") -> Column:
    """The root that a leaf and the siblings of all levels give."""
    return F.expr(f"aggregate({levels}, {leaf_}, (h, s) -> sha2(cast(concat(s.before, h, s.after) as binary), 256))")


def tampered(fields: Sequence[str] = FIELDS, key: str = "doc_id", text: str = "text") -> Column:
    """The leaf of a row whose text lost its capitals, for ids that ``TAMPER`` picks; null for all others and for null ids."""
    pick = F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % TAMPER == 0
    return F.when(pick, leaf(fields, {text: ascii_lower(F.col(f"`{text}`"))}))


def verified(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", most: int = MOST) -> DataFrame:
    """The manifest held against the table after tampering: leaf, subroot, root, proof digest, the root that the leaf at hand folds to, and whether that is the root."""
    all_ = manifest(docs, fields, key, group, tampered(fields, key), most)
    proof = F.sha2(F.expr("array_join(transform(levels, s -> concat(s.before, s.after)), '')").cast("binary"), 256)
    out = all_.select(F.col(f"`{key}`"), "leaf", "subroot", "root", proof.alias("proof_sha256"), folded("coalesce(changed, leaf)").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
