"""Balanced label propagation: documents with equal texts gather in one shard, shards stay even.

Law ``rows``: shards' counts differ by one at most.

Documents are linked through their text (a star, never pairs).  As members of a group are alike, the state
is one row for each group with its counts by shard, which keeps a group of any size at ``n_shards`` counts.
Every round each group that has no shard yet asks for its best one (most members among shards with room for
all of it, else any with room), and a shard takes groups whole, larger ones first, while its room lasts.  Room
is what settled groups leave of a shard: rows of groups that are yet to settle don't count, as they leave in
the same move.  A round in which any group asks settles one at least, and the rounds end when none asks: then
no shard has room for any group that is left.  A group larger than a shard first fills whole shards, those
where it has most members, all at once; only its rest asks as the others do.
Quotas are kept by prefix sums over (size class, hash) buckets: a window over few bucket totals, and one
inside each bucket.  Groups that fit nowhere whole fill the largest rooms left, then documents without equals,
which are no nodes, fill up.  Each round is written to shared storage.

Groups of over a thousandth of all rows (fewer than a thousand of them, so their table may be broadcast)
are dealt over salted parts wherever their documents are ranked.

Defined results: null text has 8 bytes, crc 0 and the group of the empty text; null and repeated ids are
documents of their own; equal rows may swap places among themselves; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import cut, fresh_path

SHARDS = 24
HOT_SHARE = 1000
SALTS = 256
#: Hash parts of each size class that places are ranked by: totals are this many rows a class (64 classes at most), in
#: one task for each shard, at any number of documents.
PARTS = 4096


def _ranked(df: DataFrame, by: list[str], bucket: str, order: list, weight: str, out: str) -> DataFrame:
    """``out``: sum of ``weight`` over the rows of the same ``by`` that come before in (bucket, order)."""
    totals = df.groupBy(*by, bucket).agg(F.sum(weight).alias("_total"))
    ahead = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*by, bucket, F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_ahead"))
    inside = W.partitionBy(*by, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("_within", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(starts, [*by, bucket]).withColumn(out, F.col("_ahead") + F.col("_within")).drop("_ahead", "_within")


def _bucket(size: str, *of: str, parts: int):
    """Larger pieces first, then by hash: few enough totals, and each bucket a small share of the rows."""
    return F.concat(F.lpad((F.lit(99) - F.floor(F.log2(F.col(size)))).cast("string"), 2, "0"), F.lit("-"), F.lpad(F.pmod(F.xxhash64(*of), F.lit(parts)).cast("string"), 9, "0"))


def shard_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", n_shards: int = SHARDS) -> DataFrame:
    """One row a document: size, crc32 of the text, law, shard and gapless slot."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = cut(docs.select(F.col(key).alias("_key"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(body).alias("crc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h")), "shard-base")
    group = ["_h", "crc", "size"]  # 64-bit hash, checksum and length stand for the text
    groups = base.groupBy(*group).agg(F.count("*").alias("_all"))
    gid = F.struct(*group)
    n = base.count()
    hot = F.broadcast(groups.where(F.col("_all") * HOT_SHARE > n).select(*group, F.lit(SALTS).alias("_salts")))
    room = n // n_shards

    quota = [room + (j < n % n_shards) for j in range(n_shards)]
    spread = F.pmod(F.xxhash64("_key", "_h"), F.lit(n_shards)).cast("int")
    counts = base.select(*group, spread.alias("shard")).groupBy(*group, "shard").agg(F.count("*").alias("c"))
    member = F.struct("c", F.xxhash64(*group, "shard").alias("tie"), "shard")
    state = cut(counts.groupBy(*group).agg(F.sum("c").alias("_all"), F.collect_list(member).alias("_m")).where("_all > 1"), "shard-state")

    # groups larger than a shard (at most 2 * n_shards of them, or of n_shards rows) fill whole shards
    free, taken = list(quota), []
    for r in sorted(state.where(F.col("_all") > room).collect(), key=lambda r: (-r["_all"], r["_h"], r["crc"], r["size"])):
        rest, own = r["_all"], {m["shard"]: m["c"] for m in r["_m"]}
        for j in sorted(range(n_shards), key=lambda j: (-own.get(j, 0), j)):
            if 0 < free[j] == quota[j] <= rest:
                taken.append((r["_h"], r["crc"], r["size"], j, quota[j]))
                rest, free[j] = rest - quota[j], 0
    filled_up = base.sparkSession.createDataFrame(taken, counts.select(*group, "shard", "c").schema)
    gone = F.broadcast(filled_up.groupBy(*group).agg(F.sum("c").alias("_gone")))
    todo = state.join(gone, group, "left").withColumn("_all", F.col("_all") - F.coalesce("_gone", F.lit(0))).drop("_gone").where("_all > 0")

    path, done = fresh_path(base.sparkSession, "shard-rounds"), 0
    while True:
        left = F.array(*[F.lit(f).cast("long") for f in free])
        fits = lambda j: F.element_at(left, j + 1) >= F.col("_all")
        near = F.array_max(F.filter("_m", lambda m: fits(m["shard"])))["shard"]
        others = F.filter(F.array(*[F.lit(j) for j in range(n_shards)]), fits)
        other = F.when(F.size(others) > 0, F.element_at(others, (F.pmod(F.xxhash64(*group, F.lit(done)), F.size(others)) + 1).cast("int")))
        asks = todo.withColumn("to", F.coalesce(near, other)).withColumn("_b", _bucket("_all", *group, parts=PARTS))
        told = _ranked(asks.where(F.col("to").isNotNull()), ["to"], "_b", group, "_all", "_before")
        told = told.select(*group, "_all", "_m", "to", (F.col("_before") + F.col("_all") <= F.element_at(left, F.col("to") + 1)).alias("ok"))
        told = told.unionByName(asks.where(F.col("to").isNull()).select(*group, "_all", "_m", "to", F.lit(False).alias("ok")))
        told.write.parquet(f"{path}/round={done}")
        told = base.sparkSession.read.schema(told.schema).parquet(f"{path}/round={done}")
        settled = told.where("ok").groupBy("to").agg(F.sum("_all").alias("c")).collect()  # at most n_shards rows
        if not settled:
            break
        for r in settled:
            free[r["to"]] -= r["c"]
        todo, done = told.where("to IS NOT NULL AND NOT ok"), done + 1

    # groups that no shard has room for, and all documents without equals, fill the shards up to even counts
    rounds = base.sparkSession.read.schema(told.schema).parquet(path)
    order = sorted(range(n_shards), key=lambda j: (-free[j], j))
    lacks = {j: free[j] for j in order}
    ends = {j: sum(free[i] for i in order[: k + 1]) for k, j in enumerate(order)}
    pool = rounds.where("to IS NULL").select(*group, F.col("_all").alias("c")).unionByName(groups.where("_all = 1").select(*group, F.col("_all").alias("c")))
    pool = pool.withColumn("_one", F.lit(1)).withColumn("_b", _bucket("c", *group, parts=PARTS))
    pool = _ranked(pool, ["_one"], "_b", group, "c", "_before")
    bounds = F.array(*[F.struct(F.lit(j).alias("shard"), F.lit(ends[j] - lacks[j]).cast("long").alias("a"), F.lit(ends[j]).cast("long").alias("b")) for j in range(n_shards)])
    piece = lambda s: F.struct(s["shard"].alias("shard"), (F.least(s["b"], F.col("_before") + F.col("c")) - F.greatest(s["a"], F.col("_before"))).alias("c"))
    filled = pool.select(*group, F.explode(F.filter(F.transform(bounds, piece), lambda s: s["c"] > 0)).alias("_s")).select(*group, "_s.shard", "_s.c")
    final = filled_up.unionByName(rounds.where("ok").select(*group, F.col("to").alias("shard"), F.col("_all").alias("c"))).unionByName(filled)
    # a group's pieces as cumulative ranges; at most 2 * n_shards of them
    pieces = final.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("shard", "c"))).alias("_p"))

    # rank of each document in its group, salted where the group is large
    dealt = base.join(hot, group, "left").withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64("_key"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    dealt = dealt.drop("_salts").withColumn("_one", F.lit(1).cast("long"))
    counts = dealt.groupBy(*group, "_salt").agg(F.count("*").alias("_n"))
    ahead = W.partitionBy(*group).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    table = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).join(pieces, group).select(*group, "_salt", "_ahead", "_p")
    inside = W.partitionBy(*group, "_salt").orderBy("_key")
    ranked = dealt.withColumn("_r", F.row_number().over(inside) - 1).join(table, [*group, "_salt"]).withColumn("_r", F.col("_r") + F.col("_ahead"))
    walk = F.expr("aggregate(_p, named_struct('left', CAST(_r AS BIGINT), 'shard', -1), (acc, s) -> IF(acc.shard >= 0, acc, IF(acc.left < s.c, named_struct('left', acc.left, 'shard', s.shard), named_struct('left', acc.left - s.c, 'shard', -1))), acc -> acc.shard)")
    placed = ranked.select("_key", "size", "crc", "_h", walk.alias("shard"), F.lit(1).cast("long").alias("_one"))
    placed = cut(placed.withColumn("_b", F.pmod(F.xxhash64("_key", "_h"), F.lit(PARTS)).cast("int")), "shard-placed")
    slotted = _ranked(placed, ["shard"], "_b", ["_key", "_h"], "_one", "slot")
    return slotted.select(F.col("_key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
