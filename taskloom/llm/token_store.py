"""Token ids in binary blocks with a minimal perfect hash index.

Documents are put in order of id over range partitions (shards), encoded, and written as blocks: raw ids
(unsigned 16-bit where the vocabulary allows, else 32-bit, little-endian), and an index from document key
to (offset, length).  The index is a minimal perfect hash: levels of bit arrays, in which a key has the
first place that no other key wants; its rank among the set bits is its slot, and the slot holds a
fingerprint of the key, so that absent keys are turned away.  A lookup reads a fixed number of levels.

Blocks are rows of a Parquet container (``payload``, ``index``, ``keys`` columns), so that Spark's commit
protocol keeps them whole if executors are lost, on any store that Spark writes to.

Defined results: null text is empty and has the end id alone; ids are integers (any other type is a TypeError); null
ids come first; repeated ids keep one entry each, told apart by their occurrence within the shard; ties go by text hash;
no documents give no blocks and no rows; extra columns are ignored.  One block, or one longer document, is held by
one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import arrow_schema, pieces
from .scratch import fresh_path, small
from .tokenizers_public import byte_model

END = 2
#: Ids in a block before it is closed.
BLOCK = 2_000_000
#: Bytes of text encoded together.
HOLD = 16_000_000
LEVELS = 48
#: Block starts are broadcast up to so many blocks.
MOST_BLOCKS = 200_000
BLOCKS = "shard int, block int, first_key bigint, last_key bigint, first_seen bigint, n_docs bigint, n_ids bigint, width int, payload binary, index binary, keys binary, nulls binary"


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys (splitmix64)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def hashed_keys(ids: np.ndarray, null: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """64-bit keys of (id or null, occurrence)."""
    with np.errstate(over="ignore"):
        return _mix(ids.astype(np.int64).view(np.uint64) ^ _mix(occurrence.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64), 101), 77)


class PerfectHash:
    """Keys (distinct unsigned 64-bit) to 0..n-1, with a 32-bit fingerprint for each."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, prints: np.ndarray):
        self.sizes, self.bits, self.prints = sizes, bits, prints
        self.offset = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        left, sizes, levels = keys, [], []
        while len(left):
            if len(levels) >= LEVELS:
                raise ValueError("keys aren't distinct")
            size = max(2, int(len(left) * gamma) | 1)
            place = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            taken = np.bincount(place, minlength=size)
            levels.append((taken == 1).astype(np.uint8))
            sizes.append(size)
            left = left[taken[place] != 1]
        out = cls(np.array(sizes, dtype=np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint8), np.zeros(len(keys), np.uint32))
        if len(keys):
            out.prints[out._slots(keys)] = (_mix(keys, 999) >> np.uint64(32)).astype(np.uint32)
        return out

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slot = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            place = self.offset[level] + (_mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[place] == 1
            slot[left[hit]] = self.rank[place[hit]]
            left = left[~hit]
            if not len(left):
                break
        return slot

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Slots; -1 for keys whose fingerprint isn't there."""
        slot = self._slots(keys)
        safe = np.maximum(slot, 0)
        known = (slot >= 0) & (len(self.prints) > 0)
        if len(self.prints):
            known &= self.prints[safe] == (_mix(keys, 999) >> np.uint64(32)).astype(np.uint32)
        return np.where(known, slot, -1)


def pack_index(keys: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> bytes:
    h = PerfectHash.build(keys)
    slot = h.lookup(keys)
    table = np.zeros((2, len(keys)), dtype=np.int64)
    table[0, slot], table[1, slot] = offsets, lengths
    head = np.array([len(keys), len(h.sizes), *h.sizes], dtype=np.int64)
    return head.tobytes() + np.packbits(h.bits).tobytes() + h.prints.tobytes() + table.tobytes()


def unpack_index(data: bytes) -> tuple[PerfectHash, np.ndarray]:
    n, levels = np.frombuffer(data, np.int64, 2)
    sizes = np.frombuffer(data, np.int64, levels, 16)
    at, total = 16 + 8 * int(levels), int(sizes.sum())
    bits = np.unpackbits(np.frombuffer(data, np.uint8, (total + 7) // 8, at))[:total]
    at += (total + 7) // 8
    prints = np.frombuffer(data, np.uint32, n, at)
    return PerfectHash(sizes, bits, prints), np.frombuffer(data, np.int64, 2 * int(n), at + 4 * int(n)).reshape(2, int(n))


def write_blocks(docs: DataFrame, vocabulary: str, path: str, text: str = "text", key: str = "doc_id", end: int = END, n_shards: int | None = None) -> None:
    """Encodes ``docs`` in ascending order of ``key`` and writes blocks to ``path``."""
    from pyspark.sql.types import IntegralType

    spark = docs.sparkSession
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"ids are integers, {key} isn't")
    n = n_shards or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ordered = own.withColumn("_th", F.xxhash64("_text")).repartitionByRange(n, "_key", "_th").sortWithinPartitions("_key", "_th").select("_key", "_text")

    schema = arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        width = 2 if byte_model(vocabulary).lib.get_vocab_size() <= 65536 and end < 65536 else 4
        ids, keys, null, seen = [], [], [], []
        last, again, block, held = object(), 0, 0, 0

        def close():
            lengths = np.array([len(x) for x in ids], dtype=np.int64)
            offsets = np.cumsum(lengths) - lengths
            k, z, o = np.array(keys, dtype=np.int64), np.array(null, dtype=bool), np.array(seen, dtype=np.int64)
            index = pack_index(hashed_keys(k, z, o), offsets, lengths)
            payload = np.concatenate(ids).astype("<u2" if width == 2 else "<u4").tobytes()
            row = [shard, block, None if z[0] else int(k[0]), None if z[-1] else int(k[-1]), int(o[0]), len(k), int(lengths.sum()), width, payload, index, np.stack([k, o]).tobytes(), z.tobytes()]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema=schema)

        for batch in batches:
            for part in pieces(batch, "_text", HOLD):
                made, where = byte_model(vocabulary).encode(part.column("_text"))
                for k, a, b in zip(part.column("_key").to_pylist(), where[:-1].tolist(), where[1:].tolist()):
                    got = made[a:b]
                    again = again + 1 if k == last else 0
                    last = k
                    ids.append(np.append(got, np.uint32(end)))
                    keys.append(k or 0)
                    null.append(k is None)
                    seen.append(again)
                    held += len(got) + 1
                    if held >= BLOCK:
                        yield close()
                        ids, keys, null, seen, held = [], [], [], [], 0
                        block += 1
        if ids:
            yield close()

    ordered.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Every document, found by key through the index: (doc_id, occurrence, shard, block, at, n_tokens, ids_crc32)."""
    fields = "doc_id bigint, occurrence bigint, shard int, block int, at bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                keys, seen = np.frombuffer(row["keys"], np.int64).reshape(2, -1)
                null = np.frombuffer(row["nulls"], bool)
                h, table = unpack_index(row["index"])
                slot = h.lookup(hashed_keys(keys, null, seen))
                if (slot < 0).any():
                    raise ValueError(f"a key of shard {row['shard']} isn't in its index")
                at, size = table[0, slot], table[1, slot]
                ids = np.frombuffer(row["payload"], "<u2" if row["width"] == 2 else "<u4").astype("<u4")
                crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(at, size)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, mask=null), pa.array(seen), pa.array(np.full(n, row["shard"], np.int32)), pa.array(np.full(n, row["block"], np.int32)), pa.array(at), pa.array(size), pa.array(np.array(crc, dtype=np.int64))],
                    names=["doc_id", "occurrence", "shard", "block", "at", "n_tokens", "ids_crc32"],
                )

    return spark.read.schema(BLOCKS).parquet(path).select("shard", "block", "width", "payload", "index", "keys", "nulls").mapInArrow(run, fields)


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """(doc_id, shard, block, occurrence, ids) of a stated list of ids, every occurrence of each; absent ids give no rows.

    Blocks are skipped by their key range where they are read (between the least and the largest id asked for).  A block that
    is left is read whole and its index unpacked once, which is linear in the block; then an id costs one probe for each
    occurrence and one more, and only found documents leave the block."""
    want = np.array(sorted({int(k) for k in ids}), dtype=np.int64)
    fields = "doc_id bigint, shard int, block int, occurrence bigint, ids array<int>"
    schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (head,) = batch.slice(i, 1).select(["shard", "block", "first_key", "last_key", "first_seen", "width"]).to_pylist()
                first, last = head["first_key"], head["last_key"]
                if last is None:
                    continue
                near = want[(want >= (np.iinfo(np.int64).min if first is None else first)) & (want <= last)]
                if not len(near):
                    continue
                view = lambda c: memoryview(batch.column(c)[i].as_buffer())  # noqa: B023, E731
                h, table = unpack_index(view("index"))
                data = np.frombuffer(view("payload"), "<u2" if head["width"] == 2 else "<u4")
                seen = np.where(near == first, head["first_seen"], 0) if first is not None else np.zeros(len(near), np.int64)
                out: list[dict] = []
                while len(near):
                    slot = h.lookup(hashed_keys(near, np.zeros(len(near), bool), seen))
                    hit = slot >= 0
                    near, seen, slot = near[hit], seen[hit], slot[hit]
                    out += [dict(zip(schema.names, (int(k), head["shard"], head["block"], int(o), data[table[0, s] : table[0, s] + table[1, s]].tolist()))) for k, o, s in zip(near, seen, slot)]
                    seen = seen + 1
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    if not len(want):
        return spark.createDataFrame([], fields)
    near = ((F.coalesce("first_key", F.lit(-(2**63))) <= int(want[-1])) & (F.col("last_key") >= int(want[0])))
    return spark.read.schema(BLOCKS).parquet(path).where(near).select("shard", "block", "first_key", "last_key", "first_seen", "width", "payload", "index").mapInArrow(run, fields)


def get(spark: SparkSession, path: str, ids: list[int]) -> dict[int, list[list[int]]]:
    """Token ids of a few documents by id: a list for every occurrence, in the store's order."""
    out: dict[int, list[list[int]]] = {}
    for r in lookup(spark, path, ids).orderBy("doc_id", "shard", "block", "occurrence").toLocalIterator():
        out.setdefault(r["doc_id"], []).append(r["ids"])
    return out


def token_store(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """Writes blocks to shared storage, reads them back, and gives each document its global start."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    write_blocks(docs, vocabulary, path, text, key)
    # one row a block; shards are as many as range partitions, a number set by configuration
    blocks = spark.read.schema(BLOCKS).parquet(path).select("shard", "block", "n_ids")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    ahead = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_shard_start"))
    within = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts, _ = small(blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("_block_start")).join(F.broadcast(shards), "shard"), MOST_BLOCKS)
    return read_blocks(spark, path).join(starts, ["shard", "block"]).select("doc_id", (F.col("_shard_start") + F.col("_block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")
