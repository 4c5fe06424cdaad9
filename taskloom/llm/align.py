"""Alignment of two tokenizers' tokens over the same bytes.

Python only tokenizes: for each text it gives the ids and byte ends of both.  All else is built by higher-order functions:
the ends that both have (``array_intersect``) cut a text into groups, the owner of each byte (``transform`` over ``sequence``
and ``array_repeat``) says at once which tokens a group holds, and the tokens that end there are linked.  Counting links
over the corpus is a grouping by id pair.  One token of a linked pair is a suffix of the other, as bytes, so there can't be
more pairs than suffixes of vocabulary entries (``most_pairs``, some hundred thousand); that proven bound is why the counted
pairs are broadcast.

The byte-level tokenizer reads a space and the text, the piece tokenizer the text (it puts a space before).  Special strings
in a text are plain text.

Defined results: null and empty texts, and texts whose tokens of either kind don't give the same bytes back (those
with U+2581), have no tokens, groups or links; repeated rows are aligned and counted each; ties for a B id's most frequent
partner are all best; null and repeated ids stay as they are; no documents give no rows; extra columns of any name are
ignored.  One document of any length is linear work of one task, which holds some 50 bytes for each byte of its text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import slices
from .scratch import cut
from .tokenizers_public import SPACE, SPLIT, ByteModel, text_buffers

TOKENS = "a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>"
#: Bytes of text whose tokens are held at once.
HOLD = 2_000_000
#: Bytes of different parts that are encoded together.
TOGETHER = 20_000
#: Texts that aren't cut at spaces: runs of white space in which a word of either pattern could reach across, and U+2581.
ODD = re.compile(r"^ | $|  |\s \s|\s\s |" + SPACE)
#: White space for which tiktoken's pattern may run out of stack.
LONG_RUN = re.compile(r"\s{2000}")
#: Ids of B in a pair code: code = a * SHIFT + b.
SHIFT = 1 << 31


class Bytes:
    """A byte-level vocabulary in the tokenizers library's file format, encoded by tiktoken with the file's own ranks.

    Ids ascend with the merges there, so that a token's rank is its id; a file for which that isn't so is a ValueError.  Texts
    with runs of white space too long for tiktoken's pattern go through the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, special = spec["model"]["vocab"], {x["content"] for x in spec.get("added_tokens", [])}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if any(x >= y for x, y in zip(made, made[1:])):
            raise ValueError("ids don't ascend with the merges")
        shown = ByteModel._alphabet()
        self.entries = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.entries[i] = t.encode() if t in special else "".join(map(shown.__getitem__, t)).encode("latin-1")
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks={self.entries[i]: i for t, i in vocab.items() if t not in special}, special_tokens={})
        self.path = path

    @cached_property
    def lib(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        made.encode_special_tokens = True
        return made

    def encode(self, spaced: str) -> list[int]:
        """Ids of a space and a text."""
        if LONG_RUN.search(spaced):
            return self.lib.encode(spaced, add_special_tokens=False).ids
        return self.fast.encode_ordinary(spaced)


class Pieces:
    """A sentencepiece model by the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.entries = [bytes([int(lib.id_to_piece(i)[3:-1], 16)]) if lib.is_byte(i) else lib.id_to_piece(i).replace(SPACE, " ").encode() for i in range(lib.vocab_size())]

    def encode(self, spaced: str) -> list[int]:
        """Ids of a space and a text; the library puts the space itself."""
        return self.lib.encode(spaced[1:])


class Spans:
    """What each id of a vocabulary stands for, end to end."""

    def __init__(self, shown: list[bytes]):
        self.size = np.array([len(x) for x in shown], dtype=np.int32)
        self.first = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.data = np.frombuffer(b"".join(shown), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        size = self.size[ids]
        ends = np.cumsum(size, dtype=np.int32)
        return self.data[np.repeat(self.first[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]


@lru_cache(maxsize=4)
def tokenizer(path: str) -> tuple[Bytes | Pieces, Spans]:
    """The tokenizer of a vocabulary file (.json: byte-level, else a piece model), and its entries' bytes."""
    made = Bytes(path) if path.endswith(".json") else Pieces(path)
    return made, Spans(made.entries)


def most_pairs(a: str, b: str) -> int:
    """Id pairs that can end together: of each entry, the suffixes (itself included) that are entries of the other."""
    one, two = tokenizer(a)[0].entries, tokenizer(b)[0].entries

    def count(xs: list[bytes], ys: list[bytes], own: bool) -> int:
        by: dict[bytes, int] = {}
        for y in ys:
            by[y] = by.get(y, 0) + 1
        return sum(by.get(x[k:], 0) for x in xs for k in range(0 if own else 1, len(x)))

    return count(one, two, True) + count(two, one, False)


def _parts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """A space and each text, cut before every space, where no token of either kind reaches across; odd texts stay whole.

    Gives where each text's parts begin, which part stands there, the different parts, and whether they were cut."""
    odd = np.array([bool(ODD.search(t)) for t in texts], dtype=bool)
    where, data = text_buffers(pa.array([" " + t if t else "" for t in texts], pa.large_string()))
    begins = data == 32
    begins[np.repeat(odd, np.diff(where))] = False
    begins[where[:-1][np.diff(where) > 0]] = True
    starts = np.append(np.flatnonzero(begins), len(data))
    made = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
    index = made.indices.to_numpy()
    at = np.searchsorted(starts, where)
    plain = np.ones(len(made.dictionary), dtype=bool)
    plain[index[np.repeat(odd, np.diff(at))]] = False
    return at, index, made.dictionary, plain


class _Pool:
    """The ids of different parts, end to end; plain parts are encoded together, as nothing reaches across them."""

    def __init__(self, tool: Bytes | Pieces, spans: Spans, known: pa.Array, plain: np.ndarray):
        self.size, self.good = np.zeros(len(known), dtype=np.int64), np.ones(len(known), dtype=bool)
        self.begin, self.spans, self.held, self.flat = np.zeros(len(known), dtype=np.int64), spans, 0, []
        where, data = text_buffers(known.filter(pa.array(plain)))
        own, at = np.flatnonzero(plain), 0
        while at < len(own):
            to = min(len(own), max(at + 1, int(np.searchsorted(where, where[at] + TOGETHER))))
            self._together(tool, data[where[at] : where[to]].tobytes(), own[at:to], where[at + 1 : to + 1] - where[at])
            at = to
        for k in np.flatnonzero(~plain).tolist():
            self._alone(tool, known[k].as_py(), k)
        self.ids = np.concatenate(self.flat) if self.flat else np.zeros(0, np.int32)

    def _put(self, k, ids: np.ndarray, size, begin) -> None:
        self.size[k], self.begin[k] = size, self.held + begin
        self.flat.append(ids)
        self.held += len(ids)

    def _together(self, tool: Bytes | Pieces, want: bytes, own: np.ndarray, cuts: np.ndarray) -> None:
        """Parts ``own``, put together as ``want`` and ending at ``cuts``."""
        ids = np.array(tool.encode(want.decode()), dtype=np.int32)
        ends = np.cumsum(self.spans.size[ids], dtype=np.int64)
        upto = np.searchsorted(ends, cuts)
        if len(ids) and upto[-1] < len(ends) and (ends[upto] == cuts).all() and self.spans.joined(ids).tobytes() == want:
            self._put(own, ids, np.diff(upto + 1, prepend=0), np.concatenate([[0], upto[:-1] + 1]))
        else:
            for k, x, y in zip(own.tolist(), [0, *cuts.tolist()], cuts.tolist()):
                self._alone(tool, want[x:y], k)

    def _alone(self, tool: Bytes | Pieces, part: bytes, k: int) -> None:
        ids = np.array(tool.encode(part.decode()), dtype=np.int32)
        self.good[k] = self.spans.joined(ids).tobytes() == part
        self._put(k, ids, len(ids), 0)

    def lists(self, index: np.ndarray, where: np.ndarray) -> list[pa.Array]:
        """Ids and byte ends of each text, which has the parts of ``index`` between two places of ``where``."""
        size = self.size[index]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.begin[index] - ends[:-1], size) + np.arange(ends[-1])]
        at = ends[where]
        upto = np.concatenate([[0], np.cumsum(self.spans.size[ids], dtype=np.int64)])
        offsets = pa.array(at.astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, (upto[1:] - np.repeat(upto[at[:-1]], np.diff(at))).astype(np.int32))]


def tokens(docs: DataFrame, a: str, b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and both tokenizers' ids and byte ends for every whole text."""
    from pyspark.sql.types import StructType

    own = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_text" if key != "_text" else "_text_"))
    body = own.columns[1]
    schema = StructType([own.schema[0], *StructType.fromDDL(TOKENS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, body, HOLD):
                where, index, known, plain = _parts(texts)
                one, two = (_Pool(*tokenizer(v), known, plain) for v in (a, b))
                # a text counts if all its parts come back from both
                bad = np.concatenate([[0], np.cumsum(~(one.good & two.good)[index])])
                good = (np.diff(where) > 0) & (bad[where[1:]] == bad[where[:-1]])
                index, where = index[np.repeat(good, np.diff(where))], np.concatenate([[0], np.cumsum(np.where(good, np.diff(where), 0))])
                yield pa.RecordBatch.from_arrays([part.column(0), *one.lists(index, where), *two.lists(index, where)], names=schema.names)

    return own.mapInArrow(run, schema)


def aligned(coded: DataFrame) -> DataFrame:
    """``coded`` (see ``tokens``) with ``cuts`` (byte ends that both have), ``starts`` (where the groups begin) and ``a_of``, ``b_of`` (index of the token that holds each byte)."""
    owner = "flatten(transform({0}, (e, i) -> array_repeat(i, e - if(i = 0, 0, {0}[i - 1]))))"
    made = coded.withColumns({"cuts": F.array_intersect("a_ends", "b_ends"), "a_of": F.expr(owner.format("a_ends")), "b_of": F.expr(owner.format("b_ends"))})
    return made.withColumn("starts", F.expr("concat(array(0), cuts)"))


def _guarded(made: str, kind: str) -> Column:
    """``made``, nothing where there is no group.  Naming each array outside the lambda too keeps the optimizer from putting its formula inside, where it would be worked out again for every element."""
    return F.expr(f"if(size(cuts) + size(starts) + size(a_of) + size(b_of) <= 1, cast(array() as {kind}), {made})")


#: Ids of one side from a group's first token to its last; a slice would copy the whole array for each group.
_OWN = "transform(sequence({0}_of[starts[k]], {0}_of[e - 1]), i -> {1})"


def groups() -> Column:
    """array<struct<a: array<int>, b: array<int>>>: the ids of each group, over ``aligned`` columns."""
    return _guarded(f"transform(cuts, (e, k) -> named_struct('a', {_OWN.format('a', 'a_ids[i]')}, 'b', {_OWN.format('b', 'b_ids[i]')}))", "array<struct<a:array<int>,b:array<int>>>")


def links() -> Column:
    """array<bigint>: the code of each pair of tokens that end together, in order of place."""
    return _guarded(f"transform(cuts, e -> a_ids[a_of[e - 1]] * {SHIFT}L + b_ids[b_of[e - 1]])", "array<bigint>")


def shown_groups() -> Column:
    """``a1,a2|b1;a3|b2,b3`` over ``aligned`` columns."""
    side = lambda x: f"if({x}_of[starts[k]] = {x}_of[e - 1], string({x}_ids[{x}_of[e - 1]]), array_join({_OWN.format(x, f'string({x}_ids[i])')}, ','))"
    return F.array_join(_guarded(f"transform(cuts, (e, k) -> concat({side('a')}, '|', {side('b')}))", "array<string>"), ";")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(code, n, best) of every linked id pair of a table with ``links``; ``best`` if no other A id is linked more often to the B id."""
    # the outer form, as the optimizer would work out ``links`` once more to drop rows without any
    n = linked.select(F.explode_outer("links").alias("code")).where(F.col("code").isNotNull()).groupBy("code").agg(F.count("*").alias("n"))
    return n.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy(F.col("code") % SHIFT)))


def align_digest(docs: DataFrame, a: str, b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: tokens, groups, links, links whose pair is the B id's most frequent, the pairs' counts summed, and the groups' digest."""
    made = aligned(tokens(docs, a, b, text, key))
    n = F.size("cuts").cast("long")
    own = made.select(
        F.monotonically_increasing_id().alias("_rid"), F.col(f"`{key}`").alias("_key"), F.size("a_ids").cast("long").alias("n_a"), F.size("b_ids").cast("long").alias("n_b"), n.alias("n_groups"), n.alias("n_links"),
        F.when(n > 0, F.sha2(shown_groups().cast("binary"), 256)).otherwise("").alias("groups_sha256"), links().alias("links"),
    )
    # stored, so that texts are tokenized once and a row's number stays its own
    own = cut(own, "align")
    pairs = F.broadcast(pair_counts(own))
    each = own.select("_rid", F.explode("links").alias("code")).join(pairs, "code")
    sums = each.groupBy("_rid").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return own.drop("links").join(sums, "_rid", "left").select(F.col("_key").alias(key), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
