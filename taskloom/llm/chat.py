"""Chat formatting into prefix trees of token ids: turns that conversations share at their start are emitted once.

A conversation's turns become nodes ``<turn role>\\n text </turn>\\n``; control strings inside texts are
escaped with a backslash and come back by ``unescape``.  Head, text and end of a node are encoded each on its own
(special strings of the vocabulary inside texts are ordinary text), so that the text's tokens are exactly what the loss
mask covers.  Conversations with equal opening turns go to one pack; within it nodes are laid out depth-first, each
once, with, counted in tokens,

* ``start``: where it stands in the pack, ``position``: the position id of its first token, which is
  what it would have in its own conversation,
* ``body``, ``body_length``: its text, which has loss if the role is assistant,
* ``ancestors``: the intervals of the pack that it may attend to, besides itself.

Conversations are dealt by range of (opening turn, second turn, id), so an opening turn of any weight goes over many
tasks without being counted or joined, and those that share more stand together.  A pack ends with its opening turn,
after ``most`` conversations or after ``PACK_BYTES`` of text; shared turns are emitted once in each pack.

Defined results: null role and text are empty; turns go by (turn, role, text), null turns first; all rows of a null
conversation id are one conversation; equal conversations share one leaf; extra columns are ignored; an empty
table gives no packs.  One conversation's turns are held by one task, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import arrow_schema
from .tokenizers_public import byte_model

MOST = 500
#: Bytes of text after which a pack ends, and of packs that are encoded together.
PACK_BYTES = 4_000_000
_CONTROL = re.compile(r"\\|</turn>|<turn |### ")
_ESCAPED = re.compile(r"\\(\\|</turn>|<turn |### )")
_ROLE = re.compile(r"[\\>\n]")
_ROLE_ESCAPED = re.compile(r"\\([\\>\n])")
_HEAD = re.compile(r"<turn ((?:[^\\>\n]|\\[\\>\n])*)>\n")
_NEXT = re.compile(r"\\(?:\\|</turn>|<turn |### )|<(?=/turn>)")
CLOSE = "</turn>\n"

NODE = "array<struct<start:bigint,length:bigint,position:bigint,body:bigint,body_length:bigint,loss:boolean,ancestors:array<struct<start:bigint,end:bigint>>>>"
PACK = f"pack string, ids array<int>, nodes {NODE}, leaves array<struct<conv_id:bigint,node:int>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, str, str]:
    """A node's head, escaped text and end."""
    return "<turn " + _ROLE.sub(lambda m: "\\" + m[0], role) + ">\n", escape(text), CLOSE


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        end = head.end()
        # the first closing mark that no backslash escapes
        place = end
        while not formatted.startswith("</turn>", place):
            place = _NEXT.search(formatted, place)
            place = place.start() if place[0] == "<" else place.end()
        out.append((_ROLE_ESCAPED.sub(r"\1", head[1]), unescape(formatted[end:place])))
        at = place + len(CLOSE)
    return out


def _tree(rows: list[tuple]) -> tuple[list[tuple], list[dict]]:
    """Conversations (id, [(role, text)]) as nodes (turn, parent) in depth-first order, and leaves."""
    root: dict = {}
    for conv, turns in rows:
        at = root
        for turn in turns:
            at = at.setdefault(turn, {})
        at.setdefault(None, []).append(conv)
    nodes, leaves = [], []
    stack = [(root, None, -1)]
    while stack:
        at, turn, above = stack.pop()
        mine = above
        if turn is not None:
            mine = len(nodes)
            nodes.append((turn, above))
        leaves += [{"conv_id": conv, "node": mine} for conv in at.get(None, ())]
        stack += [(child, t, mine) for t, child in sorted(((t, c) for t, c in at.items() if t is not None), key=lambda x: x[0], reverse=True)]
    return nodes, leaves


def _packs(groups: list[tuple[str, list[tuple]]], model, schema: pa.Schema) -> pa.RecordBatch:
    """Lays out several packs (name, conversations); the distinct heads, texts and ends of all are encoded together."""
    trees = [(name, *_tree(rows)) for name, rows in groups]
    parts: dict[str, int] = {}
    for _, nodes, _ in trees:
        for turn, _ in nodes:
            for x in render(*turn):
                parts.setdefault(x, len(parts))
    flat, where = model.encode(pa.array(list(parts), type=pa.large_string()))
    every, ends, made = [], [0], []
    for _, nodes, _ in trees:
        out: list[dict] = []
        at = 0
        for turn, above in nodes:
            own = [parts[x] for x in render(*turn)]
            head, body, close = (int(where[k + 1] - where[k]) for k in own)
            every += [flat[where[k] : where[k + 1]] for k in own]
            up = out[above] if above >= 0 else None
            way = [] if up is None else up["ancestors"] + [{"start": up["start"], "end": up["start"] + up["length"]}]
            if len(way) > 1 and way[-2]["end"] == way[-1]["start"]:  # next to each other in the pack: one interval
                way = way[:-2] + [{"start": way[-2]["start"], "end": way[-1]["end"]}]
            size = head + body + close
            out.append({"start": at, "length": size, "position": 0 if up is None else up["position"] + up["length"], "body": at + head, "body_length": body, "loss": turn[0] == "assistant", "ancestors": way})
            at += size
        made.append(out)
        ends.append(ends[-1] + at)
    ids = pa.array(np.concatenate(every).astype(np.int32) if every else np.zeros(0, np.int32))
    columns = [pa.array([name for name, *_ in trees]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), pa.array(made, schema.field("nodes").type), pa.array([leaves for *_, leaves in trees], schema.field("leaves").type)]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def pack_conversations(conversations: DataFrame, vocabulary: str, most: int = MOST) -> DataFrame:
    """One row a pack: its token ids, nodes and leaves."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.select("conv_id", turn.alias("_t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    kind = lambda k: F.xxhash64(F.expr(f"get(_turns, {k}).role"), F.expr(f"get(_turns, {k}).text"))
    whole = whole.select("conv_id", kind(0).alias("_root"), kind(1).alias("_second"), F.expr("transform(_turns, t -> struct(t.role as role, t.text as text))").alias("turns"))
    order = ["_root", "_second", "conv_id"]
    ordered = whole.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "_root", "turns")

    schema = arrow_schema(PACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_model(vocabulary, False)
        now, rows, size = None, [], 0
        groups: list[tuple[str, list[tuple]]] = []
        held = 0

        def close():
            first = rows[0][0]
            groups.append((f"{now & (2**64 - 1):016X}-{'null' if first is None else first}", rows))

        for batch in batches:
            for part in range(0, batch.num_rows, 100):
                for r in batch.slice(part, 100).to_pylist():
                    if rows and (r["_root"] != now or len(rows) >= most or size >= PACK_BYTES):
                        close()
                        held += size
                        rows, size = [], 0
                        if held >= PACK_BYTES:
                            yield _packs(groups, model, schema)
                            groups, held = [], 0
                    now = r["_root"]
                    rows.append((r["conv_id"], [(t["role"], t["text"]) for t in r["turns"]]))
                    size += sum(len(t["text"]) + 20 for t in r["turns"])
        if rows:
            close()
        if groups:
            yield _packs(groups, model, schema)

    return ordered.mapInArrow(run, PACK)


def read_conversations(packs: DataFrame, vocabulary: str) -> DataFrame:
    """Reads packs back from their ids: a digest of each conversation's turns and of what the loss mask covers."""
    fields = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, pack string"

    schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = byte_model(vocabulary, False).bytes_of
        for batch in batches:
            for part in range(batch.num_rows):
                one = batch.slice(part, 1)
                ids = one.column("ids").flatten().to_numpy(zero_copy_only=False)
                (p,) = one.select(["pack", "nodes", "leaves"]).to_pylist()
                out = []
                known: dict[int, tuple] = {}
                for leaf in p["leaves"]:
                    if leaf["node"] not in known:
                        known[leaf["node"]] = _digest(ids, pieces, p["nodes"], leaf["node"])
                    out.append(dict(zip(schema.names, (leaf["conv_id"], *known[leaf["node"]], p["pack"]))))
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return packs.mapInArrow(run, fields)


def _digest(ids: np.ndarray, pieces: list[bytes], nodes: list[dict], leaf: int) -> tuple:
    text = lambda a, b: b"".join([pieces[i] for i in ids[a:b].tolist()]).decode("utf-8", "surrogatepass")
    own = nodes[leaf]
    spans = [(a["start"], a["end"]) for a in own["ancestors"]] + [(own["start"], own["start"] + own["length"])]
    if sum(b - a for a, b in spans) != own["position"] + own["length"]:
        raise ValueError("position ids and ancestor intervals disagree")
    formatted = "".join(text(a, b) for a, b in spans)
    turns = parse(formatted)
    # the mask: bodies of nodes with loss that the leaf attends to
    loss = ""
    for a, b in spans:
        for k in range(bisect_left(nodes, a, key=lambda n: n["start"]), bisect_left(nodes, b, key=lambda n: n["start"])):
            if nodes[k]["loss"]:
                loss += unescape(text(nodes[k]["body"], nodes[k]["body"] + nodes[k]["body_length"]))
    enc = lambda s: s.encode("utf-8", "surrogatepass")
    return len(turns), hashlib.sha256(enc("".join(f"{r}\n{t}\n" for r, t in turns))).hexdigest(), len(loss), hashlib.sha256(enc(loss)).hexdigest(), len(formatted)
