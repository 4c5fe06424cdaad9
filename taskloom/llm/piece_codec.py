"""SentencePiece encoding by prefix table, and decoding.

Encodes exactly as the library does for merge-type models (see ``prefix_bpe``); decoding is the
library's own.  Null text is empty; empty text has the begin and end ids alone and decodes to empty
text; repeated rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from .arrow import map_texts
from .tokenizers_public import piece_model

BEGIN, END = 1, 2


def encode(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``ids``: array of ids with begin and end."""

    def work(texts):
        import numpy as np

        return {"ids": [[BEGIN, *np.frombuffer(b, dtype="<u4").tolist(), END] for b in piece_model(model).encode(texts)]}

    return map_texts(docs, text, keep or ["doc_id"], "ids array<int>", work)


def decode(coded: DataFrame, model: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``text``, decoded from the array column ``ids``."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def back(column):
        lib = piece_model(model).lib
        return column.map(lambda x: lib.decode([int(i) for i in x]) if x is not None else None)

    return coded.select(*(keep or ["doc_id"]), back(ids).alias("text"))


def round_trip(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encodes and decodes in one pass: token count, and digests of ids and of the decoded text."""
    edge = [i.to_bytes(4, "little") for i in (BEGIN, END)]

    def work(texts):
        m = piece_model(model)
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for b in m.encode(texts):
            ids = edge[0] + b + edge[1]
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(m.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
        return out

    return map_texts(docs, text, keep or ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", work)
