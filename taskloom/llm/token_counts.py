"""Token counts by prefix table: the count at every prefix answers length and budget questions without encoding again.

Null text is empty and has no tokens; special strings inside texts count as the library counts them by
default; repeated rows are counted each; no documents give no rows; extra columns of any name are ignored.  A text of any
length is linear work; its tables are held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .arrow import map_texts
from .tokenizers_public import byte_model


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Bytes, tokens and whether they are over ``limit``, for every whole text."""

    def work(texts):
        n = byte_model(vocabulary).counts(texts)
        return {"n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_texts(docs, text, keep or ["doc_id"], "n_bytes long, n_tokens long, over_limit boolean", work)


def truncate(docs: DataFrame, vocabulary: str, budget: int, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The longest prefix of each text that has ``budget`` tokens or fewer, read off the prefix table.

    A budget of 0 gives empty texts; one under 0 can't be met and is a ValueError."""
    if budget < 0:
        raise ValueError("a budget is 0 or more")

    def work(texts):
        import numpy as np

        m = byte_model(vocabulary)
        out = {"text": [], "n_tokens": []}
        for t in texts:
            n = m.prefix_counts(t)
            p = int(np.flatnonzero(n <= budget)[-1])
            out["text"].append(t[:p])
            out["n_tokens"].append(int(n[p]))
        return out

    return map_texts(docs, text, keep or ["doc_id"], "text string, n_tokens long", work)
