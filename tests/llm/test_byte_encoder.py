"""The encoder over Arrow buffers against the library, on odd white space, special strings and empty texts."""

import random

import pyarrow as pa

from taskloom.llm.queries import vocabulary
from taskloom.llm.tokenizers_public import byte_model


def test_parts_encode_like_whole_texts():
    m, r = byte_model(vocabulary("byte_bpe_50k.json")), random.Random(5)
    bits = ["a", "é", " ", "  ", "\n", "\t", " ", "　", "\xa0", "\x85", "\x1c", "!", "1", "'s", "漢", " ", "\r", "x" * 300, *m.special]
    texts = ["", *("".join(r.choice(bits) for _ in range(r.randrange(25))) for _ in range(3000)), ""]
    want = [e.ids for e in m.lib.encode_batch(texts, add_special_tokens=False)]
    ids, at = m.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert m.counts(texts) == [len(x) for x in want]
