"""The piece encoder cuts a batch's texts in groups of bounded size, with the library's ids."""

import numpy as np

from taskloom.llm.queries import vocabulary
from taskloom.llm.tokenizers_public import PieceModel


def test_a_batch_of_new_words_is_cut_in_groups():
    m = PieceModel(vocabulary("piece_bpe_32k.model"))
    texts = [" ".join(f"w{k}x{i}" for i in range(12_000)) for k in range(30)] + ["", " a  b", "ü" * 70]
    assert sum(map(len, texts)) > 2_500_000
    sizes, learn = [], m._learn
    m._learn = lambda new: (sizes.append(sum(map(len, new))), learn(new))
    got = m.encode(texts)
    # a group's own bound, and the mark that each word opens with
    assert max(sizes) < 1_250_000 and sum(sizes) > 2_500_000
    assert len(got) == len(texts)
    for k in (0, 15, 29, 30, 31, 32):
        assert np.frombuffer(got[k], "<u4").tolist() == m.lib.encode(texts[k])
