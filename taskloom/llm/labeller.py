"""A recurrent block labeller in numpy: a bidirectional LSTM over a page's leaf blocks.

A block's input is the bag of its hashed tag-path names, the bag of its hashed words, and a few figures of its text and
place.  Every block's verdict draws on all blocks before and after it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .blocks import Block

PATH, WORDS, FIGURES = 512, 128, 10
SIZE = PATH + WORDS + FIGURES
HIDDEN = 16
#: Blocks that are run together.
BATCH = 20_000
_PUNCT = re.compile(r"[.!?…。:;]$")


@lru_cache(maxsize=1 << 17)
def _word(w: str) -> int:
    return zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS


@lru_cache(maxsize=1 << 16)
def _name(n: str) -> int:
    return zlib.crc32(n.encode("utf-8", "surrogatepass")) % PATH


def inputs(page: list[Block]) -> np.ndarray:
    """A row of ``SIZE`` figures for each block."""
    n = len(page)
    out = np.zeros((n, SIZE), dtype=np.float32)
    for i, b in enumerate(page):
        last = len(b.path) - 1 - next((k for k, x in enumerate(reversed(b.path)) if x[0] != "."), 0)
        out[i, [_name(x) for x in b.path]] = 1.0
        # the innermost element once more, under a name of its own
        out[i, [_name("in " + x) for x in b.path[max(last, 0) :]]] = 1.0
        words = b.text.split()
        out[i, PATH : PATH + WORDS] = np.minimum(np.bincount(np.fromiter(map(_word, words), np.int64, len(words)), minlength=WORDS), 4) / math.sqrt(len(words))
        out[i, PATH + WORDS :] = (
            math.log1p(len(b.text)) / 8, math.log1p(len(words)) / 6, b.linked / len(b.text), bool(_PUNCT.search(b.text)), i / n, (n - 1 - i) / n,
            sum(map(str.isdigit, b.text[:200])) / min(len(b.text), 200), b.text[0].isupper(), len(words) > 20, math.log1p(n) / 6,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sequence of (time, page, ...) back to front; padding stays behind."""
    t = np.arange(x.shape[0])[:, None]
    return np.take_along_axis(x, np.where(t < lengths, lengths - 1 - t, t).reshape(*x.shape[:2], *[1] * (x.ndim - 2)), axis=0)


def _forward(z: np.ndarray, u: np.ndarray, mask: np.ndarray):
    """States of one direction for inputs ``z`` (time, page, 4 gates), and what the way back needs."""
    steps, pages, _ = z.shape
    h, c = np.zeros((pages, HIDDEN), z.dtype), np.zeros((pages, HIDDEN), z.dtype)
    states, kept = np.zeros((steps, pages, HIDDEN), z.dtype), []
    for t in range(steps):
        g = z[t] + h @ u
        i, f, o, n = _sigmoid(g[:, :HIDDEN]), _sigmoid(g[:, HIDDEN : 2 * HIDDEN]), _sigmoid(g[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
        new = f * c + i * n
        kept.append((h, c, i, f, o, n, new))
        m = mask[t][:, None]
        c, h = np.where(m, new, c), np.where(m, o * np.tanh(new), h)
        states[t] = h
    return states, kept


def _backward(grad: np.ndarray, kept: list, u: np.ndarray, mask: np.ndarray):
    """Gradients of the inputs and of ``u``."""
    steps, pages, _ = grad.shape
    dz, du = np.zeros((steps, pages, 4 * HIDDEN), grad.dtype), np.zeros_like(u)
    dh, dc = np.zeros((pages, HIDDEN), grad.dtype), np.zeros((pages, HIDDEN), grad.dtype)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, n, new = kept[t]
        m = mask[t][:, None]
        dh = dh + grad[t]
        th = np.tanh(new)
        d = np.where(m, dc + dh * o * (1 - th * th), 0)
        g = np.concatenate([d * n * i * (1 - i), d * c * f * (1 - f), np.where(m, dh * th * o * (1 - o), 0), d * i * (1 - n * n)], axis=1)
        dz[t] = g
        du += h.T @ g
        dh = np.where(m, 0, dh) + g @ u.T
        dc = np.where(m, d * f, dc)
    return dz, du


class Labeller:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        bias = np.zeros(8 * HIDDEN)
        bias[HIDDEN : 2 * HIDDEN] = bias[5 * HIDDEN : 6 * HIDDEN] = 1.0  # remembers at first
        return cls({"x": rng.normal(0, 0.1, (SIZE, 8 * HIDDEN)), "b": bias, "u": rng.normal(0, 0.2, (2, HIDDEN, 4 * HIDDEN)), "v": rng.normal(0, 0.2, 2 * HIDDEN), "c": np.zeros(1)})

    def _run(self, pages: list[np.ndarray]):
        w, lengths = self.w, np.array([len(p) for p in pages])
        flat = np.concatenate(pages).astype(w["x"].dtype)
        steps, at = int(lengths.max()), np.concatenate([[0], np.cumsum(lengths)])
        where = (np.arange(len(flat)) - np.repeat(at[:-1], lengths), np.repeat(np.arange(len(pages)), lengths))
        z = np.zeros((steps, len(pages), 8 * HIDDEN), flat.dtype)
        z[where] = flat @ w["x"] + w["b"]
        mask = np.arange(steps)[:, None] < lengths
        one, k1 = _forward(z[:, :, : 4 * HIDDEN], w["u"][0], mask)
        two, k2 = _forward(_turned(z[:, :, 4 * HIDDEN :], lengths), w["u"][1], mask)
        states = np.concatenate([one, _turned(two, lengths)], axis=2)
        return states[where] @ w["v"] + w["c"], (flat, where, mask, lengths, states, k1, k2)

    def scores(self, pages: list[np.ndarray]) -> Iterator[np.ndarray]:
        """Log-odds of each block, page by page in the given order; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        some: list[int] = []
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        for k, i in enumerate(order):
            some.append(i)
            if k + 1 == len(order) or (len(some) + 1) * len(pages[order[k + 1]]) > BATCH:
                made, _ = self._run([pages[j] for j in some])
                for j, s in zip(some, np.split(made, np.cumsum([len(pages[j]) for j in some])[:-1])):
                    out[j] = s
                some = []
        return iter(out)

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int, seed: int, rate: float = 0.01, group: int = 32) -> Labeller:
        """Adam on the logistic loss; a label of -1 counts for nothing."""
        rng, w = np.random.default_rng(seed), self.w
        first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
        lengths = np.array([len(p) for p in pages])
        for epoch in range(epochs):
            order = np.argsort(lengths + rng.uniform(0, 8, len(pages)), kind="stable")
            cuts = [order[i : i + group] for i in range(0, len(order), group)]
            for k in rng.permutation(len(cuts)):
                some = cuts[k]
                made, (flat, where, mask, n, states, k1, k2) = self._run([pages[i] for i in some])
                want = np.concatenate([labels[i] for i in some])
                d = np.where(want >= 0, _sigmoid(made) - want, 0) / max(1, (want >= 0).sum())
                own = states[where]
                ds = np.zeros_like(states)
                ds[where] = d[:, None] * w["v"]
                z1, u1 = _backward(ds[:, :, :HIDDEN], k1, w["u"][0], mask)
                z2, u2 = _backward(_turned(ds[:, :, HIDDEN:], n), k2, w["u"][1], mask)
                dz = np.concatenate([z1, _turned(z2, n)], axis=2)[where]
                grads = {"x": flat.T @ dz + 1e-6 * w["x"], "b": dz.sum(0), "u": np.stack([u1, u2]), "v": own.T @ d, "c": d.sum(keepdims=True)}
                size = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                now = rate * (0.5 ** (epoch * 4 // epochs)) * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for name, g in grads.items():
                    g = g / max(1.0, size)
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.001 * (g * g - second[name])
                    w[name] -= now * first[name] / (np.sqrt(second[name]) + 1e-8)
        return self

    def packed(self) -> dict[str, np.ndarray]:
        return {k: v.astype(np.float32) for k, v in self.w.items()}
