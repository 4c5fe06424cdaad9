"""Byte-pair encoding by a prefix table, for many words at once in numpy.

For every prefix of a word there is exactly one token that ends its encoding.  The table of these last
tokens is filled from left to right: an automaton over the vocabulary gives all tokens that end at a
place, and one of them is right if the prefix before it ends in a token that the pair test accepts.  The
ids are then read backwards through the table, and counts for every prefix come with it.

The pair test asks whether merging, by rank, ever joins anything across the seam of two tokens.  It runs
both tokens' merges backwards in time and looks, at each step, for a merge across the seam that would
have come first.
"""

from __future__ import annotations

import numpy as np

NEVER = np.int64(1) << 40
_CHAR = 21  # bits of a code point


class PrefixBpe:
    """``pieces``: text of each token (one code point is one symbol); ``rank``: order of its merge (lower first).

    ``splits``: for explicit merges, the two parts of each token of two or more symbols (None where a
    token has no merge); without it every pair of pieces whose join is a piece can merge.
    """

    def __init__(self, pieces: list[str], rank: list[int], splits: dict[int, tuple[int, int]] | None = None):
        n = self.n = len(pieces)
        self.unknown = n
        self.length = np.array([len(p) for p in pieces] + [1], dtype=np.int64)
        self.rank = np.array([r if len(p) > 1 else -1 for p, r in zip(pieces, rank)] + [-1], dtype=np.int64)
        self.left = np.full(n + 1, -1, dtype=np.int64)
        self.right = np.full(n + 1, -1, dtype=np.int64)
        index = {p: i for i, p in enumerate(pieces)}
        if splits is not None:
            made = np.array([(i, a, b) for i, (a, b) in splits.items()], dtype=np.int64).reshape(-1, 3)
            self._pairs(made)
            self.left[made[:, 0]], self.right[made[:, 0]] = made[:, 1], made[:, 2]
            usable = (self.length[:n] == 1) | (self.left[:n] >= 0)
        else:
            made = np.array([(i, index[p[:k]], index[p[k:]]) for i, p in enumerate(pieces) for k in range(1, len(p)) if p[:k] in index and p[k:] in index], dtype=np.int64).reshape(-1, 3)
            self._pairs(made)
            usable = self._derive(made)
        self._automaton(pieces, usable)

    def _pairs(self, made: np.ndarray) -> None:
        key = made[:, 1] * (self.n + 1) + made[:, 2]
        order = np.argsort(key, kind="stable")
        self.pair_key = np.append(key[order], np.int64(2) ** 62)
        self.pair_rank = np.append(self.rank[made[order, 0]], NEVER)

    def _derive(self, made: np.ndarray) -> np.ndarray:
        """The split of every piece that merging its own symbols ends with; pieces it never reaches are unusable."""
        usable = self.length[: self.n] == 1
        size = self.length[made[:, 0]]
        for length in np.unique(size):
            part = made[size == length]
            part = part[usable[part[:, 1]] & usable[part[:, 2]]]
            fits = part[self.compatible(part[:, 1], part[:, 2], 2 * self.rank[part[:, 0]])]
            self.left[fits[:, 0]], self.right[fits[:, 0]] = fits[:, 1], fits[:, 2]
            usable[fits[:, 0]] = True
        return usable

    def compatible(self, left: np.ndarray, right: np.ndarray, limit=None) -> np.ndarray:
        """Whether two tokens stay apart side by side (up to the merge at ``limit``, twice its rank)."""
        ok = np.ones(len(left), dtype=bool)
        at = np.arange(len(left))
        lim = np.full(len(left), 2 * NEVER) if limit is None else limit
        while len(at):
            key = left * (self.n + 1) + right
            found = np.searchsorted(self.pair_key, key)
            bad = (self.pair_key[found] == key) & (2 * self.pair_rank[found] < lim)
            ok[at[bad]] = False
            rl, rr = self.rank[left], self.rank[right]
            go = np.flatnonzero(~bad & ((rl >= 0) | (rr >= 0)))
            at, left, right, rl, rr = at[go], left[go], right[go], rl[go], rr[go]
            undo = rl > rr  # of equal merges the left one comes first, so the right one is undone first
            lim = np.where(undo, 2 * rl, 2 * rr + 1)
            left, right = np.where(undo, self.right[left], left), np.where(undo, right, self.left[right])
        return ok

    def _automaton(self, pieces: list[str], usable: np.ndarray) -> None:
        edges: dict[int, int] = {}
        token = [-1]
        for i, p in enumerate(pieces):
            if not usable[i]:
                continue
            node = 0
            for c in p:
                key = (node << _CHAR) | ord(c)
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(token)
                    token.append(-1)
            token[node] = i
        keys = np.fromiter(edges.keys(), dtype=np.int64, count=len(edges))
        order = np.argsort(keys)
        self.edge_key = np.append(keys[order], np.int64(2) ** 62)
        self.edge_to = np.append(np.fromiter(edges.values(), dtype=np.int64, count=len(edges))[order], 0)
        self.node_token = np.array(token, dtype=np.int64)

    def _matches(self, chars: np.ndarray, stop: np.ndarray):
        """All tokens (start, end, token) inside words; a symbol that is no token counts as the unknown token."""
        start = np.arange(len(chars))
        node = np.zeros(len(chars), dtype=np.int64)
        found, step = [], 0
        while len(start):
            key = (node << _CHAR) | chars[start + step]
            at = np.searchsorted(self.edge_key, key)
            hit = self.edge_key[at] == key
            node = np.where(hit, self.edge_to[at], 0)
            token = np.where(hit, self.node_token[node], -1)
            if step == 0:
                token = np.where(token < 0, self.unknown, token)
            good = token >= 0
            found.append((start[good], start[good] + step + 1, token[good]))
            step += 1
            on = hit & (start + step < stop[start])
            start, node = start[on], node[on]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def tables(self, words: list[str]):
        """For words end to end: first place of each, last token and token count of each prefix (by its end)."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        begin, stop = np.repeat(first[:-1], size), np.repeat(first[1:], size)
        last = np.full(len(chars) + 1, -1, dtype=np.int64)
        count = np.zeros(len(chars) + 1, dtype=np.int64)
        s, e, t = self._matches(chars, stop)
        inner = e - begin[s]
        order = np.argsort(inner, kind="stable")
        s, e, t, inner = s[order], e[order], t[order], inner[order]
        cuts = np.flatnonzero(np.diff(inner)) + 1
        for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(s)]])):
            if a == b:
                continue
            s_, e_, t_ = s[a:b], e[a:b], t[a:b]
            opens = s_ == begin[s_]
            before = np.where(opens, -1, last[s_])
            ask = np.flatnonzero(~opens & (before >= 0))
            ok = opens.copy()
            if len(ask):
                pair, back = np.unique(before[ask] * (self.n + 1) + t_[ask], return_inverse=True)
                ok[ask] = self.compatible(pair // (self.n + 1), pair % (self.n + 1))[back]
            last[e_[ok]] = t_[ok]
            count[e_[ok]] = np.where(opens[ok], 0, count[s_[ok]]) + 1
        return first, last, count

    def encode(self, words: list[str]):
        """Tokens of all words end to end, and where each word's tokens begin."""
        first, last, _ = self.tables(words)
        word = np.flatnonzero(np.diff(first) > 0)
        at = first[word + 1].copy()
        whose, places, tokens = [], [], []
        while len(word):
            t = last[at]
            whose.append(word)
            places.append(at)
            tokens.append(t)
            at = at - self.length[t]
            on = at > first[word]
            word, at = word[on], at[on]
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        whose, places, tokens = map(np.concatenate, (whose, places, tokens))
        order = np.argsort(places)
        return tokens[order], np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(words)))])

    def counts(self, words: list[str]) -> np.ndarray:
        first, _, count = self.tables(words)
        return np.where(np.diff(first) > 0, count[first[1:]], 0)
