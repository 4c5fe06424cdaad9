"""The public tokenizers' vocabularies as prefix tables, with word caches that live as long as a Python worker.

A text is cut where no token can reach across: before a space that follows something that isn't white
space.  The parts repeat, so most come from the cache; new ones of a whole batch are encoded together.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex

from .prefix_bpe import PrefixBpe

SPACE = "▁"
#: Bytes that a worker's cache holds by estimate before it is emptied, and code points of the longest entry.  They bound
#: memory only: results don't depend on them.
CACHE_BYTES = 96_000_000
PIECE_CACHE_BYTES = 56_000_000
LONGEST = 64
#: What an entry takes besides four bytes for each code point and id.
_ENTRY = 200
#: Split pattern of the byte-level vocabularies: fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
CHUNK = 400_000  # symbols encoded at once
#: Code points of texts that the piece encoder holds cut into words at once (a longer single text alone).
CUT_AT_ONCE = 1_000_000
CUT = re.compile(r"\s*\S+|\s+")
ODD = re.compile("[\x1c-\x1f]")


def text_buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string or binary array without nulls."""
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    _, offsets, data = values.buffers()
    if not len(values) or data is None:
        return np.zeros(len(values) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    where = np.frombuffer(offsets, np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return where - where[0], np.frombuffer(data, np.uint8)[where[0] : where[-1]]


def _chunks(words: list[str]):
    part, size = [], 0
    for w in words:
        part.append(w)
        size += len(w)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


class PieceModel:
    """A sentencepiece BPE model: encoding by prefix table, decoding by the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.lib
        kinds = [i for i in range(lib.vocab_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        text = [lib.id_to_piece(i) for i in kinds]
        if any(re.search(f"[^{SPACE}]{SPACE}", t) for t in text):
            raise ValueError("a piece reaches across words")
        score = [-lib.get_score(i) for i in kinds]
        place = {s: r for r, s in enumerate(sorted(set(score)))}
        self.ids = np.array(kinds + [0], dtype="<u4")
        # runs of spaces share one score, for which the prefix table isn't defined; they are merged step by step
        plain = [k for k, t in enumerate(text) if SPACE + SPACE not in t]
        self.bpe = PrefixBpe([text[k] for k in plain], [place[score[k]] for k in plain])
        self.bpe_ids = self.ids[plain + [len(text)]]
        self.rank = {t: place[s] for t, s in zip(text, score)}
        self.id = dict(zip(text, kinds))
        self.byte = {b: lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def _merge(self, word: str) -> list[str]:
        """Merges pair by pair, for words that open with several spaces."""
        part = list(word)
        while True:
            best = min(((self.rank[part[i] + part[i + 1]], i) for i in range(len(part) - 1) if part[i] + part[i + 1] in self.rank), default=None)
            if best is None:
                return part
            part[best[1] : best[1] + 2] = [part[best[1]] + part[best[1] + 1]]

    def _bytes(self, parts: list[str]) -> bytes:
        out: list[int] = []
        for p in parts:
            out += [self.id[p]] if p in self.id else [self.byte[b] for b in p.encode()]
        return np.array(out, dtype="<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        for w in new:
            if w.startswith(SPACE + SPACE):
                # a long run stays cheap: what stands after it can't merge with more than its last space
                self.cache[w] = self._bytes(self._runs(w))
        for part in _chunks([w for w in new if not w.startswith(SPACE + SPACE)]):
            tokens, at = self.bpe.encode(part)
            ids = self.bpe_ids[tokens]
            odd = np.flatnonzero(tokens == self.bpe.unknown)
            odd_words = set(np.searchsorted(at, odd, side="right") - 1)
            for k, w in enumerate(part):
                if k in odd_words:
                    out, place = [], 0
                    for t, i in zip(tokens[at[k] : at[k + 1]], ids[at[k] : at[k + 1]]):
                        size = int(self.bpe.length[t])
                        out += [self.byte[b] for b in w[place : place + size].encode()] if t == self.bpe.unknown else [int(i)]
                        place += size
                    self.cache[w] = np.array(out, dtype="<u4").tobytes()
                else:
                    self.cache[w] = ids[at[k] : at[k + 1]].tobytes()

    def _runs(self, word: str) -> list[str]:
        return self._merge(word) if len(word) <= 100 else self._long(word)

    def _long(self, word: str) -> list[str]:
        """A run of hundreds of spaces: a heap of candidate merges instead of a scan for each."""
        import heapq

        part: list[str | None] = list(word)
        nxt, prv = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(self.rank[a + b], i, a, b) for i, (a, b) in enumerate(zip(part, part[1:])) if a + b in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            part[i], part[j] = a + b, None
            nxt[i] = nxt[j]
            if nxt[j] < len(part):
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < len(part) and part[x] + part[y] in self.rank:
                    heapq.heappush(heap, (self.rank[part[x] + part[y]], x, part[x], part[y]))
        return [p for p in part if p is not None]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without begin and end ids."""
        out: list[bytes] = []
        begin = held = 0
        for i, t in enumerate(texts):
            if held and held + len(t) > CUT_AT_ONCE:
                out += self._encode(texts[begin:i])
                begin, held = i, 0
            held += len(t)
        return out + self._encode(texts[begin:])

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = []
        for t in texts:
            if not t:
                cut.append([])
            elif SPACE in t or "  " in t or t[0] == " ":
                cut.append(re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + t.replace(" ", SPACE)))
            else:
                cut.append((SPACE + t.replace(" ", " " + SPACE)).split(" "))
        cache = self.cache
        if self.held > PIECE_CACHE_BYTES:
            cache.clear()
            self.held = 0
        new = set()
        for c in cut:
            new.update(c)
        new.difference_update(cache)
        new = list(new)
        self._learn(new)
        out = [b"".join(map(cache.__getitem__, c)) for c in cut]
        for w in new:
            if len(w) > LONGEST:
                del cache[w]
            else:
                self.held += 4 * len(w) + len(cache[w]) + _ENTRY
        return out

    def decode(self, ids: bytes) -> str:
        return self.lib.decode(np.frombuffer(ids, dtype="<u4").tolist())


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


class ByteModel:
    """A byte-level BPE vocabulary in the tokenizers library's file format."""

    def __init__(self, path: str, specials: bool = True):
        """``specials``: whether special strings inside texts are special, as the library has it by default."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", [])):
            raise ValueError("special tokens that take white space aren't supported")
        if any(re.search(r"\s", t) for t in self.special):
            raise ValueError("special tokens with white space aren't supported")
        shown = self._alphabet()
        plain = sorted((i, t) for t, i in vocab.items() if t not in self.special)
        index = {t: k for k, (_, t) in enumerate(plain)}
        rank = [0] * len(plain)
        splits = {}
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            if a + b in index:
                rank[index[a + b]] = r
                splits[index[a + b]] = (index[a], index[b])
        self.bpe = PrefixBpe(["".join(map(shown.__getitem__, t)) for _, t in plain], rank, splits)
        self.ids = np.array([i for i, _ in plain] + [0], dtype="<u4")
        self.split = regex.compile(SPLIT)
        self.run = regex.compile(r"\s{2,}")
        self.apart = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special and specials else None
        self.cache: dict[str, int] = {}
        self.held = 0
        self.path = path
        self.specials = specials

    @cached_property
    def lib(self):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        made.encode_special_tokens = not self.specials
        return made

    @cached_property
    def n_bytes(self) -> np.ndarray:
        """Bytes of text that each id stands for."""
        out = np.zeros(self.lib.get_vocab_size(), dtype=np.int64)
        for t, i in self.lib.get_vocab().items():
            out[i] = len(t.encode()) if t in self.special else len(t)
        return out

    @cached_property
    def bytes_of(self) -> list[bytes]:
        """What each id stands for."""
        shown = self._alphabet()
        out = [b""] * self.lib.get_vocab_size()
        for t, i in self.lib.get_vocab().items():
            out[i] = t.encode() if t in self.special else "".join(map(shown.__getitem__, t)).encode("latin-1")
        return out

    @staticmethod
    def _alphabet() -> dict[str, str]:
        """Printable stand-ins of the file format, each to the byte it stands for (as a code point)."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        return {chr(b): chr(b) for b in own} | {chr(256 + k): chr(b) for k, b in enumerate(rest)}

    def pretokens(self, text: str) -> list[str]:
        """The library's words; special strings stay whole."""
        if self.apart is None or not self.apart.search(text):
            return self.split.findall(text)
        out: list[str] = []
        for part in self.apart.split(text):
            out += [part] if part in self.special else self.split.findall(part)
        return out

    @staticmethod
    def _symbols(word: str) -> str:
        return word.encode().decode("latin-1")

    def parts(self, texts: list[str]) -> list[list[str]]:
        """Each text cut before white space that follows something else: no word of the split pattern reaches across.

        Texts with information separators stay whole (Python takes them for white space, the pattern doesn't).
        """
        return [[t] if ODD.search(t) else CUT.findall(t) for t in texts]

    def counts(self, texts: list[str]) -> list[int]:
        cut, cache = self.parts(texts), self.cache
        if self.held > CACHE_BYTES:
            cache.clear()
            self.held = 0
        new = set()
        for c in cut:
            new.update(c)
        new.difference_update(cache)
        cache.update(self._count(list(new)))
        out = [sum(map(cache.__getitem__, c)) for c in cut]
        for w in new:
            if len(w) > LONGEST:
                del cache[w]
            else:
                self.held += 4 * len(w) + _ENTRY
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of all texts (an Arrow string array), one after the other, and where each text's ids begin.

        Texts are cut, as bytes, before an ASCII space, tab or line end that follows something that is surely not white
        space: no word of the split pattern and no special string reaches across.  Distinct parts are encoded once, most
        of them put together in long texts, and all texts' ids are gathered from theirs.
        """
        where, data = text_buffers(texts)
        n = len(data)
        white = (data == 32) | (data == 9) | (data == 10) | (data == 13)
        cut = np.zeros(n + 1, dtype=bool)
        if n > 1:
            sure = ((data > 32) & (data < 127)) | (data >= 128)
            # two- and three-byte white space characters begin with these
            sure[1:] &= (data[1:] < 128) | (data[:-1] != 0xC2)
            sure[2:] &= (data[2:] < 128) | ((data[:-2] < 0xE1) | (data[:-2] > 0xE3))
            cut[1:n] = white[1:] & sure[:-1]
        cut[where] = True
        cut[n] = False
        starts = np.append(np.flatnonzero(cut), n)
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        index, known = parts.indices.to_numpy(), parts.dictionary
        p_where, p_data = text_buffers(known)
        if len(known) and p_where[-1] == 0:
            raise ValueError("a part is empty")
        first, last = p_data[p_where[:-1]], p_data[p_where[1:] - 1]
        joins = np.isin(first, [32, 9, 10, 13]) & (last > 32) & (last < 127)
        size = np.zeros(len(known), dtype=np.int64)
        begin = np.zeros(len(known), dtype=np.int64)
        flat, held = [], 0
        # parts that can stand together
        some = np.flatnonzero(joins)
        j_where, j_data = text_buffers(known.filter(pa.array(joins)))
        at = 0
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(j_where, j_where[at] + 200_000)) - 1)
            to = min(to, len(some))
            (made,) = self.lib.encode_batch_fast([j_data[j_where[at] : j_where[to]].tobytes().decode()], add_special_tokens=False)
            ids = np.array(made.ids, dtype="<u4")
            ends, want = np.cumsum(self.n_bytes[ids]), j_where[at + 1 : to + 1] - j_where[at]
            upto = np.searchsorted(ends, want)
            if upto[-1] >= len(ends) or (ends[upto] != want).any():
                raise ValueError("the vocabulary joins words")
            size[some[at:to]] = np.diff(upto + 1, prepend=0)
            begin[some[at:to]] = held + np.concatenate([[0], upto[:-1] + 1])
            flat.append(ids)
            held += len(ids)
            at = to
        alone = np.flatnonzero(~joins)
        for at in range(0, len(alone), 1000):
            some = alone[at : at + 1000]
            for k, made in zip(some, self.lib.encode_batch_fast([x.decode() for x in known.take(pa.array(some)).to_pylist()], add_special_tokens=False)):
                size[k], begin[k] = len(made.ids), held
                flat.append(np.array(made.ids, dtype="<u4"))
                held += len(made.ids)
        pool = np.concatenate(flat) if flat else np.zeros(0, dtype="<u4")
        lengths = size[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = pool[np.repeat(begin[index] - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(starts, where)] if n else np.zeros(len(where), dtype=np.int64)

    def _count(self, words: list[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        flat, owner = [], []
        for w in words:
            out[w] = 0
            for p in self.pretokens(w):
                if p in self.special:
                    out[w] += 1
                else:
                    flat.append(self._symbols(p))
                    owner.append(w)
        at = 0
        for part in _chunks(flat):
            for w, c in zip(owner[at : at + len(part)], self.bpe.counts(part).tolist()):
                out[w] += c
            at += len(part)
        return out

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of ``text[:p]`` for every p from 0 to its length, each as the library would count that prefix alone.

        A prefix is cut into the same words as the text up to the one it ends in, and that one's prefix table has its
        count, but for three kinds of place that are set right after: inside a run of white space (which at an end of text
        is one word), inside a contraction, and inside a special string (which is ordinary text until it is whole).  Each
        place costs a bounded share of the word or run it is in, so the whole is linear in the text.
        """
        out = np.zeros(len(text) + 1, dtype=np.int64)
        runs: list[tuple[int, str]] = []  # white space of two and more
        torn: list[tuple[int, int, int, str]] = []  # special strings, and where the word before begins and how many tokens precede it
        place = total = anchor = ahead = 0
        for piece in self.apart.split(text) if self.apart is not None else [text]:
            end = place + len(piece)
            if self.apart is not None and piece in self.special:
                torn.append((anchor, ahead, place, piece))
                total += 1
                out[end] = total
                anchor, ahead = end, total
            elif piece:
                words = self.split.findall(piece)
                at = 0
                while at < len(words):
                    some, size = [], 0
                    while at < len(words) and (not some or size < CHUNK):
                        some.append(words[at])
                        size += len(words[at])
                        at += 1
                    here = place
                    place += size
                    first, _, count = self.bpe.tables([self._symbols(w) for w in some])
                    code = np.frombuffer("".join(some).encode("utf-32-le"), dtype=np.uint32)
                    ends = np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
                    whole = np.where(np.diff(first) > 0, count[first[1:]], 0)
                    before = np.concatenate([[0], np.cumsum(whole)])
                    out[here + 1 : here + size + 1] = total + before[np.searchsorted(first, ends - 1, side="right") - 1] + count[ends]
                    starts = here + np.concatenate([[0], np.cumsum([len(w) for w in some])])
                    for k, w in enumerate(some):
                        if len(w) == 3 and w in CONTRACTIONS:
                            out[starts[k] + 2] = out[starts[k]] + 2  # the mark and one letter: a token each
                    anchor, ahead = int(starts[-2]), total + int(before[-2])
                    total += int(before[-1])
                base = end - len(piece)
                runs += [(base + m.start(), m[0]) for m in self.run.finditer(piece)]
            place = end
        at = 0
        while at < len(runs):
            some, size = [], 0
            while at < len(runs) and (not some or size < CHUNK):
                some.append(runs[at])
                size += len(runs[at][1])
                at += 1
            first, _, count = self.bpe.tables([self._symbols(w) for _, w in some])
            for (start, w), a in zip(some, first):
                out[start + 1 : start + len(w) + 1] = out[start] + count[a + np.cumsum([len(c.encode()) for c in w])]
        for start, ahead, place, s in torn:
            for k in range(place + 1, place + len(s)):
                out[k] = ahead + sum(self._count([text[start:k]]).values())
        return out


@lru_cache(maxsize=4)
def byte_model(path: str, specials: bool = True) -> ByteModel:
    return ByteModel(path, specials)
