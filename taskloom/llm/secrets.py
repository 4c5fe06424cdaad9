"""Secret scan: a keyword automaton finds where to look, anchored patterns match only there, checksums confirm.

One automaton runs over the text with A-Z in lower case for the keywords of the patterns that ignore
case, one over the text itself for the rest.  For runs of hex digits the keywords are all four-digit hex
strings, built by rule.  Candidates are tried from left to right and never inside an earlier match of the
same kind, which gives what a plain left-to-right search would.

Kinds beyond the base ones: ``github`` and ``npm`` tokens, whose last six characters are a base-62 CRC32
of the rest; ``jwt`` with a header that decodes to JSON with "alg"; ``pem`` private key blocks.

Null text is empty and has no spans; repeated rows are scanned each; spans of different kinds may overlap
(redaction joins them); extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import itertools
import json
import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame

from .arrow import map_texts

#: Patterns and least lengths of the base kinds: fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]+")
HEX_LEAST = 16

GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+")
_JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
#: Headers of the body may hold "-"; it ends before another block begins, so blocks without an end cost no second scan.
PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?!-----BEGIN ).)+?-----END [A-Z ]{0,40}PRIVATE KEY-----", re.S)
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = ("assign", "access", "hex")
MASK = "[SECRET]"


def _base62(n: int) -> str:
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    out = ""
    for _ in range(6):
        n, k = divmod(n, 62)
        out = digits[k] + out
    return out


def checksum_ok(token: str) -> bool:
    """Whether the last six characters are the base-62 CRC32 of those after the prefix."""
    body = token.partition("_")[2]
    return body[-6:] == _base62(zlib.crc32(body[:-6].encode()))


def jwt_ok(token: str) -> bool:
    head = token.partition(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, TypeError):
        return False


@lru_cache(maxsize=1)
def automata():
    import ahocorasick

    folded, exact = ahocorasick.Automaton(), ahocorasick.Automaton()
    for w in ASSIGN_WORDS:
        folded.add_word(w, (len(w), "assign"))
    for four in itertools.product("0123456789abcdef", repeat=4):
        exact.add_word("".join(four), (4, "hex"))
    for w, kind in [("AKIA", "access"), *((f"gh{c}_", "github") for c in "pousr"), ("npm_", "npm"), ("eyJ", "jwt"), ("-----BEGIN ", "pem")]:
        exact.add_word(w, (len(w), kind))
    folded.make_automaton()
    exact.make_automaton()
    return folded, exact


#: Kind: pattern, and what a match must pass.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= ASSIGN_LEAST),
    "access": (ACCESS, lambda m: len(m[0]) >= ACCESS_LEAST),
    "hex": (HEX, lambda m: len(m[0]) >= HEX_LEAST),
    "github": (GITHUB, lambda m: checksum_ok(m[0])),
    "npm": (NPM, lambda m: checksum_ok(m[0])),
    "jwt": (JWT, lambda m: jwt_ok(m[0])),
    "pem": (PEM, lambda m: True),
}


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points, by start, then kind as listed."""
    folded, exact = automata()
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    near: dict[str, list[int]] = {}
    for source, automaton in ((low, folded), (text, exact)):
        for end, (size, kind) in automaton.iter(source):
            near.setdefault(kind, []).append(end + 1 - size)
    out = []
    for kind, starts in near.items():
        pattern, passes = RULES[kind]
        at = 0
        for start in sorted(starts):
            if start >= at and (m := pattern.match(text, start)):
                at = m.end()
                if passes(m):
                    out.append((start, at, kind))
            elif start >= at and kind == "jwt":
                at = _JWT_RUN.match(text, start).end()  # what fails here fails for what follows the run, from any place in it
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def mask(text: str, spans: list[tuple[int, int, str]], by: str = MASK) -> str:
    """``text`` with every span, overlapping ones together, replaced by ``by``."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], by]
            at = end
        else:
            at = max(at, end)
    return "".join(out) + text[at:]


def _listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secret_digest(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans."""

    def work(texts):
        found = [find(t) for t in texts]
        base = [[s for s in f if s[2] in BASE] for f in found]
        return {f"n_{k}": [sum(s[2] == k for s in f) for f in base] for k in BASE} | {"base_sha256": [hashlib.sha256(_listed(f).encode()).hexdigest() for f in base], "spans": [_listed(f) for f in found]}

    return map_texts(docs, text, keep or ["doc_id"], "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", work)


def redact(docs: DataFrame, text: str = "text", by: str = MASK) -> DataFrame:
    """``docs`` with secrets replaced in ``text``; null texts stay null; other columns stay as they are."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def masked(column):
        return column.map(lambda t: t if t is None else mask(t, find(t), by))

    return docs.withColumn(text, masked(F.col(text)))
