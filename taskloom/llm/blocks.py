"""Leaf blocks of a web page: texts between block tags, with the tags, classes and roles above them.

Tolerant of broken markup: unclosed paragraphs, items and cells end where the next one begins, end tags without a start are
ignored, a tag cut off by the end of the page ends there, and a ``<`` that opens no tag is text.  Comments, scripts, styles
and other raw elements give no text.  Inline tags leave a block whole; a line break is white space.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
#: Elements whose content isn't markup or isn't shown: fixed values of HTML.
RAW = frozenset("script style title textarea noscript template iframe svg xmp noembed noframes object math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends an open element of these names, unless one of the bounds lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_P_BOUNDS = frozenset({"td", "th", "caption", "button", "table", "html"})
#: Ancestors that a block's path names, from inside and from outside.
INNER, OUTER = 24, 8


@dataclass
class Block:
    text: str
    path: list[str]
    linked: int  # characters inside links
    parts: list[str] = field(default_factory=list, repr=False)


def _names(tag: str, attributes: str) -> list[str]:
    """What one element adds to the path: its tag, and the words of its class, id and role."""
    out = [tag]
    for found in NAMED.findall(attributes):
        out += ["." + w.lower() for w in WORD.findall("".join(found))[:12]]
    return out


class _Page:
    def __init__(self):
        self.stack: list[tuple[str, list[str]]] = []
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.linked = 0
        self.path: list[str] = []
        self.blocks: list[Block] = []

    def text(self, raw: str) -> None:
        if not self.parts:
            own = self.stack if len(self.stack) <= INNER + OUTER else self.stack[:OUTER] + self.stack[-INNER:]
            self.path = [n for _, names in own for n in names]
        self.parts.append(raw)
        if self.open["a"]:
            self.linked += len(raw)

    def close(self) -> None:
        """Ends the block."""
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append(Block(text, self.path, min(self.linked, len(text))))
            self.parts, self.linked = [], 0

    def pop(self, names: set[str] | frozenset[str], bounds=frozenset()) -> None:
        """Ends the nearest open element of ``names`` and all inside it, if no bound lies between."""
        if not any(self.open[n] for n in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                for tag, _ in self.stack[i:]:
                    self.open[tag] -= 1
                del self.stack[i:]
                return
            if self.stack[i][0] in bounds:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.close()
            self.pop({"p"}, _P_BOUNDS)
            if tag in ENDS:
                self.pop(*ENDS[tag])
        elif tag == "br":
            self.parts and self.parts.append(" ")
        elif tag == "a":
            self.pop({"a"}, BLOCK)
        if tag not in VOID and not attributes.endswith("/"):
            self.stack.append((tag, _names(tag, attributes)))
            self.open[tag] += 1

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.close()
        self.pop({tag}, frozenset() if tag in BLOCK else BLOCK)


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks of a page, in order."""
    if not page:
        return []
    out, at = _Page(), 0
    while True:
        m = TAG.search(page, at)
        if m is None:
            break
        if m.start() > at:
            out.text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            out.end(tag)
        elif tag in RAW and not m[3].endswith("/"):
            over = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            at = over.start() if over else len(page)
        else:
            out.start(tag, m[3])
    if at < len(page):
        out.text(page[at:])
    out.close()
    return out.blocks
