"""Main text of web pages by a recurrent block labeller.

Pages are cut into leaf blocks (``blocks``), every block of the whole page is classified by a bidirectional LSTM
(``labeller``), and the blocks that are the article's are joined by line ends.

The labeller is fitted on a bounded sample of the pages at hand: the ``SAMPLE`` different pages of least hash among those
of ``SAMPLE_BYTES`` or fewer.  Its labels come from marks that say what a part is (elements and class words, below); blocks
without such marks count for nothing.  As such marks are often missing or odd, each sampled page's text is also laid
out anew ``REDRAWN`` times, in drawn templates of known labels with menus, notices, adverts, sidebars, forms, comments and
footers around and inside the article.  Only fitting is bounded; every block of every page is classified.

Defined results: null and empty html, and pages without a block that is the article's, have empty text; a page that ends
early keeps what it has; repeated pages and null ids are rows of their own; with no page to sample only drawn words are
fitted on, and no pages give no rows; extra columns of any name are ignored.  A page of any length is linear work of one task.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import arrow_schema, slices
from .blocks import leaf_blocks
from .labeller import Labeller, inputs

SAMPLE, SAMPLE_BYTES = 192, 32_768
REDRAWN = 4
EPOCHS = 8
SEED = 20
#: What elements and class words say of the part they stand on: fixed values.
FRAME_TAGS = frozenset("nav header footer aside form menu dialog button select fieldset search".split())
FRAME_WORDS = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs topbar toolbar masthead banner header footer foot bottom sidebar side aside widget rail cookie cookies consent gdpr notice alert popup modal overlay ad ads advert "
    "advertisement adsense sponsor sponsored promo promotion newsletter subscribe signup login search form comment comments reply replies respond disqus discussion related recommended recirc share sharing social follow tags pagination pager copyright".split()
)
MAIN_TAGS = frozenset("article main".split())
MAIN_WORDS = frozenset("article content main post entry story articlebody maincontent".split())
_PHRASES = {
    "notice": ["We use cookies to improve your experience.", "This site uses cookies. Accept all", "Wir verwenden Cookies auf dieser Seite.", "Nous utilisons des cookies.", "Usamos cookies en este sitio.", "Please enable JavaScript.", "You have 3 free articles left."],
    "ad": ["Advertisement", "Sponsored", "Buy now and save 50%!", "Anzeige", "Publicité", "Publicidad", "Special offer: order today."],
    "share": ["Share on Facebook", "Tweet", "Print this page", "Email", "Like 12", "Share this article"],
    "form": ["Subscribe to our newsletter", "Enter your email", "Sign up", "Log in", "Search", "Leave a comment", "Name", "Post comment", "Submit"],
    "footer": ["© 2024 All rights reserved.", "Privacy policy", "Terms of use", "Impressum", "Contact us", "About", "Mentions légales", "Aviso legal"],
    "related": ["Related articles", "You may also like", "Most read", "Read more", "Popular posts", "Next", "Previous", "Page 2 of 9"],
    "comments": ["Comments", "3 comments", "Reply", "Great article, thanks!", "I don't agree with this at all.", "Kommentare", "Commentaires"],
}
#: Elements and classes that templates draw from.
_WRAPS = {
    "header": ["header", "div.header", "div#masthead", "div.site-header", "div.topbar", "div.banner", "table.header"],
    "menu": ["nav", "div.menu", "div#navigation", "div.navbar", "div.breadcrumbs", "nav.main-menu", "div.nav-links", "div"],
    "notice": ["div.cookie-notice", "div.cookie", "div#cookie-consent", "div.notice", "section.alert", "div.gdpr-popup", "dialog.modal", "p.notice", "div.cookie-banner"],
    "ad": ["div.ad", "div.ads", "div.advert", "aside.advertisement", "div.sponsored", "div#ad-slot-1", "section.promo", "p.ad", "div.ad-container", "div.sponsor"],
    "share": ["div.share", "div.social", "ul.sharing-buttons", "div.share-bar", "p.share"],
    "form": ["form", "div.newsletter", "form.search", "div.subscribe", "form.login-form", "section.signup"],
    "sidebar": ["aside", "div.sidebar", "div#sidebar", "aside.widget", "div.right-rail", "section.sidebar", "div.widget-area"],
    "related": ["div.related", "section.related-posts", "aside.recommended", "div.read-more", "div.pagination", "div.tags", "ul.related-articles"],
    "comments": ["div.comments", "section#comments", "div#disqus_thread", "section.comment-list", "ol.commentlist", "div.reader-comments", "div.discussion", "div#respond"],
    "footer": ["footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div#bottom", "div"],
    "main": ["article", "main", "article.post", "main#content", "div.content", "div#main", "div.post-body", "div.entry-content", "section.story", "div.article-body", "div#articleBody", "div", "section", "td", "div.text", "div.page"],
}


def marked(path: list[str]) -> int:
    """0 inside a part that frames the article, 1 inside the article, -1 where no mark says which; the innermost mark holds, but nothing inside a frame is the article."""
    inside = -1
    for name in path:
        word = name[1:]
        if name in FRAME_TAGS and not (inside == 1 and name == "header") or name[0] == "." and word in FRAME_WORDS:
            return 0
        if name in MAIN_TAGS or name[0] == "." and word in MAIN_WORDS:
            inside = 1
    return inside


class _Template:
    """One drawn page; blocks' texts open with a mark of their label, which is cut off after parsing."""

    def __init__(self, rng: random.Random, prose: list[str], other: list[str], words: list[str]):
        self.rng, self.prose, self.other, self.words = rng, prose, other, words

    def wrap(self, kind: str, inner: str) -> str:
        shown = self.rng.choice(_WRAPS[kind])
        tag = shown.split(".")[0].split("#")[0]
        named = f' class="{shown.split(".")[1]}"' if "." in shown else f' id="{shown.split("#")[1]}"' if "#" in shown else ""
        if kind == "main" and self.rng.random() < 0.15:
            named = f' class="{self.rng.choice(self.words)[:8]}"'
        if tag == "td":
            return f"<table><tr><td>{inner}</td></tr></table>"
        return f"<{tag}{named}>{inner}</{tag}>"

    def says(self, label: int, text: str) -> str:
        return "\x01\x02"[label] + text.replace("&", "&amp;").replace("<", "&lt;")

    def some(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(low, high)))

    def links(self, n: int) -> str:
        form = self.rng.choice(["<ul>{}</ul>", "{}", "<p>{}</p>", "<ul>{}</ul>"])
        item = "<li>{}</li>" if "ul" in form else self.rng.choice(["{} | ", "<span>{}</span> ", "<div>{}</div>"])
        each = [f'<a href="/{i}">{self.some(1, 4)}</a>' for i in range(n)]
        if item.startswith(("<li", "<div")):
            each = [x.replace(">", ">" + "\x01", 1) for x in each]
            return form.format("".join(item.format(x) for x in each))
        return form.format("\x01" + "".join(item.format(x) for x in each))

    def frame(self, kind: str) -> str:
        rng = self.rng
        if kind in ("menu", "share", "related") and rng.random() < 0.7:
            inner = self.links(rng.randint(2, 9))
            if kind == "related":
                inner = f"<h3>{self.says(0, rng.choice(_PHRASES['related']))}</h3>" + inner
        elif kind == "header":
            inner = f"<div>{self.says(0, self.some(1, 5))}</div>" + (f"<p>{self.says(0, self.some(2, 9))}</p>" if rng.random() < 0.5 else "") + (self.frame("menu") if rng.random() < 0.5 else "")
        elif kind == "sidebar":
            inner = "".join(f"<h3>{self.says(0, self.some(1, 4))}</h3>" + rng.choice([self.links(3), f"<p>{self.says(0, rng.choice(self.other))}</p>"]) for _ in range(rng.randint(1, 3)))
        elif kind == "comments":
            inner = f"<h3>{self.says(0, rng.choice(_PHRASES['comments']))}</h3>" * (rng.random() < 0.7)
            own = rng.choice(["<div class=\"comment\"><b>{}</b><p>{}</p></div>", "<li><span>{}</span><p>{}</p></li>", "<p>{} {}</p>", "<div><p>{}</p><p>{}</p></div>"])
            for _ in range(rng.randint(1, 5)):
                said = rng.choice([rng.choice(self.other), rng.choice(self.prose), rng.choice(_PHRASES["comments"])])
                cut = "</p><p>" in own or "</b><p>" in own or "</span><p>" in own
                inner += own.format(self.says(0, self.some(1, 2)), self.says(0, said) if cut else said.replace("&", "&amp;").replace("<", "&lt;"))
            inner += self.frame("form") if rng.random() < 0.3 else ""
        elif kind == "form":
            inner = f"<label>{self.says(0, rng.choice(_PHRASES['form']))}</label><input name=\"q\"><button>{self.says(0, rng.choice(_PHRASES['form']))}</button>"
        else:
            said = rng.choice([rng.choice(_PHRASES.get(kind, self.other)), rng.choice(self.other), rng.choice(self.prose), self.some(3, 12)])
            if kind == "footer":
                said = rng.choice(["© ", "Copyright ", ""]) + said
            inner = self.says(0, said)
            if rng.random() < 0.5:
                inner = f"<p>{inner}</p>" + (f"<p>{self.says(0, rng.choice(_PHRASES.get(kind, self.other)))}</p>" if rng.random() < 0.4 else "")
        return self.wrap(kind, inner)

    def main(self) -> str:
        rng, out = self.rng, []
        title = f"<h1>{self.says(1, self.some(3, 9))}</h1>"
        if rng.random() < 0.85:
            out.append(f"<header>{title}</header>" if rng.random() < 0.1 else title)
        begin = rng.randrange(len(self.prose))
        for text in (self.prose[begin:] + self.prose[:begin])[: rng.randint(1, 12)]:
            kind = rng.random()
            said = self.says(1, text if rng.random() < 0.9 else self.some(1, 3))
            if kind < 0.7:
                out.append(f"<p>{said}</p>" if rng.random() < 0.9 else f"<p>{said}")
            elif kind < 0.78:
                out.append(f"<h2>{self.says(1, self.some(2, 6))}</h2><p>{said}</p>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.says(1, self.some(2, 14))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{said}</p></blockquote>")
            elif kind < 0.91:
                out.append(f"<p>{said[0]}<b>{said[1:]}<br><p>" + self.says(1, text))
            elif kind < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{self.says(1, self.some(1, 3))}</td><td>{self.says(1, self.some(1, 3))}</td></tr>" for _ in range(2)) + "</table>")
            else:
                out.append(f"<div>{said}</div>")
            if rng.random() < 0.1:
                out.append(self.frame(rng.choice(["ad", "ad", "share", "related", "form", "notice"])))
        if rng.random() < 0.2:
            out.append(self.frame(rng.choice(["comments", "related", "share", "form"])))
        return self.wrap("main", "".join(out))

    def page(self) -> str:
        rng = self.rng
        ahead = [k for k, p in (("notice", 0.3), ("header", 0.45), ("menu", 0.8), ("ad", 0.5), ("form", 0.2), ("sidebar", 0.2)) if rng.random() < p]
        after = [k for k, p in (("share", 0.25), ("related", 0.35), ("comments", 0.5), ("form", 0.25), ("sidebar", 0.3), ("ad", 0.25), ("notice", 0.15), ("footer", 0.85)) if rng.random() < p]
        if rng.random() < 0.3:
            rng.shuffle(ahead)
        body = "".join(map(self.frame, ahead)) + self.main() + "".join(map(self.frame, after))
        return f"<html><body>{self.wrap('main', body) if rng.random() < 0.15 and body.count('<nav') else body}</body></html>"


def drawn(rng: random.Random, prose: list[str], other: list[str], words: list[str]) -> tuple[list, np.ndarray]:
    """The blocks of a drawn page, and their labels."""
    page = leaf_blocks(_Template(rng, prose, other, words).page())
    labels = np.array([b.text[0] == "\x02" for b in page], dtype=np.int64)
    for b in page:
        b.text = b.text.replace("\x01", "").replace("\x02", "").strip() or "-"
        b.linked = min(b.linked, len(b.text))
    return page, labels


def training(htmls: list[str], redrawn: int = REDRAWN, seed: int = SEED) -> tuple[list[list], list[np.ndarray]]:
    """Pages as blocks, with labels by marks, and pages drawn from their texts, with known labels."""
    rng = random.Random(seed)
    pages = [p for p in map(leaf_blocks, htmls) if p]
    labels = [np.array([marked(b.path) for b in p], dtype=np.int64) for p in pages]
    clean = lambda t: t.replace("\x01", "").replace("\x02", "") or "-"
    prose = [[clean(b.text) for b, m in zip(p, own) if m == 1] for p, own in zip(pages, labels)]
    other = [clean(b.text) for p, own in zip(pages, labels) for b, m in zip(p, own) if m != 1] or ["Lorem ipsum dolor sit amet."]
    words = [w for p in prose for t in p for w in t.split()[:40] if "\x01" not in w][:20_000] or "lorem ipsum dolor sit amet".split()
    made = [drawn(rng, p or [" ".join(rng.choices(words, k=rng.randint(3, 60))) for _ in range(8)], other, words) for p in prose * redrawn or [[]] * 50]
    return pages + [p for p, _ in made], labels + [x for _, x in made]


def sample(pages: DataFrame, html: str = "html", most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[str]:
    """At most ``most`` different pages of ``most_bytes`` or fewer: those of least hash, whatever the order of the table."""
    own = pages.select(F.col(f"`{html}`").alias("page")).where(F.octet_length("page") <= most_bytes).withColumn("_h", F.xxhash64("page"))
    # first the hashes alone: no more than ``most`` pages leave the executors, but for equal ones
    hashes = [r[0] for r in own.select("_h").distinct().orderBy("_h").limit(most).collect()]
    if not hashes:
        return []
    return sorted(r.page for r in own.where(F.col("_h") <= hashes[-1]).dropDuplicates(["_h"]).select("page").collect())


def fit(pages: DataFrame, html: str = "html", epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller fitted on the sample, alike for the same pages."""
    blocks, labels = training(sample(pages, html), seed=seed)
    return Labeller.fresh(seed).fit([inputs(p) for p in blocks], labels, epochs, seed)


def _pieces(batches: Iterator[pa.RecordBatch], model: Labeller):
    """(piece of a batch, blocks and scores of each of its pages)."""
    for batch in batches:
        for part, texts in slices(batch, "_html", 2_000_000):
            pages = [leaf_blocks(t) for t in texts]
            yield part, pages, list(model.scores([inputs(p) for p in pages]))


def label_blocks(pages: DataFrame, model: Labeller, html: str = "html", key: str = "page_id") -> DataFrame:
    """Every block of every page: ``key``, place, path, text, score (log-odds of being the article's)."""
    weights = model.packed()
    own = pages.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{html}`").alias("_html"))
    shown = f"_key {own.schema['_key'].dataType.simpleString()}, place int, path string, text string, score double"
    schema = arrow_schema(shown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, scores in _pieces(batches, Labeller(weights)):
            keys = part.column(0).to_pylist()
            rows = [(k, i, " ".join(b.path), b.text, float(x)) for k, p, s in zip(keys, found, scores) for i, (b, x) in enumerate(zip(p, s))]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else [()] * 5, schema.types)], names=schema.names)

    return own.mapInArrow(run, shown).withColumnRenamed("_key", key)


def main_text(pages: DataFrame, model: Labeller | None = None, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, the main text of each page and its code points."""
    from pyspark.sql.types import StructType

    keep = keep or ["page_id", "url"]
    weights = (model or fit(pages, html)).packed()
    own = pages.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col(f"`{html}`").alias("_html"))
    made = StructType.fromDDL("text string, n_chars long")
    schema = StructType([own.schema[f"_{i}"] for i in range(len(keep))] + made.fields)
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, scores in _pieces(batches, Labeller(weights)):
            texts = ["\n".join(b.text for b, x in zip(p, s) if x > 0) for p, s in zip(found, scores)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return own.mapInArrow(run, schema).toDF(*keep, "text", "n_chars")
