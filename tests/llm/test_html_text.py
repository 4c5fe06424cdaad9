"""Blocks of broken markup, held-out accuracy of the labeller, and whole pages against a plain cut of their article."""

import html
import re

import numpy as np
import pytest

from taskloom.llm import html_text
from taskloom.llm.blocks import leaf_blocks
from taskloom.llm.labeller import Labeller, inputs

PAGES = "/root/testdata/sf0.01/pages.parquet"


def texts(page):
    return [b.text for b in leaf_blocks(page)]


def test_blocks_of_broken_markup():
    assert texts(None) == texts("") == texts("<p> &nbsp; </p><script>x<p>y</p></script>") == []
    assert texts("a < b &amp;&lt;p&gt;<br>c<!-- <p>no -->d") == ["a < b &<p> cd"]
    assert texts("<p><b>one<br><p>two <i>th</i>ree<ul><li>x<li>y</ul>z") == ["one", "two three", "x", "y", "z"]
    assert texts("<td title='a>b'>in</td></p></nonsense>tail<p") == ["in", "tail"]
    assert texts("<style>p{}</STYLE ><title>t</title><textarea><p>no</textarea>yes<p class=it's>q</p>") == ["yes", "q"]
    assert texts("<script>never ended <p>x") == []
    (link,) = leaf_blocks('<nav class="topMenu big"><p id=x1>a <a href="/">bcd</a>')
    assert link.path == ["nav", ".top", ".menu", ".big", "p", ".x"] and link.linked == 3
    assert len(leaf_blocks("<div>" * 3000 + "x<p>" * 3000)) == 3000


@pytest.fixture(scope="module")
def fitted(spark):
    return html_text.fit(spark.read.parquet(PAGES))


def test_held_out_layouts(spark, fitted):
    held = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id between 1000 and 1199").select("html").collect()]
    pages, labels = html_text.training(held, seed=99)
    right = [(np.array(s > 0) == y) | (y < 0) for s, y in zip(fitted.scores([inputs(p) for p in pages]), labels)]
    assert np.concatenate(right[: len(held)]).mean() > 0.999  # the pages themselves
    assert np.concatenate(right[len(held) :]).mean() > 0.985  # layouts drawn with another seed


def test_pages_as_they_are(spark, fitted):
    pages = spark.read.parquet(PAGES)
    got = {r.page_id: r for r in html_text.main_text(pages, fitted).collect()}
    for r in pages.collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        want = [" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in parts]
        assert got[r.page_id].text == "\n".join(x for x in want if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_cases(spark, fitted):
    long = "<article>" + "<p>" + "Long prose goes on here. " * 40000 + "</p></article>"
    rows = [(None, None, "u", 1), (1, "", None, 2), (1, "<nav><a href=x>menu</a></nav>", "u", 3), (1, "<nav><a href=x>menu</a></nav>", "u", 3), (2, long, "u", 4)]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text int")
    got = sorted(map(tuple, html_text.main_text(pages, fitted).collect()), key=str)
    want = " ".join(("Long prose goes on here. " * 40000).split())
    assert got == sorted([(None, "u", "", 0), (1, None, "", 0), (1, "u", "", 0), (1, "u", "", 0), (2, "u", want, len(want))], key=str)
    assert html_text.label_blocks(pages, fitted).where("score > 0").count() == 1
    assert html_text.main_text(pages.limit(0), fitted).collect() == []


def test_fitting_is_bounded_and_repeatable(spark):
    pages = spark.read.parquet(PAGES)
    one = html_text.sample(pages.repartition(3), most=20)
    assert one == html_text.sample(pages.repartition(7, "page_id"), most=20) and len(one) == 20
    a, b = (Labeller.fresh(1).fit(*(lambda p, x: ([inputs(q) for q in p], x))(*html_text.training(one, 1)), 1, 1) for _ in range(2))
    assert all(np.array_equal(a.w[k], b.w[k]) for k in a.w)
    assert html_text.fit(pages.limit(0), epochs=1).w["x"].shape[0] == inputs(leaf_blocks("x")).shape[1]
