"""Page extraction: exact marginals by enumeration, a plain reading of given pages, held-out layouts, broken pages."""

import itertools
import os
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import pages as P

SF = "/root/testdata/sf0.001"


def chance_by_enumeration(forest, unary, edge):
    n = len(unary)
    total, content = 0.0, np.zeros(n)
    for state in itertools.product((0, 1), repeat=n):
        score = sum(unary[i, s] for i, s in enumerate(state))
        score += sum(edge[forest.kind[i], state[forest.parent[i]], s] for i, s in enumerate(state) if forest.parent[i] >= 0)
        total += np.exp(score)
        content += np.exp(score) * np.array(state)
    return content / total, np.log(total)


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(5)
    for text in ("<div><p>a<p>b<ul><li>c<li>d</ul></div><h1>x</h1>", "<div><div><div><p>a</p></div><h2>b</h2></div></div>", "x", "<p>a</p><p>b</p>" * 3):
        pages = [P.Page(text), P.Page("<nav>m</nav>")]
        forest = P.Forest(pages)
        unary, edge = rng.normal(size=(len(forest.x), 2)), rng.normal(size=(P.KINDS, 2, 2))
        got, pairs, log_total = P.messages(forest, unary, edge)
        want, want_total = chance_by_enumeration(forest, unary, edge)
        assert np.allclose(got, want) and np.isclose(log_total, want_total)
        child = np.flatnonzero(forest.parent >= 0)
        assert np.allclose(pairs[child].sum((1, 2)), 1) and np.allclose(pairs[child][:, :, 1].sum(1), got[child])


class Plain(HTMLParser):
    """Blocks of text inside <article>."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        elif tag == "br" and self.inside:
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def plain(html):
    reader = Plain()
    reader.feed(html)
    reader.close()
    return "\n".join(t for t in (" ".join(b.split()) for b in reader.blocks) if t)


@pytest.fixture(scope="module")
def model(spark):
    return P.learn(P.training_pages(spark.read.parquet(f"{SF}/pages.parquet")))


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are absent")
def test_given_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = P.extract_text(pages, model).collect()
    assert len(got) == len(html) and all(r.text == plain(html[r.page_id]) and r.n_chars == len(r.text) for r in got)
    # the article's own tag is not what tells it
    bare = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
    same = {r.page_id: r.text for r in got}
    again = P.extract_text(bare, model).collect()
    assert sum(r.text == same[r.page_id] for r in again) >= 0.99 * len(again)


def test_held_out_layouts(model):
    held = P.labelled_pages(200, seed=71)
    got = ["\n".join(x) for x in model.extract([P.Page(h) for h, _ in held])]
    assert np.mean([a == b for a, (_, b) in zip(got, held)]) > 0.94
    wanted = [set(t.split("\n")) for _, t in held]
    lines = [set(g.split("\n")) for g in got]
    assert sum(len(w - g) for w, g in zip(wanted, lines)) < 0.02 * sum(map(len, wanted))
    assert sum(len(g - w) for w, g in zip(wanted, lines)) < 0.02 * sum(map(len, wanted))


PAGE = ('<html><head><title>T</title></head><body><nav><a href="/">Home</a> <a href="/x">News</a></nav><div id="cookie-notice">We use cookies. <button>OK</button></div>'
        '<div class="post"><h1>Main &amp; title</h1><p>First  paragraph,\n with <b>bold</b>text and an &eacute;.</p><!-- no --><script>bad("<p>")</script><p>Second one is here, and it is longer.'
        '<div class="share"><a href="/t">Tweet</a></div><p>Third.</div><div class="comments"><p>Nice post, thanks a lot!</p></div><footer>&copy; Site</footer></body></html>')


def test_one_page_of_every_kind(model):
    assert model.extract([P.Page(PAGE)])[0] == ["Main & title", "First paragraph, with boldtext and an é.", "Second one is here, and it is longer.", "Third."]


def every(html):
    page = P.Page(html)
    return page.blocks([True] * len(page.parent))


def test_broken_pages():
    assert every("") == every("<p") == every("<!-- x") == every("<script>x") == every('<a href="' * 3) == []
    assert every("a < b &lt;i&gt; &amp;amp; &#x41;&nbsp;c") == ["a < b <i> &amp; A c"]
    assert every("<p>a<p>b</div></p>c") == ["a", "b", "c"]
    assert every("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert every("<ul><li>a<ul><li>b</ul><li>c</ul>") == ["a", "b", "c"]
    assert every("x<br>y<hr>z") == ["x y", "z"]
    assert every("<TEXTAREA>a</TextArea>b<style>c</style >d") == ["bd"]
    assert every("<![CDATA[a & b]]>") == ["a & b"]


@pytest.mark.parametrize("unit", ["<b>", "<div>", "<li>", "<p>", '<a href="x', "<td>", "</div>", "<!--", "<p><b>x", "<ul><li>", "<a>x", "<script>"])
def test_time_grows_with_length(unit):
    def took(n):
        start = time.process_time()
        P.Page(unit * n)
        return time.process_time() - start

    took(1000)
    small, large = took(8000), took(64000)
    assert large < 40 * small + 0.3


def test_awkward_rows(spark, model):
    rows = [(1, "u", None), (1, "u", ""), (2, None, PAGE), (2, None, PAGE), (None, None, "<p>" + "long text. " * 60000)]
    clash = [F.lit("x").alias(c) for c in ("id", "text", "n_chars", "kind", "row")]
    got = P.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *clash), model).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got)[1:3] == [(1, 0), (1, 0)] and sum(r.page_id == 2 and r.text.startswith("Main & title\nFirst") for r in got) == 2
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert P.extract_text(none).count() == 0
