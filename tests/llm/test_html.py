"""Main text of pages: the given pages against their article, and pages built by hand."""

import html
import itertools
import math
import re
import time

import duckdb
import pytest
from conftest import SF_SMALL

from tessera.llm import html_extract as H
from tessera.llm.html_extract import RAW, parse
from tessera.llm.q_html import main_texts

SF = SF_SMALL.replace("0.001", "0.01")


def article(page):
    inner = re.search(r"<article>(.*?)(?:</article>|<footer|$)", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())


@pytest.fixture(scope="module")
def model(spark):
    return H.learn(spark.read.parquet(f"{SF}/pages.parquet").where("page_id % 2 = 0"), "page_id", "html", 100)


def test_held_out_pages(model):
    for page_id, page in duckdb.sql(f"select page_id, html from '{SF}/pages.parquet' where page_id % 2 = 1").fetchall():
        assert H.main_text(page, model) == article(page), page_id


def test_held_out_pages_without_article_marks(model):
    pages = duckdb.sql(f"select html from '{SF}/pages.parquet' where page_id % 2 = 1").fetchall()
    same = [H.main_text(p.replace("<article>", "<div>").replace("</article>", "</div>"), model) == article(p) for p, in pages]
    assert sum(same) >= 0.95 * len(same)


LONG = "Words that go on and on for quite a while, so that nobody would take them for a label or a menu entry of a page."


@pytest.mark.parametrize("page, want", [
    ("<article><h1>T</h1><p>A &eacute;&nbsp; b<p>C <b>bo</b>ld<br>line<ul><li>one<li>two</ul></article>", "T A é b C bold line one two"),
    (f"<main><p>{LONG}</p><aside><p>{LONG}</p></aside><form><p>Name</p><input></form><section class='comments'><p>{LONG}</p></section></main>", LONG),
    (f"<header><h2>Site</h2><p>{LONG}</p></header><nav><a href=a>Home</a></nav><div class=content><p>{LONG}</p></div><div id=sidebar><p>{LONG}</p></div>"
     f"<div class='cookie-notice'>{LONG}</div><footer>{LONG}</footer>", LONG),
    ("<p>Hello <!-- no --> world<script>var x = '<p>no</p>';</script>", "Hello world"),
    ("<article><p>a &lt;b&gt; &amp;amp; &#233;</p><style>p{}</style><textarea>no</textarea></article>", "a <b> &amp; é"),
    ("<article><table><tr><td>x<td>y<tr><td>z</table><pre>a\n  b</pre></article>", "x y z a b"),
    (None, ""), ("", ""), ("   ", ""), ("<div", ""), ("</p></div>text", "text"), ("<article><p>un<i>closed", "unclosed"),
])
def test_pages_by_hand(model, page, want):
    assert H.main_text(page, model) == want


def test_marginals_are_exact(model):
    page = "<div><p>abc</p><ul><li><a href=x>k</a></ul></div><nav><p>text</p></nav><p>some more text here</p>"
    nodes, _ = H.parse(page)
    odds = [math.log(model.prior[1] / model.prior[0]) + sum(model.odds[f] for f in H.features(n)) for n in nodes]
    weight = [0.0] * len(nodes)
    total = 0.0
    for y in itertools.product((0, 1), repeat=len(nodes)):
        w = 1.0
        for i, n in enumerate(nodes):
            p = 1 / (1 + math.exp(-odds[i])) if i else 1e-12
            w *= p if y[i] else 1 - p
            if i:
                w *= model.pair[n.fenced][y[n.parent]][y[i]]
        total += w
        for i in range(len(nodes)):
            weight[i] += w * y[i]
    assert model.marginals(nodes)[1:] == pytest.approx([w / total for w in weight][1:], rel=1e-6, abs=1e-9)


def test_long_deep_and_empty_tables(spark, model):
    assert len(H.main_text("<article>" + "<p>word " * 50_000, model).split()) == 50_000
    assert H.main_text("<article>" + "<div>" * 3000 + "deep", model) == "deep"
    assert H.main_text("<" * 20_000 + "a href='" * 2000, model) is not None
    df = spark.createDataFrame([(None, None, None, "x"), (3, "u", "<article>a b</article>", "y")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in main_texts(df).collect()}
    assert got == {None: (None, "", 0), 3: ("u", "a b", 3)}
    assert main_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("tag", sorted(RAW))
def test_raw_element_without_end_runs_to_the_end(tag):
    _, blocks = parse(f"<article><p>Hello there world.</p><{tag}>var a = 1; track();<p>more")
    assert [t for _, t in blocks] == ["Hello there world."]


@pytest.mark.parametrize("piece,nodes", [("<b>", 1), ("<a href=x>", 1), ("<div>", 200_001), ("<p>", 200_001), ("<li><ul>", 400_001)])
def test_very_deep_pages_take_seconds(piece, nodes):
    began = time.process_time()
    found, blocks = parse((piece + "w ") * 200_000)
    assert len(found) == nodes and len(blocks) in (1, 200_000) and time.process_time() - began < 30
