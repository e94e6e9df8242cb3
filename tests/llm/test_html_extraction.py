"""extract on whole tables, the parser's bounds, and the text against a reader of plain articles."""

import html
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.llm import html_extraction as H

WEIGHTS, EDGES = H.fit()


def text(page):
    return H.main_text(page, np.array(WEIGHTS), EDGES)


def article(body):
    said = "A paragraph of the article with enough words to be taken for one, and a second sentence."
    return f"<html><body><nav><a href=x>Home</a></nav><article><h1>The heading.</h1><p>{said}</p>{body}<p>{said}</p></article></body></html>", lambda x: f"The heading.\n{said}\n{x}{said}"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<p>Before the formula <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and after it.</p>", "Before the formula x=2 and after it.\n"),
        ("<p>Press it <button>Send</button> now, said the man in the hall.", "Press it now, said the man in the hall.\n"),
        ("<p>Open here <button>Send<p>The paragraph after a button that nobody closed.</p>", "Open here\nThe paragraph after a button that nobody closed.\n"),
        ("<p>A choice <select><option>one<option>two</select> of things to be made here.</p>", "A choice of things to be made here.\n"),
        ("<p>It is not &a<b>mp;</b> that a reference ends where a tag starts.</p>", "It is not &amp; that a reference ends where a tag starts.\n"),
        ("<p>A drawing <svg><path d='M0'/></svg> and an <object data=x>object's words</object> stay.</p>", "A drawing and an object's words stay.\n"),
        ("<p>Less &lt; more &#233;&nbsp;&amp; <i>so</i>   on,\n and so\ton.</p>", "Less < more é & so on, and so on.\n"),
    ],
)
def test_nothing_else_is_dropped(body, want):
    page, around = article(body)
    assert text(page) == around(want)


def test_articles_against_a_plain_reader():
    r = random.Random(7)
    word = lambda: r.choice(["plain", "words", "of", "an", "article", "&amp;", "é", "&lt;b&gt;", "<b>bold</b>", "<i>it</i>", "<br>", "\n", "<!-- note -->"])
    for _ in range(60):
        blocks = [" ".join(word() for _ in range(r.randint(15, 80))) + " and that is all." for _ in range(r.randint(1, 12))]
        page = "<html><body><nav><a href=x>Home</a></nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article></body></html>"
        want = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"<!--.*?-->|</?[bi]>", "", b))).split()) for b in blocks]
        assert text(page) == "\n".join(want)


def test_trees_at_once_have_the_marginals_of_each():
    r = np.random.default_rng(1)
    x, y, up, kind, levels = H.labelled_forest(6)
    own, edges = r.normal(size=len(y)), r.normal(size=(3, 4))
    belief, joint = H.forest_marginals(own, up, kind, levels, edges)
    at = 0
    for page in H.labelled_pages(6):
        nodes = H.parse(page)
        got = H.marginals(nodes, own[at : at + len(nodes)].tolist(), tuple(map(tuple, edges.tolist())))
        assert np.allclose(got, belief[at : at + len(nodes)])
        at += len(nodes)
    child = np.concatenate(levels[1:])
    assert at == len(y) and np.allclose(joint[child].sum(1), 1) and np.allclose(joint[child][:, [1, 3]].sum(1), 1 / (1 + np.exp(-belief[child])))


def test_broken_pages_cost_what_they_hold():
    for page in ("<div>" * 40_000 + "</span></p></x>" * 40_000, "<b>" * 40_000 + "</i>" * 40_000, "<ul>" + "<li><div>" * 30_000, "<p><button>" * 30_000, "<i><div>" + "<b>" * 30_000 + "</i>" * 30_000):
        began = time.time()
        H.parse(page)
        assert time.time() - began < 20


def test_extract(spark):
    page, around = article("")
    long = "<article>" + "<p>A paragraph of some words that is one of very many here.</p>" * 60_000 + "</article>"
    rows = [(1, "u1", page), (2, None, page), (None, "u", page), (3, "u", None), (4, "u", ""), (5, "u", "<"), (6, "u", long), (1, "u1", page), (7, "u", "<script>x</script>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("text", "n_chars", "label")}).repartition(3)
    out = H.extract(pages)
    got = out.collect()
    assert out.columns == ["page_id", "url", "text", "n_chars"] and len(got) == len(rows)
    plain = around("")
    want = [(1, "u1", plain), (2, None, plain), (None, "u", plain), (3, "u", ""), (4, "u", ""), (5, "u", None), (6, "u", None), (1, "u1", plain), (7, "u", "")]
    for i, u, t in want:
        same = [r for r in got if (r["page_id"], r["url"]) == (i, u)]
        assert same and all(r["n_chars"] == len(r["text"]) and (t is None or r["text"] == t) for r in same)
    assert next(r for r in got if r["page_id"] == 6)["text"].count("\n") == 59_999
    assert H.extract(pages.limit(0)).count() == 0
