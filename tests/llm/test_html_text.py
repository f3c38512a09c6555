import re
from html import unescape

import numpy as np
import pytest

from agentlake.llm import html_text as H
from agentlake.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    return {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


@pytest.fixture(scope="module")
def model(pages):
    return H.learn([pages[k] for k in sorted(pages)[:60]])


def article(html):
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1].replace("<br>", " ")
    blocks = (" ".join(unescape(re.sub(r"<[a-z/][^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h\d|li|ul)>", inner))
    return "\n".join(b for b in blocks if b)


def test_all_pages_give_their_article(spark, pages):
    got = {r["page_id"]: r for r in queries.QUERIES["op10_html_text"](spark, SF).collect()}
    assert len(got) == len(pages)
    for k, html in pages.items():
        assert got[k]["text"] == article(html) and got[k]["n_chars"] == len(got[k]["text"])


def test_held_out_accuracy_on_layouts_without_marks(pages, model):
    rng = np.random.default_rng(99)
    held = [pages[k] for k in sorted(pages)[60:]]
    sentences = [s for h in held for _, t, _ in H.Page(h).runs for s in re.split(r"(?<=[.!?]) ", t) if len(s) > 3]
    scores = []
    for _ in range(200):
        html = H.composed(rng, sentences)
        page = H.Page(html, marked=True)
        gold = page.gold()
        want = {t for n, t, _ in page.runs if gold[n]}
        got = set(H.texts_of([re.sub(r' data-gold="\d"', "", html)], model)[0].split("\n"))
        scores.append(2 * len(want & got) / (len(want) + len(got)))
    assert np.mean(scores) > 0.95


def test_written_page(model):
    words = "This is a longer sentence of the article, with commas, and it goes on for a while. " * 3
    html = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{x}}</style></head><body>
    <header class="site-header"><a href="/">Home of the site</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies on this site.</p></div>
    <article><h1>A &amp; B&nbsp;&#233;</h1><p>{words}<p>Second <b>bold</b><i>text</i>, x &lt; y.<br>{words}<!-- no --><script>var a = "</p>";</script></p><ul><li>{words}</li></ul></article>
    <div id="comments"><h3>Comments</h3><div class="comment">I liked it, thanks for it.</div></div><form><p>Your name</p><input></form><footer>&copy; me</footer></body></html>"""
    w = " ".join(words.split())
    assert H.texts_of([html], model)[0] == f"A & B é\n{w}\nSecond boldtext, x < y. {w}\n{w}"


def test_decoding_is_consistent_and_best():
    """Against all labellings of a small tree."""
    from itertools import product
    page = H.Page("<div><p>a</p><div>b<p>c</p><p>d</p></div></div><p>e</p>")
    n, rng = len(page.parent), np.random.default_rng(4)
    for _ in range(100):
        odds = rng.normal(0, 2, n)
        best, texts = -1e9, None
        direct = {r[0] for r in page.runs}
        for labels in product("mcb", repeat=n - 1):
            lab = ("m", *labels)
            if any(lab[page.parent[i]] != "m" and lab[i] != lab[page.parent[i]] for i in range(1, n)):
                continue
            value = sum(odds[i] if x == "c" else -odds[i] if x == "b" else (-1 + (abs(odds[i]) if i in direct else 0)) * (i > 0) for i, x in enumerate(lab) if i)
            if value > best + 1e-9:
                best = value
                texts = "\n".join(t for k, t, _ in page.runs if lab[k] == "c" or lab[k] == "m" and odds[k] > 0)
        assert page.decode(odds) == texts


def test_nulls_broken_long_repeated_and_empty_table(spark, model):
    import json
    odd = [None, "", "plain words, in no element at all.", "<", "<p", "</div></p>", "<p>unclosed <b>bold", "<script>never closed", "<div>" * 3000 + "deep" + "</div>" * 3000,
           "<article>" + "<p>Some words here, and more.</p>" * 20000 + "</article>"]
    df = spark.createDataFrame([(i, h, "u", "t") for i, h in enumerate(odd + odd)], "page_id long, html string, url string, text string")
    got = {r["page_id"]: r["main"] for r in H.extract(df, json.dumps(model), name="main").collect()}
    assert all(got[i] == got[i + len(odd)] for i in range(len(odd))) and got[0] == got[1] == got[7] == ""
    assert got[9].count("\n") == 19999
    assert H.fit(df.selectExpr("CAST(NULL AS LONG) AS page_id", "html")).startswith("{")
    empty = df.limit(0)
    assert H.extract(empty, H.fit(empty)).count() == 0


@pytest.mark.parametrize(("before", "after"), [
    ("<button>Buy <b>now", ""), ("<iframe src=x>", ""), ("<svg><path d='M'>", ""), ("<object data=x>", ""), ("<canvas>", ""), ("<noscript>", ""),
    ("<p data-x=it's>", "</p>"), ("<p title=\"a > b\" data-x='>'>", "</p>"), ("", "<math><mi>x</mi></math>")])
def test_no_text_is_lost_behind_broken_markup(before, after):
    page = H.Page(f"<div>{before}</div><p>What follows stays.</p>{after}")
    texts = [t for _, t, _ in page.runs]
    assert "What follows stays." in texts and (not after.startswith("<math") or "x" in texts)


def test_raw_elements_that_are_closed_hold_no_text():
    page = H.Page("<p>a<button>b</button><svg><title>c</title><text>d</text></svg><object>e</object><script>f<p></script>g</p>")
    assert [t for _, t, _ in page.runs] == ["a g"]


def test_head_without_end_or_body(model):
    words = "A sentence of the article, which is long enough to count. " * 5
    got = H.texts_of([f"<html><head><title>no</title><style>p {{}}</style><article><p>{words}</p></article>"], model)[0]
    assert got == " ".join(words.split())


def test_pages_cannot_mark_themselves(pages):
    some = [pages[k] for k in sorted(pages)[:30]]
    odd = [h.replace("<nav", '<nav data-gold="1"').replace("<article", '<article data-gold="x"') for h in some]
    assert H.learn(odd) == H.learn(some)
