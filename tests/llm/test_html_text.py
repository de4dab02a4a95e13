"""Main text: minimum cuts against brute force, page layouts, and the articles of the real pages."""

import html
import itertools
import re
import time

import numpy as np
import pytest

from tests.llm import other_layouts
from weftgraph.llm import html_layouts
from weftgraph.llm import html_text as ht
from weftgraph.llm import queries

SF = "/root/testdata/sf0.01"
PARA = "A paragraph of the article that says something at reasonable length, with commas and a full stop."


def test_minimum_cut_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(150):
        n = int(rng.integers(1, 9))
        values = [float(x) for x in rng.normal(0, 1, n).round(2)]
        edges = [(a, b, float(rng.random().__round__(2))) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(labels):
            return sum(abs(v) for v, on in zip(values, labels, strict=True) if on != (v > 0)) + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert cost(ht.minimum_cut(values, edges)) == pytest.approx(best)


def page(article, before="", after="", aside=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body>{before}<article>{article}</article>{aside}{after}</body></html>"


NAV = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li></ul></nav>"
FOOT = "<footer>&copy; site &middot; imprint</footer>"


@pytest.mark.parametrize(
    "extra",
    [
        "<header><h1>Site name</h1><p>The best site of all the sites in the world.</p></header>",
        "<aside><p>" + PARA + "</p></aside>",
        "<div class='sidebar'><p>" + PARA + "</p></div>",
        "<div id=\"cookie-notice\">We use cookies, and this is a long sentence about them that nobody reads.</div>",
        "<div class='ad'>" + PARA + "</div>",
        "<form><label>Your name</label><input name=n><textarea>typed</textarea><button>Send</button></form>",
        "<section class='comments'><h2>Comments</h2><p>" + PARA + "</p></section>",
        "<div class='comment-list'><div class='comment'><p>" + PARA + "</p></div></div>",
        "<!-- a comment with <p>tags</p> -->",
        "<div class='newsletterSignup'><p>" + PARA + "</p></div>",
        "<noscript>Turn it on.</noscript>",
    ],
)
def test_boilerplate_goes(extra):
    article = f"<h1>Head &amp; line</h1><p>{PARA}<p>Second\n  paragraph&nbsp;here &lt;b&gt;.</p><ul><li>one point<li>two</ul>"
    want = f"Head & line\n{PARA}\nSecond paragraph here <b>.\none point\ntwo"
    assert ht.main_text(page(article, NAV + extra, FOOT)) == want
    assert ht.main_text(page(article, NAV, extra + FOOT)) == want
    assert ht.main_text(page(article + extra, NAV, FOOT)) == want or extra.startswith("<header")


def test_line_breaks_and_headers_inside_articles():
    article = f"<div class='entry-header'><h1>Head</h1></div><p>one<br>two<br/>\n three</p><p>{PARA}</p>"
    assert ht.main_text(page(article, NAV, FOOT)) == f"Head\none two three\n{PARA}"


def test_pages_without_article():
    body = f"<div id='menu'><a href='/x'>Start</a> <a href='/y'>News</a></div><div class='content'><h2>Title</h2><p>{PARA}</p><p>Short.</p><p>{PARA}</p></div><div id='footer'>All rights reserved.</div>"
    assert ht.main_text(f"<html><body>{body}</body></html>") == f"Title\n{PARA}\nShort.\n{PARA}"
    assert ht.main_text(f"<p>{PARA}</p>") == PARA


COMMENTS = f"<section class=comments><h3>Comments</h3>{f'<p>{PARA} a</p>' * 6}</section>"


@pytest.mark.parametrize(
    ("page_html", "want"),
    [
        (f"<article><p class=x don't>{PARA}</p><p>It isn't so.</p></article>", f"{PARA}\nIt isn't so."),  # a stray quote in a tag
        (f'<article><p class="x>{PARA}</p></article>', PARA),  # one that is never closed
        (f"<article><!--><p>{PARA}</p></article>", PARA),
        (f"<article><!---><p>{PARA}</p><!-- a -- b --!></article>", PARA),
        (f"<form><article><p>{PARA}</p></article></form>", PARA),
        (f"<form><div class=header>Site</div><div><h1>Head</h1><p>{PARA}</p><p>Short.</p></div><div class=footer>c</div></form>", f"Head\n{PARA}\nShort."),
        (f"<nav><a href=x>Home</a><article><p>{PARA}</p></article>", PARA),  # a menu that is never closed
        (f'<main><section id="tags"><p>{PARA}</p></section></main>', PARA),
        (f"<div class='ad'><article><p>{PARA}</p></article></div>", PARA),
        (f"<table><tr><td>{PARA}</td></tr></table>", PARA),
        (f"<main><table><tr><td>{PARA}</td></tr></table></main>", PARA),
        ("<h1>Hi</h1><p>Ok.</p>", "Hi\nOk."),
        (f"<div id=cookie-notice><p>{PARA}</p></div><h1>Hi</h1><p>Ok.</p>", "Hi\nOk."),
        ("<article><p>where <math><mi>x</mi></math> is <object>one</object>.</p></article>", "where x is one."),
        (f"<div><h1>Head</h1><p>{PARA}</p></div>{COMMENTS}", f"Head\n{PARA}"),
        (f"<article><p>Ok.</p></article>{COMMENTS}", "Ok."),
        (f"<article><p>{PARA}</p></article><section class=comments><article class=comment><p>{PARA} 1</p></article><article><p>{PARA} 2</p></article></section>", PARA),
        (f"<article><p>{PARA}</p><ul><li><a href=x>one</a><li><a href=y>two</a></ul></article>", f"{PARA}\none\ntwo"),
        (f"<article><p>{PARA}</p><div class=ad>{PARA} ad</div><p>{PARA}</p></article>", f"{PARA}\n{PARA}"),
        (f"<article><div>Short line</div><p>{PARA}</p><button>Share this</button></article>", f"Short line\n{PARA}"),
        ("<article><p title='a>b'>x &gt; y is 3 > 2 and 1 < 2</p></article>", "x > y is 3 > 2 and 1 < 2"),
        ("<article><p>a &am<b>p; b</b></p></article>", "a &amp; b"),
        ("<nav><ul><li><a href=x>Home</a></li></ul></nav><footer><p>All rights reserved.</p></footer>", ""),
        ("<article></article><footer>f</footer>", ""),
        (f"<div class=sidebar><p>{PARA}</p></div>", ""),
        (f"<div class=sidebar><h3>About</h3><p>{PARA}</p><p>{PARA}</p></div>", ""),
        (f"<div id=cookie-notice><p>{PARA}</p></div>", ""),
        (f"<aside><p>{PARA}</p></aside>", ""),
        (f"<aside><h2>More</h2><p>{PARA}</p><p>{PARA}</p></aside>", ""),
        (f"<footer><p>{PARA}</p></footer>", ""),
        (f"<article></article><div class=cookie-notice><p>{PARA}</p></div>", ""),
        (f"<form><p>{PARA}</p></form>", ""),
        (f"<div class=page-with-sidebar><h1>Head</h1><p>{PARA}</p><p>Short.</p></div>", f"Head\n{PARA}\nShort."),
        (f"<article><h1>Head</h1><p>{PARA}</p><div>Share on: <a href=x>X</a> <a href=y>Y</a></div></article>", f"Head\n{PARA}"),
        (f"<main><h1>Head</h1><p>{PARA}</p><p>{PARA}</p><div class=popular><p>{PARA}</p></div></main>", f"Head\n{PARA}\n{PARA}"),
        (f"<article><h1>Head</h1><p>{PARA}</p></article><ul class=user-posts><li>{PARA}</li><li>{PARA}</li></ul>", f"Head\n{PARA}"),
        (f"<article><h1>Head</h1><p>{PARA}</p></article><div>© 2026 The Site, all of it.</div>", f"Head\n{PARA}"),
    ],
)
def test_articles_are_not_lost(page_html, want):
    assert ht.main_text(page_html) == want
    assert ht.main_text(f"<!DOCTYPE html><html><body>{page_html}</body></html>") == want


def test_weights_are_fitted():
    weights, (neighbour, sibling, across) = ht.fit(html_layouts.pages())
    assert weights == pytest.approx(ht.WEIGHTS, abs=0.02)
    assert (neighbour, sibling, across) == pytest.approx((ht.NEIGHBOUR, ht.SIBLING, ht.ACROSS), abs=0.02)


def test_the_cut_decides():
    """On layouts that the weights have not seen, labels of the cut are better than the odds' signs."""
    by_cut = by_sign = flipped = 0
    pages = html_layouts.pages(600, seed=5)
    for one in pages:
        content, found = set(one.content), ht.labelled(one.html)
        by_cut += all(on == (b.text in content) for b, on in found)
        by_sign += all((ht.odds(b) > 0) == (b.text in content) for b, _ in found)
        flipped += any(on != (ht.odds(b) > 0) for b, on in found)
    assert flipped > 0.05 * len(pages)
    assert by_cut > by_sign + 0.04 * len(pages) and by_cut > 0.9 * len(pages)


def test_the_cut_decides_on_layouts_of_another_generator():
    """On layouts that no part of the fit comes from, the cut mends more pages than it spoils."""
    pages = other_layouts.pages(600)
    by_cut = by_sign = right = blocks = 0
    for html_text, want in pages:
        found, content = ht.labelled(html_text), set(want)
        by_cut += [b.text for b, on in found if on] == want
        by_sign += [b.text for b, _ in found if ht.odds(b) > 0] == want
        right += sum(on == (b.text in content) for b, on in found)
        blocks += len(found)
    assert by_cut > by_sign + 0.05 * len(pages) and by_cut > 0.65 * len(pages) and right > 0.97 * blocks


def test_cut_of_a_long_chain():
    """Alternating odds against strong edges, so that everything is settled by the flow."""
    n = 4000
    values = [0.5 if i % 3 else -1.2 for i in range(n)]
    began = time.time()
    labels = ht.minimum_cut(values, [(i, i + 1, 2.0) for i in range(n - 1)])
    assert not any(labels[1:-1]) and time.time() - began < 5


@pytest.mark.parametrize(
    "page_html",
    ["<div>" * 8000 + "<p>x y</p>" * 8000, "<div class=ad>" * 8000 + "<p>x</p>" * 8000, "<p><div>" + "<span>" * 8000 + "<p>x" * 8000 + "</section>" * 8000, "<a b='" * 9000],
)
def test_nested_pages_take_linear_time(page_html):
    began = time.time()
    ht.main_text(page_html)
    assert time.time() - began < 1


@pytest.mark.parametrize("text", [None, "", " ", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<a <b>>", "&am", "<p>" * 3000, "<div>" * 3000 + "x"])
def test_odd_pages(text):
    assert isinstance(ht.main_text(text), str)


def test_long_page():
    text = ht.main_text(page("".join(f"<p>{PARA} {i}</p>" for i in range(20000)), NAV, FOOT))
    assert text.count("\n") == 19999


def test_real_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op9_html_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)>", article)]
        assert r.text == "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_table_edge_cases(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", f"<p>{PARA}</p>", 3), (4, "u", f"<p>{PARA}</p>", 3), (4, "u", f"<p>{PARA}</p>", 3)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted((r.page_id or -1, r.text) for r in ht.extract(docs).collect())
    assert got == [(-1, PARA), (1, ""), (2, ""), (4, PARA), (4, PARA)]
    assert ht.extract(docs.limit(0)).count() == 0
