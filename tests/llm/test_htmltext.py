from __future__ import annotations

import re
import time

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import htmltext as H

P = "A paragraph of the article that is long enough to surge over the windows of lines around it."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<html></html>", ""), ("<p>Just one.</p>", "Just one."), (
            "no markup at all, only text", "no markup at all, only text",
        ),
        (
            f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{P}</p><p>Tiny.</p></article><footer>&copy; us</footer>",
            f"Title {P} Tiny.",
        ),
        (
            f"<div id=header>Site of ours</div><div><p>{P}</p><p>a &amp; b\n\t c&nbsp;d</p></div><div class='comments'><p>{P}</p></div>",
            f"{P} a & b c d",
        ),
        (f"<script>var t='</p>';</script><style>p{{}}</style><!-- <p>x</p> --><p>{P}<br>next <b>bo</b>ld", f"{P} next bold"),
        (
            f"<article><header><h1>Head</h1></header><p>{P}</p><aside>Related links</aside><form>Join <input></form><p>End &lt;ok&gt;</p></article>",
            f"Head {P} End <ok>",
        ),
        (f"<ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>{P}</p><p class=\"cookie-notice\">We use cookies.</p>", P),
        (f"<p>{P}</p><p>3 < 4 and 5 > 2</p><p", f"{P} 3 < 4 and 5 > 2"),
    ],
)
def test_pages(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='content has-sidebar'><article><p>{P}</p></article></div>", P),
        (f"<div class='content has-sidebar'><p>{P}</p></div>", P),
        (f"<div class='search-results'><main><p>{P}</p><div class=share>Tweet</div></main></div><p>After it all.</p>", P),
        (f"<div id=form-page><p>Say it.</p><article><p>{P}</p></article></div>", P),
        (
            f"<article><p>{P}</p></article><div class=sidebar><article>Teaser</article></div><div class=comments><article>Me too</article></div>",
            P,
        ),
        (f"<article><div class='article-header'><h1>Title</h1></div><p>{P}</p></article>", f"Title {P}"),
        (f"<article><h2><a href=x>All of it a link</a></h2><p>{P}</p><p><a href=y>{P}</a></p></article>", f"All of it a link {P} {P}"),
        (f"<p>{P}</p><p><a href=y>Read this too</a></p><p>{P}</p>", f"{P} Read this too {P}"),
        (f"<article><p>{P}</p><figure><img src=x><figcaption>A view.</figcaption></figure></article>", f"{P} A view."),
        (f"<p>{P}</p><!-- <script> --><p>Still here.</p>", f"{P} Still here."),
        (f"<script>var a = '<!--';</script><p>{P}</p>", P),
        (f"<p>{P}</p><svg width=1 /><p>Still here.</p>", f"{P} Still here."),
        (
            f"<p>{P}</p>" * 20 + "<nav>x</nav><div class=ad>y</div><ul><li><a href=1>1</a><li><a href=2>2</a><li><a href=3>3</a></ul>" + f"<p>{P}</p>",
            " ".join([P] * 21),
        ),
    ],
)
def test_article_text_is_not_dropped(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div style='overflow:hidden'><p>{P}</p></div>", P),
        (f"<div class='overflow-hidden'><article><p>{P}</p></article></div>", P),
        (f"<div class='page no-sidebar'><p>{P}</p></div>", P),
        (f"<div class='side-by-side'><p>{P}</p></div>", P),
        (f"<div class='content-with-sidebar menu-open'><p>{P}</p></div><p>And this.</p>", f"{P} And this."),
        (f"<style-guide><p>{P}</p></style-guide><object-card>And this one.</object-card>", f"{P} And this one."),
        (f"<form id=page><main><p>{P}</p><form><label>Mail</label></form></main></form>", P),
        (
            f"<article><p>{P}</p>" + "<p><a href=x>Read this</a></p>" * 5 + "<p>End.</p></article>",
            " ".join([P, *["Read this"] * 5, "End."]),
        ),
        ("<article><p>Short.</p></article><div><p>" + P * 9 + "</p></div>", "Short."),
        (f"<div><p>{P}</p></div></div><div><div><p>&copy; us</p></div></div>", P),
        (f"<p>{P}</p><p style='display:none'>No</p><p hidden>No</p><p aria-hidden=true>No</p>", P),
        (f"<p>R&<b>amp;D {P}</b></p>", f"R&amp;D {P}"),
        (f"<div class='user-comments-list'><p>{P}</p></div>", ""),
    ],
)
def test_layout_words_and_odd_names(page, text):
    assert H.main_text(page) == text


def test_long_and_broken_pages_are_linear():
    page = "<div title=\"x" + "<p a='" * 20000 + P
    assert isinstance(H.main_text(page), str)
    assert H.main_text("<article>" + f"<p>{P}</p>" * 5000 + "</article>") == " ".join([P] * 5000)
    H.main_text("<p>warm</p>")
    began = time.process_time()
    H.main_text("<div>" * 8000 + "</span>" * 8000 + P)
    H.main_text("<article>" + "<div><p>" * 8000 + "</i></p>" * 8000 + P)
    assert time.process_time() - began < 1.5


def _bare_pages():
    """Pages of the test tables without the marks of their articles."""
    return [re.sub("</?article>", "", x) for x in pd.read_parquet("/root/testdata/sf0.01/pages.parquet")["html"].dropna()]


def test_the_distribution_alone_decides():
    """All lines between surge and dive, with no look at elements or names, are the text of pages that mark no article."""
    for page, bare in zip(pd.read_parquet("/root/testdata/sf0.01/pages.parquet")["html"].dropna(), _bare_pages(), strict=True):
        found = H.lines(bare)
        lengths, marked = H.weigh(found)
        spans = H.regions(lengths)
        inside = {k for a, b in spans for k in range(a, b)}
        assert not any(marked) and any(x.text and k not in inside for k, x in enumerate(found))
        assert " ".join(found[k].text for k in sorted(inside) if found[k].text) == H.main_text(bare) == H.main_text(page)


def test_without_the_distribution_menus_come_through():
    assert all(" ".join(x.text for x in H.lines(page) if x.text) != H.main_text(page) for page in _bare_pages())


def _plain_regions(lengths, window=H.WINDOW):
    """The rule of surge and dive word by word: of every pair of lines, whether a region runs from one to the other."""
    n = len(lengths)
    total = lambda i: sum(lengths[i : i + window])
    least = min(H.SURGE_CHARS, H.SURGE_SHARE * max(map(total, range(n)), default=0))
    out = []
    for a in range(n):
        for b in range(a, n):
            quiet_before = all(not lengths[k] for k in range(max(0, a - window), a))
            quiet_after = not total(b + 1)
            running = all(total(k) for k in range(a, b))
            fullest = max(map(total, range(max(0, a - window + 1), b + 1)))
            if lengths[a] and lengths[b] and quiet_before and quiet_after and running and fullest >= least:
                out.append((a, b + 1))
    return out


@settings(deadline=None, max_examples=400)
@given(st.lists(st.sampled_from([0, 0, 0, 0, 1, 7, 30, 90, 400]), max_size=24))
def test_regions_against_the_plain_rule(lengths):
    assert H.regions(lengths) == _plain_regions(lengths)


def test_tables(spark):
    pages = spark.createDataFrame(
        [(1, "u", None, 1), (2, None, f"<p>{P}</p>", 2), (2, None, f"<p>{P}</p>", 2)],
        "page_id long, url string, html string, n_chars int",
    )
    rows = {r["page_id"]: r for r in H.extract(pages).collect()}
    assert rows[1]["text"] == "" and rows[1]["n_chars"] == 0 and rows[2]["n_chars"] == len(P)
    assert H.extract(pages.limit(0)).count() == 0


def test_clashing_columns_and_repeated_pages(spark):
    pages = spark.createDataFrame(
        [(1, "u", f"<p>{P}</p>", "x", 5), (1, "u", f"<p>{P}</p>", "x", 5)],
        "page_id long, url string, html string, text string, n_chars long",
    )
    assert [(r["text"], r["n_chars"]) for r in H.extract(pages).collect()] == [(P, len(P))] * 2


def test_regions_surge_and_dive():
    assert H.regions([0, 0, 90, 0, 50, 0, 0, 0, 5, 0]) == [(2, 5)]
    assert H.regions([]) == [] and H.regions([0, 0]) == []
