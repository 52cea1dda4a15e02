"""Main text of pages."""

import html
import re
import time

import pandas as pd
import pytest

from tests.llm.helpers import frame
from tidewatch.llm.html_text import extract_text, main_text
from tidewatch.llm.queries import QUERIES

W = "The quick brown fox jumps over the lazy dog and runs far away."
CASES = {
    "layout of divs": (
        f'<body><div id="header"><a href=/>Home</a> Site</div><div class="menu"><ul><li><a href=#>One</a><li><a href=#>Two</a></ul>'
        f'</div><div class=wrap><div class="content"><h2>Head</h2><p>{W} {W}</p><p>{W}</p><div class="ad">Buy {W}</div>'
        f'<ul><li>one</li><li>two</li></ul></div><div class="sidebar">{W}</div></div><div class=comments><p>{W} {W}</p></div>'
        f"<div id=footer>(c) me</div></body>",
        f"Head\n{W} {W}\n{W}\none\ntwo",
    ),
    "main element": (
        f"<html><body><header><h1>Site</h1></header><main><h1>T &amp; U</h1><p>{W}</p><form><input name=x>{W}</form></main></body>",
        f"T & U\n{W}",
    ),
    "unclosed tags": (f"<article><p><b>{W}<br><p>{W}<ul><li>a<li>b</ul></article>", f"{W}\n{W}\na\nb"),
    "script with a tag": (f'<article><p>{W}</p><script>var x="</p><p>no</p>";</script></article>', W),
    "white space": ("<article><p>  a\n\n b\t<i>c</i>d </p></article>", "a b cd"),
    "text only": ("just text &lt;b&gt; &#233;", "just text <b> é"),
    "comment": (f"<article><!-- <p>hidden</p> --><p>{W}</p></article>", W),
    "sections": (
        f"<body><article><section><h2>A</h2><p>{W}</p></section><section><h2>B</h2><p>{W} {W}</p></section></article>"
        f'<section class="related"><p>{W} {W} {W}</p></section></body>',
        f"A\n{W}\nB\n{W} {W}",
    ),
    "wrapper named after what it has": (f"<div id=page class='has-sidebar'><article><h1>T</h1><p>{W}</p></article><div class=sidebar>{W}</div></div>", f"T\n{W}"),
    "a form around the page": (f"<body><form><nav><a href=/>Home</a></nav><article><p>{W}</p><button>Send</button></article></form>", W),
    "a form around a page of divs": (f"<body><form><div id=nav><a href=/>Home</a></div><div><p>{W}</p><p>{W}</p></div></form>", f"{W}\n{W}"),
    "layout with a menu's name": (f"<div class='layout-nav-left'><main><p>{W}</p></main></div>", W),
    "no adverts": (f"<div class='no-ads'><p>{W}</p><p>{W}</p></div>", f"{W}\n{W}"),
    "names that begin like an advert's": (f"<article><p class='share-price'>{W}</p><p id='ad-hoc-committees'>{W}</p></article>", f"{W}\n{W}"),
    "widget around an article": (f"<div class='widget-text'><article><p>{W}</p></article></div><div class=widget>{W}</div>", W),
    "share links inside": (f"<article><p>{W}</p><div class='share-links'><a href=#>This</a> <a href=#>That</a></div><div class='ad-hoc'><p>{W}</p></div></article>", f"{W}\n{W}"),
    "comments as articles": (f"<body><article><p>{W}</p></article><div class='comments-area'><article><p>{W} {W} {W}</p></article></div></body>", W),
    "comments of comment articles": (f"<body><div class=post><article><p>{W}</p></article><ol class=comment-list><li><article class=comment><p>{W} {W}</p></article></ol></div>", W),
    "long comments": (f"<body><div class=content><p>{W}</p><p>{W}</p></div><div class=comments><p>{W} {W} {W}</p></div></body>", f"{W}\n{W}"),
    "hidden until loaded": (f"<body style='display:none'><article><p>{W}</p><p hidden>no</p></article></body>", W),
    "no end of the head": (f"<html><head><title>x</title><meta charset=utf-8><body><p>{W}</p><p>{W}</p>", f"{W}\n{W}"),
    "site footer": (f"<body><div><p>{W}</p><p>{W}</p></div><div class=site-footer><p>{W}</p></div></body>", f"{W}\n{W}"),
    "end tags that nothing opened": (f"<article></div></i></p><p>{W}</b></section></p></article>", W),
    "table cells": (f"<article><table><tr><td><p>one<td>two</p> more<tr><td>{W}</table></article>", f"one\ntwo more\n{W}"),
    "menus only": ("<nav><a href=x>a</a></nav>", ""),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    page, expected = CASES[name]
    assert main_text(page) == expected


def test_query(spark, sf_dir):
    pages = pd.read_parquet(f"{sf_dir}/pages.parquet").set_index("page_id")
    got = QUERIES["op10_html_text"](spark, sf_dir).toPandas()
    assert len(got) == len(pages) and (got.n_chars == got.text.str.len()).all()
    for row in got.itertuples():
        article = re.search("<article>(.*)</article>", pages.html[row.page_id], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)[^>]*>", article)]
        assert row.text == "\n".join(b for b in blocks if b)


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", "<p>x"), (2, "u", "<" * 1000), (3, "u", '<a "' * 1000)]
    pages = frame(spark, rows, "page_id long, url string, html string").selectExpr("*", "'c' AS text", "1 AS n_chars")
    got = extract_text(pages).toPandas()
    assert len(got) == 5 and got.text.notna().all() and extract_text(pages.limit(0)).count() == 0


UNCLOSED = ("<b>" * 330_000, "<div>" * 50_000 + "</i>" * 50_000, "<p><td>" + "<b>" * 50_000 + "</p>" * 50_000, "<noscript>" * 20_000, "<li><ul>" * 20_000 + "<li>" * 20_000)


@pytest.mark.parametrize("page", UNCLOSED)
def test_unclosed_tags_take_linear_time(page):
    began = time.process_time()
    assert main_text(page + W).count(W) <= 1
    assert time.process_time() - began < 5


def test_hostile_pages_take_no_long_time():
    began = time.process_time()
    for page in (*UNCLOSED, "<div>" * 5000 + "x", "<p>" * 20000, "<script>" * 3000, '<a "' * 5000, "</" * 20000):
        main_text(page)
    assert time.process_time() - began < 20
