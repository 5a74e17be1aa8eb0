"""Main text of pages: every kind of what surrounds an article, broken markup, and the pages of the data against a plain cut."""

import html
import re
import time

import pytest
from conftest import passage
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiforge.llm import queries
from lexiforge.llm.main_text import Page, density, main_text, main_texts

P = [passage(k, 40) + "." for k in range(6)]
LINKS = "".join(f'<li><a href="/{k}">{passage(50 + k, 2)}</a></li>' for k in range(8))
BODY = f"<h1>{passage(70, 6)}</h1><p>{P[0]}</p><p>{P[1]}</p><p>Short one.</p><p>{P[2]}</p>"
TEXT = "\n\n".join([passage(70, 6), P[0], P[1], "Short one.", P[2]])
AROUND = {
    "menu": f"<nav><ul>{LINKS}</ul></nav>", "plain menu": f"<ul>{LINKS}</ul>", "menu by name": f'<div class="main-menu">{LINKS}</div>', "header": f"<header><p>{passage(80, 12)}</p></header>",
    "header by name": f'<div id="siteHeader"><h2>{passage(81, 12)}</h2></div>', "footer": f"<footer>&copy; {passage(82, 30)}</footer>", "footer by name": f'<div class="foo page-footer">{passage(83, 30)}</div>',
    "sidebar": f"<aside><p>{passage(84, 60)}</p></aside>", "sidebar by name": f"<div class='sidebar right'><p>{passage(85, 60)}</p></div>", "role": f"<div role=complementary>{passage(86, 60)}</div>", "notice": f'<div class="cookie-notice">{passage(87, 50)}</div>',
    "alert": f'<div role="alert">{passage(88, 30)}</div>', "advert": f'<div class="ad">{passage(89, 30)}</div>', "ads": f'<div id="ads_top">{passage(90, 30)}</div>', "advertisement": f'<p class="advertisement">{passage(91, 30)}</p>', "form": f"<form><p>{passage(92, 30)}</p><input name=q><button>Go now</button></form>",
    "script": "<script>if (a < b) document.write('<p>no text at all</p>')</script>", "style": "<style>p > b { color: red }</style>", "comment of markup": f"<!-- <p>{passage(93, 30)}</p> -->", "noscript": f"<noscript>{passage(94, 30)}</noscript>",
    "reader comments": '<section id="comments"><h2>Comments</h2>' + "".join(f"<article class='comment'><p>{passage(200 + k, 50)}</p></article>" for k in range(8)) + "</section>", "hidden": f"<div hidden>{passage(95, 40)}</div><p style='display: none'>{passage(96, 40)}</p>",
    "share": "<div class='share-buttons'>Share this now</div>", "select": "<select><option>One<option>Two</select><textarea>some words typed</textarea>",
}


@pytest.mark.parametrize("kind", list(AROUND))
def test_what_surrounds_an_article_goes(kind):
    around = AROUND[kind]
    for before, after in (("<article>", "</article>"), ("<main>", "</main>"), ('<div id="content">', "</div>"), ('<div class="wrap"><article class="post"><div>', "</div></article></div>"), ('<div class="post"><div class="post-header"></div>', "</div>")):
        for page in (f"{around}{before}{BODY}{after}", f"{before}{BODY}{after}{around}", f"{before}{BODY}{around}{after}"):
            assert main_text(f"<!DOCTYPE html><html><head><title>A title</title></head><body class='home'>{page}</body></html>") == TEXT, page


def test_everything_at_once_and_short_articles():
    every = list(AROUND.values())
    assert main_text(f"<html><body>{''.join(every[:12])}<div id=main><div class=entry>{BODY}</div></div>{''.join(every[12:])}") == TEXT
    for words in (3, 8, 20):
        page = f"<html><body><nav><ul>{LINKS}</ul></nav><article><h1>{passage(1, 4)}</h1><p><b>{passage(2, words)}<br>{passage(3, 1)}</article><footer>{passage(4, 60)}</footer></body>"
        assert main_text(page) == f"{passage(1, 4)}\n\n{passage(2, words)} {passage(3, 1)}"


def test_names_are_not_taken_at_their_word():
    for name in ("page with-sidebar", "no-ads", "layout sidebar-left", "header-fixed"):
        assert main_text(f"<body><div class='{name}'><article>{BODY}</article></div></body>") == TEXT
        assert main_text(f"<body><div class='{name}'><div>{BODY}</div></div></body>") == TEXT
    assert main_text(f"<body><form id=aspnet><div>{BODY}</div></form></body>") == TEXT
    assert main_text(f"<article><header class='entry-header'><h1>{passage(70, 6)}</h1></header><p title='a hidden ad' data-x='class=ad'>{P[0]}</p></article>") == f"{passage(70, 6)}\n\n{P[0]}"
    assert main_text(f"<div class=widget>{P[0]}</div>") == P[0]


def test_blocks_and_references():
    assert main_text("<article><p>a&nbsp;&amp;  b\n\tc&#233;<b>d</b>e<br>f &lt;p&gt; &notit; &#x1F600;</p>loose <i>text</i><ul><li>one<li>two</ul><table><tr><td>x<td>y<tr><td>z</table></article>") == "a & b céde f <p> ¬it; 😀\n\nloose text\n\none\n\ntwo\n\nx y\n\nz"
    assert main_text("just text & <b>no</b> <i>block</i> a < b <3 c") == "just text & no block a < b <3 c"
    assert [main_text(x) for x in (None, "", "  \n", "<html></html>", "<p></p>", "<!-- x", "<script>", "<p", "&nbsp;")] == [""] * 9


def test_broken_markup():
    assert main_text("<p>one<p>two</div></p></b>three<b>four<p>five</b> six") == "one\n\ntwo\n\nthreefour\n\nfive six"
    assert main_text("<article><p>kept text here<!-- never closed <p>gone") == "kept text here"
    assert main_text("<article><p>kept text here<p class='x") == "kept text here"
    assert main_text("<ARTICLE><P CLASS=AD>gone text</P><P>kept text</ARTICLE>") == "kept text"
    assert main_text("<p>a<!-->b<!--->c<!-- x --!>d<!doctype html>e<?php ?>f</>g</ x>h</p>") == "abcdefgh"
    assert main_text("<div><p>a<div>b</div>c</div><p>d<table><tr><td><p>e</div></td></tr></table>f") == "a\n\nb\n\nc\n\nd\n\ne\n\nf"


@pytest.mark.parametrize("part", ["<b>", "<div>", "<li>", "<ul><li>", "</b>", "<!--", "<a href=\"", "<a b='", "<script>", "<", "<p", "<p ", "</p>", "<table><tr><td>", "<b><div>", "&", "&#", "<a>x", "<h1>", "=\"'>", "<x =\"a\" "])
def test_any_page_takes_linear_time(part):
    began = time.time()
    main_text("<article>text " + part * 200_000 + " end")
    assert time.time() - began < 15


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div class=ad>", "<div>", "</div>", "<table>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "text ", "<a href=x>", "</a>", "<br>", "<article>", "</article>", "<h1>", "<head>", "</head>", "<script>x</script>", "<!-- y -->", "&amp;", "<", "\"", "<select><option>", "<svg/>"]), max_size=40))
def test_trees_are_well_formed(parts):
    page = Page("".join(parts))
    assert all(0 <= up < k for k, up in enumerate(page.parents) if k)
    depth = {}
    for k, d in enumerate(page.stack):
        depth[k] = d
    for group in ("#block", "#scope", "#list", "#table"):
        assert page.open[group] == sorted(page.open[group]) and all(x < len(page.stack) for x in page.open[group])
    assert not re.search(r"\s\s(?<!\n\n)|^\s|\s$", main_text("".join(parts)))


def test_density_is_adjusted_by_links():
    assert density(0, 0, 5, 0, 0.0) == 0.0
    plain, half, all_ = density(100, 0, 2, 0, 0.1), density(100, 50, 2, 1, 0.1), density(100, 100, 2, 2, 0.1)
    assert plain > half > all_ == 0.0
    assert density(100, 0, 1, 0, 0.1) > density(100, 0, 10, 0, 0.1)


def test_pages_of_the_data_equal_a_plain_cut(spark):
    """Each page's article, cut by its tags, blocks by theirs."""
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = queries.QUERIES["op13_text_density"](spark, sf)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and dict(out.dtypes)["n_chars"] == "bigint"
    got = out.collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1].replace("<b>", "").replace("<br>", " ")
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_rows_of_any_kind(spark):
    rows = [(1, None, "x", 1), (1, None, "x", 1), (None, "", "y", 2), (2, f"<article>{BODY}</article>", None, None), (3, "<p>" + "word " * 400_000, "z", 3)]
    table = spark.createDataFrame(rows, "page_id long, html string, text string, `a.b ``c` int")
    out = main_texts(table)
    assert out.columns == ["page_id", "lexi_text", "a.b `c", "text", "n_chars"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "x", 1, "", 0), (1, "x", 1, "", 0), (None, "y", 2, "", 0), (2, None, None, TEXT, len(TEXT)), (3, "z", 3, ("word " * 400_000).strip(), 1_999_999)], key=str)
    assert main_texts(table.limit(0)).count() == 0
