"""Main text of pages: markup that lies, pages without marks, and the rules of both passes."""

from __future__ import annotations

import time

import pytest

from tributary.llm import html_text

KNOWN = frozenset(w for x in html_text.STOP_WORDS.values() for w in x.split())
RUNNING = "It was in the year of the great flood that they had to leave the house by the river, and all of it was lost."
LONG = " ".join([RUNNING] * 3)


def text(page):
    return html_text.main_text(page, KNOWN)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        (" \n\t ", ""),
        ("plain", "plain"),
        ("<p>a&amp;b &lt;i&gt; &eacute;&#233;&#xe9; &copy 1&nbsp;&nbsp;x</p>", "a&b <i> ééé © 1 x"),
        ("<p>&amp;amp; once</p>", "&amp; once"),
        ("<p>one<p>two<br>lines\n  more</p>three", "one\n\ntwo lines more\n\nthree"),
        ("<p>a<b>b</b>c <i>d", "abc d"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<p>kept</p><p title='cut", "kept"),
        ("<p>kept <", "kept <"),
        ('<p title="a > b">kept</p>', "kept"),
        ('<p title="no end>kept</p>', "kept"),
        ("<p>a</p><!-- <p>no</p> --><p>b</p><!-- open <p>no", "a\n\nb"),
        ("<!-->a<p>b", "a\n\nb"),
        ("<script>var t='</p><p>no';</script><p>yes</p><style>p{}</style><SCRIPT>x</sCript ><p>too", "yes\n\ntoo"),
        ("<p>yes</p><script>never ends <p>no", "yes"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\n\nb\n\nc\n\nd"),
        ("<table><tr><td>a<td>b<tr><th>c</table>", "a\n\nb\n\nc"),
        ("<div hidden>no</div><p style='display: none'>no</p><p aria-hidden=true>no</p><p>yes</p>", "yes"),
        ("</p></div></><p>yes</p></body></body>", "yes"),
        ("<?xml version='1.0'?><!DOCTYPE html><![CDATA[no]]><p>yes", "yes"),
    ],
)
def test_markup(page, want):
    assert text(page) == want


@pytest.mark.parametrize(
    "around",
    [
        "<nav><ul><li><a href=/a>Home</a></ul></nav>{}<footer>&copy; host</footer>",
        "<header><h1>Site</h1></header>{}<aside><p>" + LONG + "</p></aside>",
        '<div class="cookie-notice"><p>' + LONG + '</p></div>{}<div id="sideBar">' + LONG + "</div>",
        "<form><p>" + LONG + '</p></form>{}<section class="reader comments"><article><p>' + LONG + "</p></article></section>",
        '<div class="ad">Buy now.</div>{}<div role="contentinfo">' + LONG + "</div>",
        "<div>Short words outside.</div>{}<div>" + LONG + "</div>",
    ],
)
def test_marked_article(around):
    own = "<h1>Title</h1><p>Be.</p><p>" + LONG + '</p><p><a href="#">one link</a></p><div class="share">Tell a friend</div><p>zzz xxx</p>'
    assert text("<html><body>" + around.format(f"<article>{own}</article>") + "</body></html>") == f"Title\n\nBe.\n\n{LONG}\n\none link\n\nzzz xxx"
    # the page may stop anywhere after the article
    assert text("<body>" + around.split("{}")[0] + f"<main>{own}").endswith("zzz xxx")


def test_unmarked_page_by_two_passes():
    menu = "".join(f'<div><a href="/{k}">Section {k}</a></div>' for k in range(6))
    page = f"<body>{menu}<div>News today</div><h2>Floods</h2><div>{LONG}</div><div>Oh no.</div><div>{RUNNING}</div><div>By me</div><div>All</div>{menu}<div>Top</div>{menu}</body>"
    # beside the menu or beside the text, whichever is nearer; the heading looks behind
    assert text(page) == f"Floods\n\n{LONG}\n\nOh no.\n\n{RUNNING}\n\nBy me"


def test_unknown_language_and_all_short():
    other = " ".join(f"zq{k} vrk" for k in range(40))
    links = "".join(f"<li><a href=#>link {k}</a>" for k in range(5))
    assert text(f"<ul>{links}</ul><p>{other}</p>") == other
    assert text("<p>Hi.</p><p>There.</p>") == "Hi.\n\nThere."


def test_inheritance_against_a_plain_search():
    import random

    rng = random.Random(3)
    for _ in range(300):
        found = [rng.choice([True, False, None, None]) for _ in range(rng.randrange(1, 12))]
        blocks = [html_text.Block(False, False, rng.random() < 0.3) for _ in found]
        want = []
        for k, own in enumerate(found):
            decided = sorted((abs(j - k), j) for j, x in enumerate(found) if x is not None)
            near = [j for d, j in decided if d == decided[0][0]] if own is None else [k]
            if not near:
                want.append(True)
            elif len(near) == 2:
                want.append(found[near[1]] if blocks[k].heading else found[near[0]] or found[near[1]])
            else:
                want.append(found[near[0]])
        assert html_text.inherited(found, blocks) == want


@pytest.mark.parametrize("page", ["<a '" * 50_000, "<a '" * 50_000 + "'>'", "<div>" * 50_000, "<p><b>" * 50_000 + "x", "</i>" * 100_000, "<li>" * 50_000, "<!-- " * 50_000, "< " * 100_000, "<script>" * 50_000, "&" * 300_000, "<td><ul>" * 20_000])
def test_broken_pages_take_linear_time(page):
    began = time.perf_counter()
    text(page)
    assert time.perf_counter() - began < 10


def test_frames(spark):
    rows = [(1, "u", "<p>é a</p>"), (1, "u", "<p>é a</p>"), (2, None, None), (None, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.op13(pages.selectExpr("*", "1 as text", "2 as n_chars"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", "é a", 3), (1, "u", "é a", 3), (2, None, "", 0), (None, "v", "", 0)], key=str)
    assert html_text.op13(pages.limit(0)).count() == 0
    wide = html_text.extracted(pages.selectExpr("page_id", "array(html) as more", "html as text"), source="text")
    assert wide.columns == ["page_id", "more", "text", "n_chars"] and "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()
