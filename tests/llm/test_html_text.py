"""Main text of pages: written-out cases, and the given pages against their article elements."""

import html
import re

import pytest

from palimpsest.llm import html_text as H

LONG = "A sentence of the article that is long enough to matter, with commas and all. " * 4
MORE = "Another paragraph follows it here, and says a little more than the one before did. " * 3


def tidy(text):
    return " ".join(text.split())


def page(body):
    return f"<!DOCTYPE html><html><head><title>Title</title><style>p{{}}</style></head><body>{body}</body></html>"


NAV = "<nav><ul>" + "".join(f'<li><a href="/{k}">link {k}</a></li>' for k in range(8)) + "</ul></nav>"

CASES = {
    "article": (NAV + f"<article><h1>Head</h1><p>{LONG}</p><p>{MORE}</p></article><footer>&copy; site</footer>", f"Head {LONG} {MORE}"),
    "unclosed": (NAV + f"<article><h1>Head</h1><p><b>Lead<br><p>{LONG}</p><p>{MORE}</article><footer>f</footer>", f"Head Lead {LONG} {MORE}"),
    "no article": (f'<div class="top-menu"><a href="a">a</a></div><div id="c"><p>{LONG}</p><p>{MORE}</p></div><div class="sidebar"><p>{MORE}</p></div>', f"{LONG} {MORE}"),
    "in body": (NAV + f"<h1>Head</h1><p>{LONG}</p><p>{MORE}</p><footer>end</footer>", f"Head {LONG} {MORE}"),
    "sections": (f"<article><section><h2>One</h2><p>{LONG}</p><p>{MORE}</p><p>{LONG}</p></section><section><h2>Two</h2><p>{MORE}</p></section></article>", f"One {LONG} {MORE} {LONG} Two {MORE}"),
    "parts apart": (
        f'<article><header><nav>menu</nav><h1>Head</h1><p>by someone</p></header><p>{LONG}</p><aside>aside</aside><div class="ad">buy</div><form><label>f</label></form>'
        f'<figure class="promo-box">p</figure><div role="alert">alert</div><p hidden>gone</p><p style="display: none">gone</p><p>{MORE}</p></article>'
        f'<section id="comments"><p>{LONG}</p></section><div class="cookie-notice">we use</div>',
        f"Head {LONG} {MORE}",
    ),
    "class on body": (f'<div class="page has-sidebar"><p>{LONG}</p><p>{MORE}</p></div>', f"{LONG} {MORE}"),
    "references": (f"<article><p>{LONG} &lt;b&gt; &amp;amp; &copy;&#233;&#x1F600; a&nbsp;b &unknown; &quot</p></article>", LONG + " <b> &amp; ©é😀 a b &unknown; \""),
    "running tags": (f"<article><p>{LONG}<b>bo</b>ld <i>it</i><em>al</em>\n  x<br>y</p><ul><li>one<li>two</ul></article>", f"{LONG}bold ital x y one two"),
    "raw content": (f"<article><script>var a='<p>no</p>';</script><p>{LONG}</p><!-- <p>no</p> --><style>a</style><p>{MORE}</p></article>", f"{LONG} {MORE}"),
    "cut off": (f"<article><p>{LONG}</p><p>{MORE}</p></article><footer>f &mid", f"{LONG} {MORE}"),
    "unclosed comment": (f"<article><p>{LONG}</p></article><!-- {MORE}", LONG),
    "odd quotes": (f'<article><p title="a>b" data-x=\'<p>\'>{LONG}</p><p class="x>{MORE}</p></article>', None),
    "table": (f"<main><table><tr><td>{LONG}<td>{MORE}</table></main>", f"{LONG} {MORE}"),
    "comments inside": (f'<article><p>{LONG}</p><p>{MORE}</p><div class="comments"><article class="comment"><p>me too</p></article></div></article>', f"{LONG} {MORE}"),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    body, want = CASES[name]
    got = H.main_text(page(body))
    if want is not None:
        assert got == tidy(want)


@pytest.mark.parametrize("text,want", [(None, ""), ("", ""), ("   ", ""), ("plain text only", "plain text only"), ("<", "<"), ("<p", ""), ("<script>x", ""), ("</p></div>", ""), ("<html><body></body></html>", "")])
def test_edges(text, want):
    assert H.main_text(text) == want


def test_long_and_deep_pages():
    assert H.main_text("<article>" + "<div>" * 5000 + LONG + "</div>" * 5000 + "</article>") == tidy(LONG)
    words = "word " * 300000
    assert H.main_text(page(f"<article><p>{words}</p></article>")) == tidy(words)
    assert H.main_text("<article><p>" + "<b>x" * 3000 + "</article>") == "x" * 3000


def from_article(page):
    """Fixed to the given pages: the article element, paragraphs as blocks."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    return tidy(html.unescape(re.sub(r"<[^>]*>", lambda m: "" if m.group() in ("<b>", "</b>") else " ", inner)))


def test_query(spark):
    from palimpsest.llm.queries import REGISTRY

    folder = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in REGISTRY.queries["op5_html_text"](spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(pages)
    for row in pages:
        assert got[row.page_id].text == from_article(row.html) and got[row.page_id].n_chars == len(got[row.page_id].text)
        assert got[row.page_id].url == row.url


def test_rows(spark):
    rows = spark.createDataFrame([(1, None, "t", 1), (None, "<p>x y</p>", None, 2), (1, None, "t", 1)], "page_id long, html string, text string, n_chars int")
    got = sorted(map(tuple, H.extract(rows).collect()), key=repr)
    assert got == [(1, 1, ""), (1, 1, ""), (None, 2, "x y")]
    assert H.extract(rows.limit(0)).collect() == []


REMARKS = "".join(f"<div><p>{k} {'A reader says what readers say of it. ' * 5}</p></div>" for k in range(12))
THREE = "".join(f"<p>{LONG} {k}</p>" for k in range(3))
ALL_THREE = " ".join(f"{LONG} {k}" for k in range(3))

PARTS = {
    "long comments": (f"<div>{THREE}</div><div class='comments'>{REMARKS}</div>", ALL_THREE),
    "long comments in body": (f"{THREE}<div class='comments'>{REMARKS}</div>", ALL_THREE),
    "long comments in article": (f"<article>{THREE}<section id='comments'>{REMARKS}</section></article>", ALL_THREE),
    "long comments, short article": (f"<h1>Head</h1><p>Short.</p><div class='comments'>{REMARKS}</div>", "Head Short."),
    "long sidebar": (f"<div>{THREE}</div><div class='sidebar'>{REMARKS}{REMARKS}</div>", ALL_THREE),
    "long advert": (f"<article>{THREE}<div class='advert'><p>{MORE * 9}</p></div></article>", ALL_THREE),
    "long cookie notice": (f"<div>{THREE}</div><div class='cookie-notice'><p>{MORE * 9}</p></div>", ALL_THREE),
    "related work": (f"<article>{THREE}<section id='related-work'><h2>Related work</h2><p>Little.</p></section></article>", f"{ALL_THREE} Related work Little."),
    "notice": (f"<div>{THREE}<div class='notice'><p>{MORE}</p></div></div>", f"{ALL_THREE} {MORE}"),
    "notice in related": (f"<article>{THREE}<div class='related'><div><div class='notice'><p>{MORE}</p></div></div></div></article>", f"{ALL_THREE} {MORE}"),
    "related links": (f"<article>{THREE}<div class='related'><p>Read: <a href='x'>another long headline</a></p></div><div class='share'>Share</div></article>", ALL_THREE),
    "notice outside": (f"<article>{THREE}</article><div class='notice'><p>{MORE * 9}</p></div>", ALL_THREE),
    "sidebar around all": (f"<div class='sidebar-layout'>{THREE}<div class='comments'>{REMARKS}</div></div><p>Us.</p>", f"{ALL_THREE} Us."),
    "article with words": (f"<article class='post category-advertising has-sidebar'>{THREE}</article><p>{MORE}</p>", ALL_THREE),
    "comments only": (f"<div class='comments'><p>{LONG}</p></div>", LONG),
}


@pytest.mark.parametrize("name", PARTS)
def test_parts_by_class_or_id(name):
    body, want = PARTS[name]
    assert H.main_text(page(body)) == tidy(want)


FIELDS = "<label for='q'>Search for</label><input id='q' type='text'><select><option>one<option>two</select><textarea>own words</textarea><button>Go</button>"
HIDDEN = "<input type='hidden' name='__VIEWSTATE' value='x'>" * 20

FORMS = {
    "page in a form": (f"<form id='aspnetForm' method='post'>{HIDDEN}{NAV}<div id='content'><h1>Head</h1>{THREE}</div>{FIELDS}</form>", f"Head {ALL_THREE}"),
    "page in a form, by role": (f"<form role='form'><article><h1>Head</h1>{THREE}</article></form>", f"Head {ALL_THREE}"),
    "short page in a form": (f"<form id='f'>{HIDDEN}<h1>Head</h1><p>Short text.</p>{FIELDS}</form>", "Head Short text."),
    "article in a form": (f"{NAV}<p>Site</p><form>{FIELDS}<article>{THREE}</article></form><footer>end</footer>", ALL_THREE),
    "paragraph in a form in an article": (f"<article>{THREE}<form><p>{MORE}</p><button>Next</button></form></article>", f"{ALL_THREE} {MORE}"),
    "newsletter in an article": (f"<article>{THREE}<form><p>Write your address here, and the letter comes to you each Friday.</p><input type='email'><button>Go</button></form></article>", ALL_THREE),
    "search in an article": (f"<article>{THREE}<form>Search <input><label>all words</label></form></article>", ALL_THREE),
    "comments in a page form": (f"<form>{THREE}<div class='comments'>{REMARKS}{FIELDS * 9}</div></form>", ALL_THREE),
    "label left open": (f"<form><label>Head<p>{LONG}</p><p>{MORE}</p></form>", f"Head {LONG} {MORE}"),
    "two forms": (f"<form>{FIELDS * 30}<p>{LONG}</p></form><form>{FIELDS * 30}<p>{MORE}</p></form>", f"{LONG} {MORE}"),
}


@pytest.mark.parametrize("name", FORMS)
def test_forms(name):
    body, want = FORMS[name]
    assert H.main_text(page(body)) == tidy(want)
