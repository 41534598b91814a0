"""Main text of pages."""

import html as stdlib_html
import re
import time

import pytest

from peakloom.llm import html, queries
from tests.llm import fixtures

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a="</p><p>no, no, no";</script></head>
<body class="single-post"><header class="site"><a href=/>Home</a></header><div id="cookie-notice">We use cookies, yes, really, a lot of them.</div>
<div id="main"><div class="post-content has-sidebar"><h2>Title &amp; more</h2><p>First para, with commas, and a <a href="x">link</a> inside&nbsp;it. It is long enough, surely.<p>Second
 para<br>with break, more text, more commas, fine.<!-- <p>hidden, by a comment</p> -->
<div class="share">Share this, please</div><blockquote>Quoted words, nice.</blockquote><ul><li>one item, ok<li>two items, ok</ul>
<form><p>Sign up, now, please</p></form><p style="display: none">unseen, text</p></div>
<div id="comments"><p>Reader says, hello, this is a long comment, with a lot of commas, yes, indeed, it is.</p></div></div>
<div class="sidebar"><p>Side, stuff, here</p></div><aside>more, side</aside><footer>foot, note</footer></body></html>"""


def test_page():
    assert html.main_text(PAGE).split("\n\n") == [
        "Title & more", "First para, with commas, and a link inside it. It is long enough, surely.",
        "Second para with break, more text, more commas, fine.", "Quoted words, nice.", "one item, ok", "two items, ok",
    ]


@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain words &lt; here", "plain words < here"), ("<p>a<p>b", "a\n\nb"), ("a < b and <b", "a < b and"),
    ("<nav>menu</nav>", ""), ("<script>x", ""), ("<!-- open", ""), ("<div>" * 5000 + "deep, text", "deep, text"),
    ("<article><p>one, two</p><p>one, two</p></article>", "one, two\n\none, two"), ("<article>" + "<b>x</b>y " * 3 + "</article>", "xy xy xy"),
    ("<p>&amp;amp; &#233; &bogus; &copy", "&amp; é &bogus; ©"),
])
def test_cases(source, text):
    assert html.main_text(source) == text


def by_pattern(source):
    """The test pages' article, by the template that made them."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", body))
    parts = [" ".join(stdlib_html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n\n".join(p for p in parts if p)


def test_op5(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op5_main_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == by_pattern(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_awkward_pages(spark, tmp_path):
    rows = [(1, None, None), (None, "u", PAGE), (None, "u", PAGE), (2, "u", "<p>" + "long, " * 100000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars", "'x' as __html_")
    got = queries.op5_main_text(spark, fixtures.saved(spark, tmp_path, df, "pages")).collect()
    assert sorted(r["n_chars"] for r in got)[0] == 0 and len(got) == 4 and max(r["n_chars"] for r in got) == 6 * 100000 - 1
    assert html.extract(df.limit(0)).count() == 0


PARA = "<p>An ordinary long paragraph, with commas, and many words that make up an article, as one would expect it to be.</p>"
BODY = PARA * 5
WANT = ["An ordinary long paragraph, with commas, and many words that make up an article, as one would expect it to be."] * 5


@pytest.mark.parametrize("source, more", [
    (f'<body><div id="content-sidebar-wrap"><main>{BODY}</main></div></body>', []),
    (f'<body><div class="entry-content share-enabled">{BODY}</div></body>', []),
    (f'<body><div class="search-results-none main-content">{BODY}</div></body>', []),
    (f'<article>{BODY}<p class="notice-of-law">A law, quoted.</p><div class="promotion-rules"><p>Rules for promotion.</p></div></article>', ["A law, quoted.", "Rules for promotion."]),
    (f"<body><div><section>{BODY}</section></div><div><section>{BODY}</section></div></body>", WANT),
    (f"<body><div>{BODY}</div><p>Short end.</p></body>", ["Short end."]),
    (f'<body><div class="sidebar">{BODY}</div><div id="story">{BODY}{PARA}</div></body>', WANT[:1]),
    (f'<body><div class="widget">{BODY}</div></body>', []),
    (f'<body><ul class="site-menu"><li>One<li>Two</ul><div>{BODY}</div><div class="comment-list">{BODY}{BODY}</div><div class="cookieNotice"><p>We use cookies, yes.</p></div></body>', []),
    (f'<body><div class="ad-slot"><p>Buy, buy, buy.</p></div><td>{BODY}</td><div class="footer-bottom"><p>Foot, note.</p></div></body>', []),
    (f'<body><section>{BODY}<ul><li><a href=x>See one</a><li><a href=y>See two</a></ul></section></body>', ["See one", "See two"]),
    (f'<body><ul><li><a href=x>Home page</a><li><a href=y>Other page</a></ul>{BODY}</body>', []),
    (f'<body><div class="post has-comments">{BODY}</div></body>', []),
    (f'<body><article class="post with-comments">{BODY}</article></body>', []),
    (f'<body><div id="post-and-comments">{BODY}<div class="comments">{PARA}{PARA}</div></div></body>', []),
    (f'<body><div class="has-comments">{BODY}</div><div class="has-comments">{BODY}</div></body>', WANT),
    (f'<body><div class="post">{BODY}</div><div class="comments"><div class="comment">{BODY}{BODY}</div></div></body>', []),
    (f'<body><form id="aspnetForm"><div id="nav"><a href=x>x</a></div>{BODY}<label>Name</label><input><select><option>One</select><button>Go</button></form></body>', []),
    (f'<body><fieldset><legend>Log in</legend>{BODY}</fieldset></body>', []),
    (f'<body><div>{BODY}<form><p>Sign up, please.</p></form></div></body>', []),
    (f'<article>{BODY}<p>We saw <span class="notice">the notable result</span> of <em class="related">it</em>, and <a class="share" href=x>told</a>.</p></article>', ["We saw the notable result of it, and told."]),
    (f'<article>{BODY}<p><a class="share" href=x>Share this</a></p><ol><li><a href=x>A paper</a><li><a href=y>A book</a></ol></article>', ["A paper", "A book"]),
])
def test_shapes(source, more):
    """Pages of other makers: names that only mention furniture delete nothing, and halves, ends and lists fall right."""
    assert html.main_text(source).split("\n\n") == WANT + more


def test_names_alone_make_no_article():
    assert html.main_text('<div class="menu"><p>one, two</p></div>') == "" and html.main_text('<div class="notice"><p>Mind the gap.</p></div>') == ""


@pytest.mark.parametrize("part", ["<a", '<a ">"', '<a =">"', "<!--", "<div>", "<p>", 'x="', "<i><div><b></i>", "<ul><li>", "<", "&", "<table><tr><td>", "<script>"])
def test_broken_markup_takes_linear_time(part):
    started = time.process_time()
    html.main_text(part * (1_000_000 // len(part)))
    assert time.process_time() - started < 60
