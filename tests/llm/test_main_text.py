"""Main text of pages: rules on whole pages, and the parser against a page built block by block."""

from __future__ import annotations

import html
import random
import time

import pytest

from archspark.llm.main_text import extract_main_text, label_blocks, main_text
from archspark.llm.queries import QUERIES

LONG = (
    "It was the best of the days that we had in the north, and the people of the town were out on the road with all that they had to see what "
    "would come of it before the night was over and the rain began to fall on the roofs and the walls of the old houses by the sea."
)
DENSE = "It is the third of the letters that she had from him in the spring of that year, and the last."
THIN = "Copper widget pricing: bulk discounts apply nationwide, shipping calculated separately, warranty excluded, batteries included free."


def page(body, head="<title>Title of it</title><style>p{margin:0}</style>"):
    return f"<!DOCTYPE html><html lang=en><head>{head}</head><body class='has-sidebar cookie-ok'>{body}</body></html>"


def test_article_without_its_surroundings():
    body = f"""
    <header class="site-header"><a href="/">Home</a><p>{DENSE}</p></header>
    <nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
    <div class="cookie-banner"><p>{LONG}</p><button>Accept all</button></div>
    <main><article><header><h1>The&nbsp;title &amp; more</h1></header>
      <p class=lead>{DENSE}<p>Short one.
      <p>Some <b>bold</b>, <a href="x">one link</a> and &lt;tags&gt; in a
         line.<br>Next line.</p>
      <script>var t = "</p><p>not text</p>"; if (a < b) track(0);</script><!-- <p>hidden</p> > -->
      <div class="ad">Buy the best of all the things that are in the shop.</div>
      <ul><li>First point<li>Second point <a title="a > b" href=x>here</a></ul>
      <blockquote>{LONG}</blockquote>
      <aside>{LONG}</aside>
      <form action="/s"><label>Mail</label><input name=q><p>{LONG}</p></form>
      <p hidden>{LONG}</p><div style="display: none">{LONG}</div>
      <pre>a   b
      c</pre><p>End.</p>
      <footer>Filed under things</footer></article>
    <section id="comments"><h2>Comments</h2><article class="comment"><p>{LONG}</p></article><article><p>{LONG}</p></article></section>
    </main>
    <aside class="widget"><p>{LONG}</p></aside>
    <footer>&copy; site &middot; {DENSE}</footer><noscript>{LONG}</noscript>"""
    want = [
        "The title & more", DENSE, "Short one.", "Some bold, one link and <tags> in a line. Next line.", "First point",
        "Second point here", LONG, "a b c", "End.",
    ]
    assert main_text(page(body)).split("\n\n") == want


def test_pages_without_marks_follow_the_rules():
    links = "".join(f'<div><a href="/{i}">Part {i} of the site</a></div>' for i in range(8))
    body = f"""<div>{links}</div><div>Sign in</div><div><h2>What came of it</h2><div>{LONG}</div><div>He left.</div><div>{LONG}</div>
    <div>{DENSE}</div><div>{LONG}</div></div><div>{THIN}</div><div>Copyright © 2020</div><div>{links}</div>"""
    assert main_text(page(body)).split("\n\n") == ["What came of it", LONG, "He left.", LONG, DENSE, LONG]
    assert main_text(page(f"<div>{links}</div><p>{THIN}</p>")) == ""


def test_short_blocks_alone_in_an_article_stay():
    assert main_text(page("<nav><a href=x>x</a></nav><article><h1>Sthe.</h1><p><b>Sthe.<br></article><footer>&copy; x</footer>")) == "Sthe.\n\nSthe."


def test_open_blocks_take_the_nearest_label():
    links = "<li><a href=1>Of one</a><li><a href=2>Of two</a>"
    body = f"<article><p>{LONG}</p><p>Short.</p><h3>Related</h3><ul>{links}</ul><p>{LONG}</p></article>"
    labels = [(b.text[:7], b.label) for b in label_blocks(page(body))]
    assert labels == [(LONG[:7], "good"), ("Short.", "good"), ("Related", "bad"), ("Of one", "bad"), ("Of two", "bad"), (LONG[:7], "good")]


def test_forms_around_the_page_and_void_names():
    body = f'<form id=aspnet><div class="page-widget"><h1>T of it</h1><article><p>{LONG}</p></article></div><input></form>'
    assert main_text(page(body)) == f"T of it\n\n{LONG}"
    assert main_text(page(f'<div class="no-sidebar"><p>{LONG}</p></div>')) == LONG
    assert main_text(page(f"<form><p>{LONG}</p></form><p>{LONG}</p><p>{LONG}</p>")) == f"{LONG}\n\n{LONG}"


@pytest.mark.parametrize(
    "broken",
    ["<article><p>" + LONG, "<article><p>" + LONG + "<p", "<article><p>" + LONG + '<a href="x', "<article><p>" + LONG + "<!-- open",
     "<article><p>" + LONG + "<script>x", "</div></p></article><article><p>" + LONG, "<ARTICLE><P>" + LONG + "</ARTICLE>"],
)
def test_broken_markup(broken):
    assert main_text(broken) == LONG


def test_text_that_looks_like_markup():
    assert main_text("<article><p>1 < 2 and a<3, 3 > 2 &amp;lt; &unknown; &#x41;&#66;</p></article>") == "1 < 2 and a<3, 3 > 2 &lt; &unknown; AB"


def test_hostile_pages_take_linear_time():
    start = time.time()
    for text in ("<a " * 60000, "<a href='" * 40000, '<p a="' * 40000, "<!-" * 80000, "<" * 200000, "<div>" * 100000 + "x", "<div>x" * 50000, "<p>x" * 20000, "<li>x<ul>" * 20000, "&" * 200000):
        main_text(f"<article>{text}")
    assert time.time() - start < 15


def test_random_articles_come_back_whole():
    draw = random.Random(7)
    inline = [lambda t: f"<b>{t}</b>", lambda t: f"<i>{t}", lambda t: t, lambda t: f"<span class=x>{t}</span>", lambda t: f"{t}<!-- c -->"]
    for _ in range(200):
        texts = [" ".join(draw.choices(["the", "of", "a<b", "Häuser", "x&y", "und", "1", "“q”", "end."], k=draw.randint(1, 60))) for _ in range(draw.randint(1, 12))]
        inner = "".join(
            f"<{tag}>{draw.choice(inline)(html.escape(t).replace(' ', draw.choice([' ', chr(10), '  '])))}</{tag}>"
            for t, tag in zip(texts, draw.choices(["p", "div", "li", "h2", "blockquote"], k=len(texts)))
        )
        got = main_text(page(f"<nav><a href=/>the of and</a></nav><article>{inner}</article><footer>{LONG}</footer>"))
        assert got.split("\n\n") == texts


def test_rows_are_kept_one_by_one(spark):
    rows = [(1, "u", None, "a", 5), (2, "u", "", "b", 5), (None, None, page(f"<article><p>{LONG} Ωmega 😀</p></article>"), "c", 6), (1, "u", "<p>x", "d", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, extract_main_text(pages).collect()), key=str)
    text = f"{LONG} Ωmega 😀"
    assert got == sorted([(1, "u", "", 0), (2, "u", "", 0), (None, None, text, len(text)), (1, "u", "", 0)], key=str)
    assert extract_main_text(pages.limit(0)).collect() == []


def test_query(spark):
    got = QUERIES["op12_block_rules"](spark, "/root/testdata/sf0.001").limit(5)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.filter("n_chars <> char_length(text)").isEmpty()
