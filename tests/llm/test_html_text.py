import re

import pytest

from tablewright.llm.html_text import extract, main_text

LONG = "A long story about many things, with punctuation. And more of it; much more."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("  \n ", ""), ("a < b &amp; c &#8364;&nbsp; d", "a < b & c € d"),
    ("<nav><a href=x>Home</a></nav><article><h1>T</h1><p>One<p>Two <b>bo</b>ld<br>x</article><footer>f</footer>", "T\n\nOne\n\nTwo bold x"),
    (f"<header>Site</header><div id=main><p>{LONG}</p><p>Short.</p></div><form>Name <input></form>", f"{LONG}\n\nShort."),
    (f"<div class='side-bar sidebar'><p>{LONG}</p></div><article><p>x</article>", "x"),
    (f"<article><p>{LONG}</p><div class=comments><p>Nice, very nice!</p></div></article>", LONG),
    (f"<div class='cookie-notice'>We use cookies.</div><section><p>{LONG}</p></section>", LONG),
    ("<article><script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes</article>", "yes"),
    (f"<ul><li><a href=a>Home page</a><li><a href=b>About us</a></ul><div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
    ("<article><p title=\"a>b\">q</p><p>cut &am", "q\n\ncut &am"),
    ("<p>" * 2_000 + "deep", "deep"),
])
def test_page(page, text):
    assert main_text(page) == text


def test_rows(spark):
    rows = [(1, "u", "<p>one</p>", "x"), (1, "u", "<p>one</p>", "x"), (None, None, None, None), (3, "v", "<p>" + "long, text. " * 50_000, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.url, r.n_chars) for r in extract(pages).collect()), key=str)
    assert got == sorted([(0, None, 0), (1, "u", 3), (1, "u", 3), (3, "v", 12 * 50_000 - 1)], key=str)
    assert extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["article", "main"])
@pytest.mark.parametrize("before, blocks, tag", [
    (1, ["<h1><a href=t>A linked headline</a></h1>"], "{}"),
    (5, ["12 km"] * 10, "<table><tr><td>{}</table>"),
    (10, ["an item of 24 characters"] * 20, "<ul><li>{}</ul>"),
    (2, ["<a href=x>First</a>", "<a href=y>Second</a>"], "<ul><li>{}</ul>"),
])
def test_marked_part_is_kept_whole(part, before, blocks, tag):
    story = (LONG + " ") * 6
    page = f"<nav><a href=/>Home</a></nav><{part}>" + f"<p>{story}</p>" * before
    page += "".join(tag.format(b) for b in blocks) + f"<div class=share>Share</div></{part}><p>{LONG}</p>"
    plain = [re.sub("<[^>]*>", "", b) for b in blocks]
    assert main_text(page) == "\n\n".join([story.strip()] * before + plain)
