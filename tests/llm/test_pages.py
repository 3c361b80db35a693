from __future__ import annotations

import re

import pytest

from aphora.llm import pages
from aphora.llm.pages import Page

NONE = frozenset()


def text(source):
    return Page(source).text(NONE, NONE)


@pytest.mark.parametrize("source,want", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("a < b <p>c", "a < b\n\nc"),
    ("<p>one<p>two <b>bold</b>\n text<br>next</p>three", "one\n\ntwo bold text next\n\nthree"),
    ("<script>var t='</p>';</script><p>x</p><style>p{}</style>", "x"),
    ("<nav>menu</nav><article><h1>Title</h1><p>Body&nbsp;text &#8211; &eacute;</p><aside>side</aside></article><footer>f</footer>", "Title\n\nBody text – é"),
    ("<body><div class='main-content'>kept</div><div class=\"ad\">no</div><div id=comments><p>hi</p></div></body>", "kept"),
    ("<article><p><b>Bold title.<br><p>Second.</p><p>Third</article>after", "Bold title.\n\nSecond.\n\nThird"),
    ("<ul><li>one<li>two<ul><li>deep</li></ul></ul>", "one\n\ntwo\n\ndeep"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    ("<div>before<div>inner</div>after</div>", "before\n\ninner\n\nafter"),
    ("<p title=\"a > b\">x</p><!-- <p>no</p> --><p>y</p>", "x\n\ny"), ("<p>open <em>end", "open end"), ("</p></div>x", "x"), ("<", "<"), ("<p", "<p"),
    ("<header>site</header><main><p>m</p><form>f</form></main>", "m"), ("<div hidden>x</div><p style='display: none'>y</p><p>z</p>", "z"),
    ("<div class=header>h</div><p class=lead>address</p>", "address"), ("<p>a</p> <p>b</p>", "a\n\nb"), ("x<hr>y", "x\n\ny"),
])
def test_text(source, want):
    assert text(source) == want


def test_long_and_deep_pages():
    assert text("<div>" * 20_000 + "x") == "x"
    assert text("<p>" + "w " * 200_000) == ("w " * 200_000).strip()
    assert text("<p a='" + "x" * 100_000) != None  # noqa: E711


def site(n=40):
    rows = []
    for i in range(n):
        menu = "<div><ul><li>Home</li><li>About us</li></ul></div>"
        own = f"<div><p>Own text {i} of the page.</p><p>{'Shared paragraph.' if i % 10 == 0 else f'Another {i}.'}</p></div>"
        rows.append((i, f"https://A.example.org:80/p/{i}", f"<html><body>{menu}<div>{own}</div><div><span>All rights reserved</span></div></body></html>"))
    for i in range(n, 2 * n):
        note = "<div><p>Please read our terms.</p></div>"
        rows.append((i, f"http://b.example.org/{i}", f"<article><h1>T{i}</h1><p>Body {i}</p><p>{'Shared here.' if i % 3 == 0 else 'x'}</p>{note}</article><div>foot</div>"))
    return rows


@pytest.mark.parametrize("limit", [pages.BROADCAST_HASHES, 0])
def test_templates_go_and_own_text_stays(spark, monkeypatch, limit):
    monkeypatch.setattr(pages, "BROADCAST_HASHES", limit)
    frame = spark.createDataFrame(site(), "page_id bigint, url string, html string").selectExpr("*", "'x' as host", "1 as row", "2 as known").repartition(4)
    got = {r["page_id"]: r for r in pages.main_text(frame).collect()}
    for i in range(40):
        # A paragraph on four of forty pages is template where no article marks the text.
        assert got[i]["text"] == f"Own text {i} of the page." + ("" if i % 10 == 0 else f"\n\nAnother {i}.")
    for i in range(40, 80):
        assert got[i]["text"].startswith(f"T{i}\n\nBody {i}") and "terms" not in got[i]["text"] and "foot" not in got[i]["text"]
        assert ("Shared here." in got[i]["text"]) == (i % 3 == 0)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_odd_rows(spark):
    schema = "page_id bigint, url string, html string"
    rows = [(1, None, None), (None, None, ""), (2, "not a url", "<p>x</p>"), (2, "not a url", "<p>x</p>"), (3, "http://h", "")]
    got = pages.main_text(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got.collect()) == [(0, "", 0), (1, "", 0), (2, "x", 1), (2, "x", 1), (3, "", 0)]
    assert pages.main_text(spark.createDataFrame([], schema)).collect() == []


def test_given_pages(spark):
    """Every paragraph of the article is there, and nothing of menu, advert or footer."""
    frame = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in pages.main_text(frame).collect()}
    for r in frame.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)
        if article:
            plain = " ".join(re.sub(r"<[^>]*>", " ", article[1]).split())
            from html import unescape

            assert " ".join(got[r["page_id"]].split()) == " ".join(unescape(plain).split())


@pytest.mark.parametrize("source,want", [
    ("<article>See <a href=\"/a/hidden-valley\">the valley</a>, <a href='/p?id=comments'>more</a>, <b data-id=menu>all</b>.</article>", "See the valley, more, all."),
    ("<article title=\"Hidden costs\" data-class='ad'><p>kept</p></article>", "kept"), ("<div hidden=until-found>x</div><p HIDDEN>y</p><p>z</p>", "z"),
    ("<div class='content no-sidebar'>kept</div><div class='sidebar-right'>no</div>", "kept"), ("<article class='post has-comments'>kept</article>", "kept"),
    ("<div class=layout-sidebar-right><article>kept</article></div>", "kept"), ("<div class=page-widget><main>kept</main></div><div class=menu-bar>no</div>", "kept"),
    ("<div class=banner-page><p>most of the text</p></div><div class=main-menu>no</div>", "most of the text"), ("<div class=widget>all</div>", "all"),
    ("<p>short</p><div id=comments>a long talk of readers</div>", "short"), ("<article>short</article><div class=comments-area><article>a long talk</article></div>", "short"),
])
def test_attributes_are_read_by_name(source, want):
    assert text(source) == want


def test_copies_and_near_copies_keep_their_text(spark):
    menu = "<div><ul><li>Home</li><li>About</li></ul></div>"
    rows = [(i, "http://a/", f"<html><body>{menu}<div><p>Own words of page {i} stand here.</p></div></body></html>") for i in range(60)]
    copy = f"<html><body>{menu}<div><p>This page was fetched</p><p>three times over.</p></div></body></html>"
    rows += [(100 + i, f"http://a/{i}", copy) for i in range(30)] + [(100, "http://a/0", copy)] * 3
    near = "<div><p>A text that the host shows</p><p>under several dates.</p></div>"
    rows += [(200 + i, f"http://a/n{i}", f"<html><body>{menu}{near}<p>Day {i}</p></body></html>") for i in range(3)]
    rows += [(300 + i, f"http://b/{i}", "<article><h1>T</h1><p>Whole article.</p></article>" if i < 30 else f"<article><p>Other {i}</p></article>") for i in range(50)]
    rows += [(400 + i, f"http://c/{i}", f"<p>{i}</p><article><h1>T</h1><p>Whole article.</p></article>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[7] == "Own words of page 7 stand here."
    assert all(got[100 + i] == "This page was fetched\n\nthree times over." for i in range(30))
    assert all(got[200 + i] == f"A text that the host shows\n\nunder several dates.\n\nDay {i}" for i in range(3))
    assert all(got[300 + i] == got[400 + i] == "T\n\nWhole article." for i in range(30))


def test_large_hosts_are_judged_by_pages_too(spark):
    """A menu on 120 of 13,000 pages is template."""
    found = [(False, 0, i) for i in range(13_000)] + [(False, 5, i) for i in range(120)] + [(False, 6, i) for i in range(90)] + [(False, 7, 1)] * 500
    frame = spark.createDataFrame([(i, "h", *r) for i, r in enumerate(found)], "row bigint, host string, inside boolean, hash bigint, around bigint")
    assert [(r["hash"], r["sure"]) for r in pages.templates(frame).collect()] == [(5, False)]


@pytest.mark.parametrize("name,kept", [
    ("cookie-recipe", True), ("related-work", True), ("share-prices", True), ("notice-period", True), ("menu-of-the-day", True), ("no-footer", True),
    ("main-menu", False), ("menu-bar", False), ("comments-area", False), ("sidebar-right", False), ("footer2", False), ("share", False), ("site_nav_links", False),
])
def test_names_count_by_what_the_element_is(name, kept):
    want = "Long enough a text.\n\nin question" if kept else "Long enough a text."
    assert text(f"<article><p>Long enough a text.</p><p class='{name}'>in question</p></article>") == want
    assert text(f"<div>Long enough a text.</div><div id='x' class='y {name}'>in question</div>") == want


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "<p>x" * 2000, "<ul>" + "<li>x" * 100_000, "<div>" * 50_000 + "<li>y" * 20_000, "<p>x</p>" * 100_000, "<b>" * 50_000 + "</i>" * 50_000])
def test_pages_are_read_in_linear_time(source):
    import time

    start = time.time()
    page = Page(source)
    page.hashes()
    page.text(NONE, NONE)
    assert time.time() - start < 10
