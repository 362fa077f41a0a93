import time

import pytest

from shelfwatch.llm import htmltext


def cut(page):
    """(protected, open) blocks."""
    found = htmltext.blocks(page)
    sure = htmltext.main_blocks(found)
    return sure, [] if sure else [w for kind, w in found if kind == htmltext.OPEN]


@pytest.mark.parametrize("name", ["layout has-sidebar", "search-page", "no-banner", "widget-area"])
def test_articles_reopen_layout_wrappers(name):
    assert cut(f"<div class='{name}'>menu<main><article><p>Text</p></article></main></div>") == (["Text"], [])
    assert cut(f"<main class='{name}'><article>Text</article></main>") == (["Text"], [])
    for tag in ("nav", "footer", "aside", "div class='comments'", "div class='related'"):
        assert cut(f"<div class='{name}'><{tag}><article>Out</article></{tag.split()[0]}></div>") == ([], [])
    assert cut(f"<article>Text</article><div class='{name}'><article>Card</article></div>") == (["Text"], [])


def test_a_less_than_sign_is_text():
    assert cut("<p>if a < b then c") == ([], ["if a < b then c"])
    assert cut("<p>cut <a href='x") == ([], ["cut"])
    assert cut("a < b and cut </p") == ([], ["a < b and cut"])


def test_an_articles_own_class_may_hold_layout_words():
    assert cut("<article class='post share notice'><p>Text</p></article>") == (["Text"], [])
    assert cut("<div class='page notice'><article class='share'>Text</article></div>") == (["Text"], [])
    assert cut("<article class='comment'>Nice</article><article class='teaser'>More</article>") == ([], [])


def test_quotes_and_raw_elements():
    assert cut("<p title='a > b'>x</p><a href=\"q?x='1>2'\">y</a>") == ([], ["x", "y"])
    assert cut("<p a\"\"\" b>x</p><p c='never closed>y</p><p>z</p>") == ([], ["x", "y", "z"])
    assert cut("<p>a<script>if (1 < 2) '</p>'</SCRIPT >b<!-- > -->c<![CDATA[d]]>e<span class=ad>x</span> f") == ([], ["abce", "f"])


@pytest.mark.parametrize("page", [
    "<b>" * 100_000 + "x", "<p>" + "</i>" * 100_000 + "x", "<a " + '"' * 1_000 + "x", '<a "' * 100_000, "<" * 100_000, "<!" * 100_000, "<a b=\"" * 50_000,
    "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<b>" * 50_000 + "<div></div>" * 50_000, "<div>" * 100_000 + "x" + "</div>" * 100_000, '<a b=">" ' * 50_000 + "c='", "<!-- " * 50_000,
], ids=range(12))
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    htmltext.blocks(page)
    assert time.process_time() - began < 3


@pytest.mark.parametrize("name", ["share-price", "related-work", "ad-hoc", "search-results-2024-x", "menu-du-jour", "social-history", "comment-ary", "footer-note-x"])
def test_names_inside_an_article_count_whole(name):
    assert cut(f"<article><p>Text</p><div class='x {name}'>matter</div></article>") == (["Text", "matter"], [])
    assert cut(f"<article><p>Text</p><p id='{name}'>matter</p></article>") == (["Text", "matter"], [])


@pytest.mark.parametrize("name", ["share", "related-posts", "ad-slot-2", "share_buttons", "newsletter form", "comments-list", "sidebar-right", "social-share-links"])
def test_boilerplate_inside_an_article_goes(name):
    assert cut(f"<article><p>Text</p><div class='{name}'>gone</div><p>End</p></article>") == (["Text", "End"], [])
