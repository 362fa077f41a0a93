"""Pages that are made to stop a parser, and the rules of the element table."""

import time

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import discovery, extract, media, ranking
from shelfwatch.sources.html import html_elements, page_elements
from shelfwatch.sources.markup import Scanner, attributes
from shelfwatch.sources.selectors import PAGE, SCOPE_NAMES, Selectors

ALL = frozenset("a b i p div span img h1 script title li ul".split())


@pytest.mark.parametrize("page", [
    "<b>" * 100_000 + "x", "<p>" + "</i>" * 100_000, "<a " + '"' * 1_000, '<a "' * 100_000, "<" * 100_000, "<!" * 100_000, '<a b="' * 50_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000,
    "<div>" * 50_000 + "</div>" * 50_000, "<!-- " * 50_000, "<script>" * 50_000, "<title>" + "<a" * 50_000, "&" * 100_000,
], ids=range(13))
def test_linear_time(page):
    began = time.process_time()
    page_elements(page, frozenset({"h1"}))
    assert time.process_time() - began < 4


def test_depth_is_bounded_and_text_is_whole():
    rows, said = page_elements("<div>" * 2000 + "x<h1>deep</h1>" + "</div>" * 2000 + "<h1>after</h1>", frozenset({"h1", "div"}))
    assert [said[r["start"] : r["start"] + r["length"]] for r in rows if r["tag"] == "h1"] == [b"deep", b"after"]
    assert [r["parent"] for r in rows][:4] == [None, 0, 1, 2] and rows[-2]["parent"] == rows[1999]["parent"] == 511 and rows[-1]["parent"] is None
    assert rows[0]["last"] == 2000 and rows[600]["last"] == 600


def test_elements_know_their_place(spark):
    page = '<ul id=u><li class="x">One &amp; <b>zwei ü</b><li>Three</ul><script type="application/ld+json">{"a": "<b>"}</script><p title="a > b">y<p>z'
    rows = found(spark, page, tuple(ALL)).orderBy("ord").collect()
    assert [(r.tag, r.text) for r in rows] == [("ul", "One & zwei üThree"), ("li", "One & zwei ü"), ("b", "zwei ü"), ("li", "Three"), ("script", '{"a": "<b>"}'), ("p", "y"), ("p", "z")]
    assert [(r.parent, r.last) for r in rows] == [(None, 3), (0, 2), (1, 2), (0, 3), (None, 4), (None, 5), (None, 6)]
    assert [(r.next_text, r.parent_text) for r in rows[1:4]] == [("Three", "One & zwei üThree"), (None, "One & zwei ü"), (None, "One & zwei üThree")]
    assert rows[0].attrs == {"id": "u"} and rows[5].attrs == {"title": "a > b"}


def test_the_table_grows_with_the_page(spark):
    pages = {"nested": "<div class='product-grid card main-title'>text " * 4000, "flat": "<div class=x>word</div>" * 20_000, "deep lists": "<ul><li>" * 3000 + "y"}
    for page in pages.values():
        rows, said = page_elements(page, frozenset({"div", "ul", "li"}), PAGE.mask(*PAGE.bit))
        assert len(said) <= len(page) and len(rows) <= page.count("<") and all(len(r) == 14 and len(r["near"]) == 1 for r in rows)
    assert found(spark, pages["nested"], ("div",)).where("ord = 3999").first().text == "text "


def test_selectors_equal_their_meaning(spark):
    own = Selectors({"tag": "b", "id": "#i", "cls": ".c", "has": "[x]", "is": "[x=v]", "part": "[x*=v i]", "starts": "[x^='a b']", "ends": '[x$="z"]', "word": "[x~=w]", "not": "b:not(.c):not([x])", "below": "div .c b", "any": "ul, [y=', '] i"}, nearest=("below", "cls"))
    page = '<div id=i><p class="b c d"><b x="a b">1</b><i><b class=c x="V">2</b></i></p><b>3</b></div><p class=c><b x="w z">4</b></p><ul><li y=", "><i>5</i></ul><b class="cc">6</b>'
    rows = {r.ord: r for r in html_elements(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), ("div", "p", "b", "i", "ul", "li"), selectors=own).collect()}
    marks = lambda k: {n for n, bit in own.bit.items() if rows[k].marks & bit}
    assert [rows[k].tag for k in range(12)] == ["div", "p", "b", "i", "b", "b", "p", "b", "ul", "li", "i", "b"]
    assert [marks(k) for k in range(12)] == [{"id"}, {"cls"}, {"tag", "has", "starts", "below"}, set(), {"tag", "cls", "has", "part", "below"}, {"tag", "not"}, {"cls"}, {"tag", "has", "ends", "word"}, {"any"}, set(), {"any"}, {"tag", "not"}]
    assert {n for n, bit in own.bit.items() if rows[4].inside & bit} == {"id", "cls", "tag", "has", "part", "below"} and rows[4].near == [4, 4] and rows[2].near == [2, 1] and rows[5].near == [None, None]
    for text in ("a > b", "a + b", ":hover", "[x", "b:not(.c.d)"):
        with pytest.raises(ValueError):
            Selectors({"x": text})


def test_scanner_gives_back_the_page():
    page = "a<b c='1' D=\"2>3\" e>f</b><!-- x --><br/>1 < 2 <script>if (a<b) {}</script>tail"
    assert [(t, tag, end) for t, tag, end, _, _ in Scanner(page, frozenset({"script"}))] == [("a", "b", False), ("f", "b", True), ("", "", False), ("", "br", False), ("1 < 2 ", "script", False), ("tail", "", False)]
    assert attributes(" c='1' D=\"2>3\" e c=9 f='&lt;'") == {"c": "1", "d": "2>3", "e": "", "f": "<"}


def test_deep_json_is_skipped_and_wide_graphs_are_not(spark):
    deep = "[" * 5000 + "]" * 5000
    wide = '{"@graph": [' + ",".join('{"@type": "Thing"}' for _ in range(3)) + '], "name": "g"}'
    nested = '[[{"@graph": [{"@graph": [{"n": 1}], "n": 2}], "n": 3}], {"n": 4}]'
    page = "".join(f'<script type="application/ld+json">{x}</script>' for x in (deep, wide, nested))
    nodes = extract.jsonld_nodes(html_elements(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), ("script",)))
    names = [r.n for r in nodes.orderBy("pos").select(F.coalesce(F.get_json_object("node", "$.n"), F.get_json_object("node", "$.name"), F.get_json_object("node", "$['@type']")).alias("n")).collect()]
    assert names == ["Thing", "Thing", "Thing", "g", "1", "2", "3", "4"]


def found(spark, page, tags, marked=()):
    return html_elements(spark.createDataFrame([(1, "https://s.example.com/x", page)], "page_id long, url string, html string"), tags, marked)


def test_the_element_itself_counts(spark):
    hrefs = lambda d: [r.h for r in d.select(F.element_at("attrs", "href").alias("h")).collect()]
    assert hrefs(ranking.drop_chrome_links(found(spark, '<a class="site-nav__link" href="/n"></a><a class="card" href="/c"></a>', ("a",)))) == ["/c"]
    images = found(spark, '<img class="review-photo" src="/r"><img src="/p">', ("img",)).where(~media.excluded_section())
    assert [r.s for r in images.select(F.element_at("attrs", "src").alias("s")).collect()] == ["/p"]


def test_articles_are_scopes_in_main_only(spark):
    scope = lambda page: [r.scope for r in media.product_scope(found(spark, page, (), SCOPE_NAMES)).collect()]
    assert scope("<article><img></article>") == []
    assert scope("<main><p><article><img></article><img></main>") == [2]
    assert scope("<div role=main><article><img></article></div>") == [1]
    assert scope("<main><img></main><div id=product-media><img></div>") == [2]
    assert scope("<main><img></main><div id=product-media></div>") == [2]  # an empty container counts
    assert scope("<main></main><p itemtype='http://schema.org/Product'></p>") == [1] and scope("<p itemtype='schema.org/PRODUCT'><img></p>") == []


def test_images_lie_inside_their_scope(spark):
    images = lambda page: [(r.tier, r.raw) for r in media.dom_images(found(spark, page, media.IMAGE_TAGS, media.IMAGE_LISTS)).orderBy("tier", "ord", "at").collect()]
    assert images('<div class="product-gallery"></div><main><img src="/m"></main><link rel=preload as=image href="/p">') == [(5, "/p")]
    assert images('<img class="product-images" src="/self"><p><img src="/other"></p>') == []
    assert images("""<p style="background: url('/a(1).jpg') no-repeat"><section style='background-image:url("/b;c")'></section><i style="background:url(/d)"></i><b style="color: red; BACKGROUND: #fff url( /e )"></b>""") == [(4, "/a(1).jpg"), (4, "/b;c"), (4, "/d")]  # the selector minds case
    assert images('<picture><p><source srcset="/s 1x"></p></picture><source srcset="/t 1x"><nav><picture><source srcset="/u"></picture></nav>') == [(3, "/s")]


def test_cards_of_any_element(spark):
    lists = ("card", "heading", "product title")
    titles = lambda page: [(r.title, r.image_url) for r in ranking.card_fields(found(spark, page, ("a", "img"), lists)).orderBy("ord").collect()]
    img = "https://s.example.com/i"
    assert titles('<li><a href="/x"><img src="/i"></a><a class="card__title">Blue Hat</a></li>') == [("Blue Hat", img), ("Blue Hat", None)]  # the second link is its own card
    assert titles('<article><p class="productName"> P  name </p><a href="/x">said</a></article><div class="name">outside</div>') == [("P name", None)]
    assert titles('<div class="grid-product__content"><strong class="Title"></strong><h2>second</h2><a href="/x">own text</a></div>') == [("own text", None)]
    assert titles('<div class="grid-productive"><h2>no card</h2><a href="/x">own</a></div>') == [("own", None)]
    assert titles('<div data-product-id=1><li><a href="/x">in</a></li><em data-product-title="Data"></em><h3>Head</h3></div>') == [("in", None)]  # the closest card is the list item
    assert titles('<div data-product-id=1><a href="/x">in</a><em data-product-title="Data"></em><h3>Head</h3></div>') == [("Data", None)]
    assert titles('<a class="card" href="/x"><h4>Own head</h4></a><h4>next</h4>') == [("Own head", None)]


def test_nested_grids(spark):
    page = '<div class="product-grid-wrap"><a href="/products/a"></a><div id="product-grid"><a href="/products/b"></a><a href="/products/c"></a><nav><a href="/products/d"></a></nav></div></div><div class="products-grid"><a href="/products/e"></a></div>'
    assert sorted(r.href for r in ranking.grid_anchor_select(found(spark, page, ("a",), ("grid",))).collect()) == ["/products/a", "/products/b", "/products/c"]


def test_pagination_by_label_and_visited_pages(spark):
    page = '<nav aria-label="Pagination"><a href="?page=1">1</a><a href="?page=2">2</a></nav>'
    elements = found(spark, page, ("a", "link"))
    assert [r.next_url for r in discovery.next_page_url(elements).collect()] == ["https://s.example.com/x?page=2"]
    seen = spark.createDataFrame([("https://s.example.com/x?page=2",)], "url string")
    assert discovery.next_page_url(elements, seen).count() == 0


def test_quoted_attributes(spark):
    page = """<title>T</title><meta property='og:title' content="It's a men's hat"><meta property="og:title" content=""><meta content='Say "hi"' name=x><meta name="description" content="it's first"><meta name="description" content="second"><link href='/c?a=1' rel="canonical">"""
    row = extract.fetch_first_fields(spark.createDataFrame([(1, "https://s.example.com/x", page)], "page_id long, url string, html string")).first()
    assert (row.description.value, row.product_title.value, row.canonical_url.value) == ("it's first", "It's a men's hat", "https://s.example.com/c?a=1")


def test_a_crawl_of_twenty_rounds(spark):
    links = spark.createDataFrame([(str(k), str(k + 1)) for k in range(30)] + [("5", "0"), (None, "x"), ("3", None)], "source string, target string")
    seeds = spark.createDataFrame([("0",), ("0",), (None,)], "url string")
    got = {r.url: r["round"] for r in discovery.crawl_frontier(links, seeds, 20).collect()}
    assert got == {str(k): k for k in range(21)}
    assert discovery.crawl_frontier(links, seeds.limit(0), 3).count() == 0
