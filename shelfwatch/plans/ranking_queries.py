"""Queries of fetch outcomes, discovery, feeds and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import discovery as D
from ..operators import fetchlog as P
from ..operators import ranking as R
from ..sources import tables as S
from ..sources.html import html_elements
from .registry import columns, register
from .url_text import _param, _path, _resolve

_c = F.col
# Fetch outcomes.
_BLOCKED = """(coalesce(trim(mitigated) <> '', false) OR status IN (403, 429, 430, 503) OR status BETWEEN 520 AND 530 OR coalesce({body} ILIKE '%just a moment%', false) OR coalesce(lower(server) = 'cloudflare' AND {body} ILIKE '%ray id%', false))"""
_GOOD_BODY = "CASE WHEN status BETWEEN 200 AND 299 THEN body END"
columns("blocked_response", "fetch_log", ("page_id", "attempt"), {"blocked": (lambda: P.blocked_response(_c("status"), _c("body"), _c("server"), _c("mitigated")), _BLOCKED.format(body="body"))})
_OUT = f"CASE WHEN status BETWEEN 300 AND 399 THEN 'redirect' WHEN {_BLOCKED.format(body='(' + _GOOD_BODY + ')')} THEN 'blocked' WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status >= 500 THEN 'store_error' ELSE 'http_error' END"
register("fetch_outcome", ("fetch_log",), lambda f: P.fetch_outcome(f).select("page_id", "attempt", "outcome"), f"SELECT page_id, attempt, {_OUT} AS outcome FROM fetch_log")
register("best_attempt", ("fetch_log",), lambda f: P.best_attempt(f).select("page_id", "attempt", "outcome"),
         f"WITH o AS (SELECT page_id, attempt, {_OUT} AS outcome FROM fetch_log), w AS (SELECT p.page_id, p.outcome AS po, d.outcome AS do_ FROM (SELECT * FROM o WHERE attempt = 'proxy') p JOIN (SELECT * FROM o WHERE attempt = 'direct') d USING (page_id)) SELECT page_id, CASE WHEN po = 'blocked' AND do_ = 'ok' THEN 'direct' ELSE 'proxy' END AS attempt, CASE WHEN po = 'blocked' AND do_ = 'ok' THEN 'ok' ELSE po END AS outcome FROM w")
columns("definitive_failure", "fetch_log", ("page_id", "attempt"), {"final": (lambda: P.definitive_failure(_c("status")), "status BETWEEN 500 AND 599 OR status = 404")})
register("error_summary", ("fetch_log",), lambda f: P.error_summary(P.fetch_outcome(f).where("outcome <> 'ok'").select(_c("outcome").alias("code"))), f"SELECT code, count(*) AS n, 502 AS answered FROM (SELECT {_OUT} AS code FROM fetch_log) WHERE code <> 'ok' GROUP BY code")
register("scan_fetch_log", ("fetch_log",), lambda f: S.scan_fetch_log(f).select("page_id", "attempt", "body"), f"SELECT page_id, attempt, {_GOOD_BODY} AS body FROM fetch_log")
_PICK = """WITH k AS (SELECT *, CASE tier WHEN 'fetched_html' THEN 1 WHEN 'rendered_html' THEN 2 ELSE 3 END AS r FROM rank_tiers), m AS (SELECT listing_key, min(r) AS r, bool_or(has_sort_by) AS s, count(*) FILTER (WHERE tier = 'feed') AS f FROM k GROUP BY listing_key)"""
register("source_tier_pick", ("rank_tiers",), lambda t: P.source_tier_pick(t),
         _PICK + " SELECT k.listing_key, k.tier, k.rank, k.product_key, CASE WHEN k.tier = 'feed' THEN 'feed' WHEN m.f > 0 THEN 'both' ELSE 'html' END AS source_used, NOT (k.tier = 'feed' AND m.s) AS order_reliable FROM k JOIN m ON k.listing_key = m.listing_key AND k.r = m.r")
register("order_warning", ("rank_tiers",), lambda t: t.groupBy("listing_key").agg(F.max("has_sort_by").alias("s"), F.count_if(_c("tier") != "feed").alias("h"), F.count_if(_c("tier") == "feed").alias("f")).select("listing_key", P.order_warning(_c("s"), _c("h"), _c("f")).isNotNull().alias("warned")),
         "SELECT listing_key, bool_or(has_sort_by) AND count(*) FILTER (WHERE tier <> 'feed') = 0 AND count(*) FILTER (WHERE tier = 'feed') > 0 AS warned FROM rank_tiers GROUP BY listing_key")

# Feeds and documents.
_FEED_DOCS = lambda f: f.groupBy("listing_key", F.ceil(_c("position") / 50).cast("int").alias("page_no")).agg(F.sort_array(F.collect_list(F.struct("position", F.to_json(F.struct(_c("product_id").alias("id"), "handle", "title", _c("image_url").alias("image"))).alias("j")))).alias("x")).select("listing_key", "page_no", F.concat(F.lit('{"products":['), F.array_join(F.transform("x", lambda s: s["j"]), ","), F.lit("]}")).alias("body"))
register("scan_catalog_feed", ("feed_products",), lambda f: S.scan_catalog_feed(_FEED_DOCS(f), page_size=50), "SELECT listing_key, 'handle:' || handle AS product_key, position, handle, title, product_id, image_url FROM feed_products")
_P = "CASE WHEN doc % 2 = 0 THEN json_extract(json(body), '$.product') ELSE json(body) END"
_IMAGES = "CASE doc % 4 WHEN 0 THEN '//cdn/' || doc::VARCHAR || '.jpg|//cdn/a.jpg|//cdn/b.jpg' WHEN 1 THEN '//cdn/i.jpg|//cdn/j.jpg' WHEN 2 THEN '//cdn/u.jpg' ELSE '' END"
register("scan_product_json", ("product_docs",), lambda d: S.scan_product_json(d).select("doc", "product_id", "handle", "title", "description", "vendor", "product_type", "variants"),
         f"WITH p AS (SELECT doc, {_P} AS p FROM product_docs) SELECT doc, p->>'$.id' AS product_id, p->>'$.handle' AS handle, trim(p->>'$.title') AS title, coalesce(regexp_replace(p->>'$.body_html', '</?p>', '', 'g'), p->>'$.description') AS description, p->>'$.vendor' AS vendor, p->>'$.product_type' AS product_type, CAST(json_array_length(p, '$.variants') AS INT) AS variants FROM p")
register("product_images_from_json", ("product_docs",), lambda d: S.scan_product_json(d).select("doc", F.array_join("images", "|").alias("images")), f"SELECT doc, {_IMAGES} AS images FROM product_docs")
register("scan_sitemaps", ("sitemaps",), lambda d: S.scan_sitemaps(d), """
WITH l AS (SELECT sitemap_url, origin, trim(unnest(regexp_extract_all(body, '<loc>([^<]*)</loc>', 1))) AS loc FROM sitemaps), own AS (SELECT * FROM l WHERE starts_with(loc, origin || '/')), p AS (SELECT * FROM own WHERE loc LIKE '%/products/%')
SELECT origin, loc FROM p UNION SELECT n.origin, p.loc FROM own n JOIN p ON n.loc = p.sitemap_url WHERE n.loc LIKE '%sitemap_products%'""")
_EVENTS = lambda: F.concat(F.lit('[["page_viewed",{}],["collection_viewed",{"collection":{"productVariants":['), F.array_join(F.transform(F.sequence(F.lit(0), _c("p_partkey") % 3), lambda k: F.concat(F.lit('{"image":{"src":"//i/'), k.cast("string"), F.lit('.jpg"},"product":{"id":'), _c("p_partkey").cast("string"), F.lit(',"title":" '), _c("p_name"), F.lit('","url":"/products/v-'), _c("p_partkey").cast("string"), F.lit("-"), k.cast("string"), F.lit('"}}'))), ","), F.lit("]}}],[1]]"))
_PAYLOAD = lambda p: S.parse_collection_event_payload(p.select(_c("p_partkey").cast("long").alias("page_id"), _EVENTS().alias("payload")))
register("parse_collection_event_payload", ("part",), _PAYLOAD, "SELECT p_partkey::BIGINT AS page_id, CAST(k AS INT) AS pos, p_partkey::VARCHAR AS product_id, p_name AS title, '/products/v-' || p_partkey::VARCHAR || '-' || k::VARCHAR AS product_url, '//i/' || k::VARCHAR || '.jpg' AS image FROM part CROSS JOIN (VALUES (0), (1), (2)) AS v(k) WHERE k <= p_partkey % 3")

# Discovery.
_ANCHORS = lambda p: html_elements(p, ("a",)).select("page_id", "url", "ord", F.element_at("attrs", "href").alias("href"))
_HREF = r"""a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS raw, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS o FROM pages)"""
register("page_links", ("pages",), lambda p: D.page_links(_ANCHORS(p), 5).select("page_id", "link", "nth"),
         f"WITH {_HREF}, r AS (SELECT page_id, {_resolve('raw', 'url')} AS link, min(o) AS o FROM a GROUP BY 1, 2), k AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY o) AS nth FROM r WHERE link IS NOT NULL) SELECT page_id, link, CAST(nth AS INT) AS nth FROM k WHERE nth <= 5")
columns("is_collection", "full_urls", ("url_id",), {"collection": (lambda: D.is_collection(U.path(_c("url")), _c("url_id") % 3 == 0, _c("url_id") % 2 + 1), f"CASE WHEN url_id % 3 = 0 AND (({_path('url')}) ILIKE '%/products/%' OR NOT regexp_matches(({_path('url')}), '(?i)/(collections|category|categories|shop)(/|$)')) THEN false ELSE regexp_matches(({_path('url')}), '(?i)/(collections|category|categories|shop)(/|$)') OR url_id % 2 + 1 > 1 END")})
# Tiers: every third product is on a page, every second in the feed, all are in the shop's sitemap, with some of no feed.
_TIER = lambda f, keep: f.where(keep).select(_c("listing_key").alias("origin"), F.concat(F.lit("/products/"), "handle").alias("url"), _c("position").alias("ord"))
_SITEMAP = lambda p: p.select(F.concat(F.lit("store-"), (_c("p_partkey") % 20).cast("string")).alias("origin"), F.concat(F.lit("/products/"), F.regexp_replace(F.lower("p_name"), " ", "-"), F.lit("-"), _c("p_partkey").cast("string")).alias("url"), _c("p_partkey").alias("ord"))
_CANDS = lambda f, p: D.candidate_union(2000, html=_TIER(f, "position % 3 = 0"), feed=_TIER(f, "position % 2 = 0"), sitemap=_SITEMAP(p))
_CSQL = """t AS (SELECT listing_key AS origin, '/products/' || handle AS url, CASE WHEN position % 3 = 0 THEN 0 ELSE 1 END AS tier, position AS ord FROM feed_products WHERE position % 3 = 0 OR position % 2 = 0
  UNION ALL SELECT 'store-' || (p_partkey % 20)::VARCHAR, '/products/' || replace(lower(p_name), ' ', '-') || '-' || p_partkey::VARCHAR, 2, p_partkey FROM part),
u AS (SELECT origin, url, min((tier, ord)) AS m FROM t GROUP BY 1, 2), c AS (SELECT origin, url, CASE m[1] WHEN 0 THEN 'html' WHEN 1 THEN 'feed' ELSE 'sitemap' END AS source, row_number() OVER (PARTITION BY origin ORDER BY m, url) AS nth FROM u)"""
register("candidate_union", ("feed_products", "part"), _CANDS, f"WITH {_CSQL} SELECT origin, url, source, CAST(nth AS INT) AS nth FROM c WHERE nth <= 2000")
register("candidate_source_counts", ("feed_products", "part"), lambda f, s: D.candidate_source_counts(_CANDS(f, s)), f"WITH {_CSQL} SELECT origin, source, count(*) AS n FROM c WHERE nth <= 2000 GROUP BY origin, source")
register("collection_rollup", ("fetch_log",), lambda f: D.collection_rollup(P.fetch_outcome(f).select("server", (_c("outcome") == "ok").alias("success")), "server"), f"SELECT server, count(*) AS discovered, count(*) FILTER (WHERE o = 'ok') AS succeeded, count(*) FILTER (WHERE o <> 'ok') AS failed FROM (SELECT server, {_OUT} AS o FROM fetch_log) GROUP BY server")
# Each part links to the parts with twice and three times its key; the walk starts from all that no part links to.
_LINKS = lambda p: p.select(_c("p_partkey").cast("string").alias("source"), F.explode(F.array((_c("p_partkey") * 2).cast("string"), (_c("p_partkey") * 3).cast("string"))).alias("target"))
_SEEDS = lambda p: p.select(_c("p_partkey").cast("string").alias("url")).join(_LINKS(p).select(_c("target").alias("url")), "url", "left_anti")
register("crawl_frontier", ("part",), lambda p: D.crawl_frontier(_LINKS(p), _SEEDS(p), 20), """
WITH RECURSIVE l AS (SELECT p_partkey AS s, p_partkey * 2 AS t FROM part UNION ALL SELECT p_partkey, p_partkey * 3 FROM part),
r AS (SELECT p_partkey AS u, 0 AS n FROM part WHERE p_partkey NOT IN (SELECT t FROM l) UNION SELECT l.t, r.n + 1 FROM r JOIN l ON r.u = l.s WHERE r.n < 20)
SELECT CAST(u AS VARCHAR) AS url, CAST(min(n) AS INT) AS round FROM r GROUP BY u""")
# Pagination by page id: a list by its class, or a nav by its label; every second page has a rel=next link besides.
_PAGED = lambda p: p.withColumn("html", F.concat(F.when(_c("page_id") % 3 == 0, '<nav aria-label="Pagination">').otherwise('<ul class="pagination">'), F.lit('<li><a href="?page=1">1</a><li><a href="?page=2">2</a><li><a href="?page=3">3</a></ul></nav>'), F.when(_c("page_id") % 2 == 0, F.lit('<link rel="next" href="?page=9">')).otherwise(""), "html"))
# The second pages of pages with a key divisible by 5 were visited before.
_VISITED = lambda p: p.where("page_id % 5 = 0").select(U.url_resolve(F.lit("?page=2"), _c("url")).alias("url"))
register("next_page_url", ("pages",), lambda p: D.next_page_url(html_elements(_PAGED(p), ("a", "link")), _VISITED(p)), f"""
WITH u AS (SELECT page_id, url, coalesce(try_cast({_param('url', 'page')} AS INT), 1) AS now, {_resolve("'?page=9'", 'url')} AS far FROM pages), r AS (SELECT *, {_resolve("'?page=' || (now + 1)::VARCHAR", 'url')} AS next FROM u),
v AS (SELECT {_resolve("'?page=2'", 'url')} AS seen FROM pages WHERE page_id % 5 = 0), k AS (SELECT *, now + 1 <= 3 AND next NOT IN (SELECT seen FROM v) AS free FROM r)
SELECT page_id, CASE WHEN free THEN next ELSE far END AS next_url FROM k WHERE free OR (page_id % 2 = 0 AND regexp_replace(far, '#.*$', '') <> regexp_replace(url, '#.*$', ''))""")

# Ranking.
# Seven shapes of listing pages, by part key; '#' stands for the key and '@' for the name.
_SHAPES = [
    # One grid, with furniture around it; a card in a list item without an end tag.
    '<nav><a href="/products/menu">Menu</a></nav><div class="upsell"><a href="/products/up">Up</a></div><div id="product-grid"><ul><li><a href="/products/a-#"><img src="/i.jpg" alt="Alt @"></a>'
    '<li class="card"><h3>Head @</h3><img data-src="/card.png"><a href="/products/b"></a></ul></div><a href="/about">About</a>',
    # No grid: links outside furniture; a link that is furniture by its own class.
    '<main><a class="site-nav__link" href="/products/nav-#">Nav</a><a href="/products/m-#" title="Own @">x</a><a href="/pages/faq">Faq</a></main><footer><a href="/products/foot">Foot</a></footer>',
    # Two grids: the one with more products counts, repeats don't.
    '<div class="products-grid"><a href="/products/s-1">S</a><a href="/products/s-1?v=2">S</a><a href="/products/s-2">S</a></div>'
    '<section data-section-type="main-collection-x"><article class="x"><h2>Big @</h2><a href="/products/l-1"><img srcset="/l1.jpg 1x, /l2.jpg 2x"></a></article><a href="/products/l-2" aria-label="L2 @"></a><a href="/products/l-x#">L3</a></section>',
    # Furniture only: all links stay.
    '<header><a href="/products/h-#">Head</a></header><nav><a href="/products/n">Nav</a></nav>',
    # Links that are their own cards.
    '<div id="CollectionAjaxContent"><a class="product-card" href="/products/c-#"><h3>Card @</h3><img src="/c.jpg"></a><a class="card" data-product-title="Data @" href="/products/d-#"><img alt="Seen" src="/d.jpg"></a></div>',
    # Drawers: one that filters stays, a cart's doesn't.
    '<div class="collection--filters-drawer"><a href="/products/f-#">Filter</a></div><div class="Cart-Drawer"><a href="/products/cart">Cart</a></div><div data-product-id="7"><span class="item-title">Span @</span><a href="/products/g-#"></a></div>',
    # A grid of one product is none.
    '<div class="collection-grid"><a href="/products/o-#">One</a></div><div class="frequently-bought"><a href="/products/also">Also</a></div><p><a href="/products/p-#">P</a></p>',
]
#: What the shapes hold, in order: shape, link, title, image, whether it lies outside furniture, whether it is chosen.
_LINKED = """(VALUES (0, '/products/menu', 'Menu', NULL, false, false), (0, '/products/up', 'Up', NULL, false, false), (0, '/products/a-#', 'Alt @', '/i.jpg', true, true), (0, '/products/b', 'Head @', '/card.png', true, true),
  (0, '/about', 'About', NULL, true, false), (1, '/products/nav-#', 'Nav', NULL, false, false), (1, '/products/m-#', 'Own @', NULL, true, true), (1, '/pages/faq', 'Faq', NULL, true, true), (1, '/products/foot', 'Foot', NULL, false, false),
  (2, '/products/s-1', 'S', NULL, true, false), (2, '/products/s-1?v=2', 'S', NULL, true, false), (2, '/products/s-2', 'S', NULL, true, false), (2, '/products/l-1', 'Big @', '/l1.jpg', true, true),
  (2, '/products/l-2', 'L2 @', NULL, true, true), (2, '/products/l-x#', 'L3', NULL, true, true), (3, '/products/h-#', 'Head', NULL, false, true), (3, '/products/n', 'Nav', NULL, false, true),
  (4, '/products/c-#', 'Card @', '/c.jpg', true, true), (4, '/products/d-#', 'Data @', '/d.jpg', true, true), (5, '/products/f-#', 'Filter', NULL, true, true), (5, '/products/cart', 'Cart', NULL, false, false),
  (5, '/products/g-#', 'Span @', NULL, true, true), (6, '/products/o-#', 'One', NULL, true, true), (6, '/products/also', 'Also', NULL, false, false), (6, '/products/p-#', 'P', NULL, true, true)) AS v(shape, href, title, image, plain, chosen)"""
_EXPECTED = f"SELECT p_partkey::BIGINT AS page_id, replace(replace({{}}, '#', p_partkey::VARCHAR), '@', p_name) AS {{}} FROM part JOIN {_LINKED} ON p_partkey % 7 = shape"
_shaped = lambda: F.element_at(F.array(*map(F.lit, _SHAPES)), (_c("p_partkey") % 7 + 1).cast("int"))
_GRID = lambda p: p.select(_c("p_partkey").cast("long").alias("page_id"), F.lit("https://shop.example.com/collections/all").alias("url"), F.replace(F.replace(_shaped(), F.lit("#"), _c("p_partkey").cast("string")), F.lit("@"), _c("p_name")).alias("html"))
_href = lambda d: d.select("page_id", F.element_at("attrs", "href").alias("href"))
register("grid_anchor_select", ("part",), lambda p: _href(R.grid_anchor_select(html_elements(_GRID(p), ("a",), ("grid",)))), _EXPECTED.format("href", "href") + " WHERE chosen")
register("drop_chrome_links", ("part",), lambda p: _href(R.drop_chrome_links(html_elements(_GRID(p), ("a",)))), _EXPECTED.format("href", "href") + " WHERE plain")
_CARDS = lambda p: R.card_fields(html_elements(_GRID(p), ("a", "img"), ("card", "heading", "product title")))
register("card_title", ("part",), lambda p: _CARDS(p).select("page_id", "title"), _EXPECTED.format("title", "title"))
register("card_image", ("part",), lambda p: _CARDS(p).select("page_id", "image_url"), _EXPECTED.format("'https://shop.example.com' || image", "image_url"))
_TITLES = lambda p: p.select("p_partkey", F.concat("p_name", F.when(_c("p_partkey") % 3 == 0, " - Handy Shop").when(_c("p_partkey") % 3 == 1, " | handy shop ").otherwise(" - Black")).alias("title"))
_TSQL = "t AS (SELECT p_partkey, p_name, p_name || CASE p_partkey % 3 WHEN 0 THEN ' - Handy Shop' WHEN 1 THEN ' | handy shop ' ELSE ' - Black' END AS title FROM part)"
register("site_name", ("part",), lambda p: _TITLES(p).select("p_partkey", R.site_name(F.when(_c("p_partkey") % 5 == 0, " Og  Name "), _c("title")).alias("site")), f"WITH {_TSQL} SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Og Name' ELSE CASE p_partkey % 3 WHEN 0 THEN 'Handy Shop' WHEN 1 THEN 'handy shop' ELSE 'Black' END END AS site FROM t")
register("strip_site_suffix", ("part",), lambda p: _TITLES(p).select("p_partkey", R.strip_site_suffix(_c("title"), F.lit("Handy Shop")).alias("title")), f"WITH {_TSQL} SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_name ELSE title END AS title FROM t")
_HANDLES = lambda u: u.select("url_id", U.product_identity(U.product_url_normalize(_c("raw"), _c("base")))["handle"].alias("handle"))
register("junk_product_filter", ("shop_urls",), lambda u: _HANDLES(u).select("url_id", R.junk_product_filter(_c("handle")).alias("junk")), "SELECT url_id, url_id < 1000000 AND url_id % 16 IN (8, 9) AS junk FROM shop_urls")
# A listing is a supplier's month of line items; pages of ten; the same part may come again.


def _LINES(lines):
    text = lambda c: c.cast("string")
    part = text(_c("l_partkey") % 40)
    return lines.select(
        F.concat(text(_c("l_suppkey")), F.lit(":"), F.substring(text(_c("l_shipdate")), 1, 4)).alias("listing_key"),
        F.floor(_c("l_orderkey") / 200).cast("int").alias("page_no"),
        (_c("l_orderkey") * 8 + _c("l_linenumber")).alias("ord"),
        F.concat(F.lit("handle:p-"), part).alias("product_key"),
        F.concat(F.when(_c("l_partkey") % 40 == 7, "order-insurance").otherwise("p-"), part).alias("handle"),
        F.when(_c("l_quantity") > 25, F.concat(F.lit("T"), text(_c("l_quantity").cast("int")))).alias("title"),
        F.when(_c("l_linenumber") % 2 == 0, F.concat(F.lit("/i"), text(_c("l_linenumber")))).alias("image_url"),
    )


_LSQL = """l AS (
  SELECT l_suppkey::VARCHAR || ':' || substr(l_shipdate::VARCHAR, 1, 4) AS listing_key, CAST(floor(l_orderkey / 200) AS INT) AS page_no, l_orderkey * 8 + l_linenumber AS ord,
         'handle:p-' || (l_partkey % 40)::VARCHAR AS product_key, CASE WHEN l_partkey % 40 = 7 THEN 'order-insurance' ELSE 'p-' END || (l_partkey % 40)::VARCHAR AS handle,
         CASE WHEN l_quantity > 25 THEN 'T' || l_quantity::INT::VARCHAR END AS title, CASE WHEN l_linenumber % 2 = 0 THEN '/i' || l_linenumber::VARCHAR END AS image_url
  FROM lineitem)"""
register("rank_assign", ("lineitem",), lambda l: R.rank_assign(_LINES(l), 12), f"""WITH {_LSQL}, f AS (SELECT listing_key, product_key, min(ord) AS o FROM l GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY listing_key ORDER BY o, product_key) AS rank FROM f), k AS (SELECT * FROM r WHERE rank <= 12), e AS (SELECT listing_key, o AS last FROM k WHERE rank = 12),
s AS (SELECT l.* FROM l LEFT JOIN e USING (listing_key) WHERE last IS NULL OR ord <= last)
SELECT k.listing_key, k.product_key, CAST(k.rank AS INT) AS rank, arg_min(s.handle, s.ord) AS handle, arg_min(s.title, s.ord) FILTER (WHERE s.title IS NOT NULL) AS title, arg_min(s.image_url, s.ord) FILTER (WHERE s.image_url IS NOT NULL) AS image_url FROM k JOIN s ON k.listing_key = s.listing_key AND k.product_key = s.product_key GROUP BY k.listing_key, k.product_key, k.rank""")
register("barren_page_stop", ("lineitem",), lambda l: R.barren_page_stop(_LINES(l)).select("listing_key", "page_no", "ord"), f"""
WITH {_LSQL}, f AS (SELECT listing_key, product_key, min(page_no) AS page_no FROM l GROUP BY 1, 2),
b AS (SELECT listing_key, min(page_no) AS stop FROM (SELECT DISTINCT listing_key, page_no FROM l) WHERE (listing_key, page_no) NOT IN (SELECT (listing_key, page_no) FROM f) GROUP BY 1)
SELECT l.listing_key, l.page_no, l.ord FROM l LEFT JOIN b USING (listing_key) WHERE stop IS NULL OR page_no <= stop""")
# Every second part's payload belongs to a listing that has no ranked items.
_FROM_PAYLOAD = lambda p: _PAYLOAD(p).join(p.select(_c("p_partkey").cast("long").alias("page_id"), "p_brand"), "page_id").select(
    F.when(_c("page_id") % 2 == 0, _c("p_brand")).otherwise(F.concat("p_brand", F.lit(" new"))).alias("listing_key"), (_c("pos") + 1).alias("rank"), F.concat(F.lit("v"), "product_id").alias("product_key"))
register("payload_rank_fallback", ("rank_items", "part"), lambda i, p: R.payload_rank_fallback(i.select("listing_key", "rank", "product_key"), _FROM_PAYLOAD(p)), """
WITH i AS (SELECT listing_key, rank, product_key FROM rank_items),
p AS (SELECT p_brand || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' new' END AS listing_key, CAST(k + 1 AS INT) AS rank, 'v' || p_partkey::VARCHAR AS product_key FROM part CROSS JOIN (VALUES (0), (1), (2)) AS v(k) WHERE k <= p_partkey % 3)
SELECT * FROM i UNION ALL SELECT * FROM p WHERE listing_key NOT IN (SELECT listing_key FROM i)""")
register("feed_rank", ("feed_products",), lambda f: R.feed_rank(f, 30).select("listing_key", "handle", "rank", "title_seo"), "SELECT listing_key, handle, CAST(rank AS INT) AS rank, title AS title_seo FROM (SELECT *, row_number() OVER (PARTITION BY listing_key ORDER BY position) AS rank FROM feed_products) WHERE rank <= 30")
_ITEMS = "SELECT snapshot_id, rank, product_key, handle, CASE WHEN rank % 2 = 0 THEN title END AS title, CASE WHEN rank % 4 = 0 THEN title_seo END AS title_seo, image_url, CASE WHEN rank % 3 = 0 THEN product_id END AS product_id, source, url FROM rank_items"
_items = lambda i: i.select("snapshot_id", "rank", "product_key", "handle", F.when(_c("rank") % 2 == 0, _c("title")).alias("title"), F.when(_c("rank") % 4 == 0, _c("title_seo")).alias("title_seo"), "image_url", F.when(_c("rank") % 3 == 0, _c("product_id")).alias("product_id"), "source", "url")
register("enrich_from_feed", ("rank_items", "feed_products"), lambda i, f: R.enrich_from_feed(_items(i), f).drop("url"), f"""
WITH i AS ({_ITEMS})
SELECT i.snapshot_id, i.rank, i.product_key, i.handle, coalesce(f.title, i.title) AS title, coalesce(i.title_seo, f.title, i.title) AS title_seo,
       coalesce(i.image_url, f.image_url) AS image_url, coalesce(f.product_id, i.product_id) AS product_id, CASE WHEN f.handle IS NOT NULL THEN 'both' ELSE i.source END AS source
FROM i LEFT JOIN feed_products f ON lower(i.handle) = lower(f.handle)""")
register("enrich_seo_title", ("rank_items",), lambda i: R.enrich_seo_title(_items(i), i.where("rank < 4").select("url", F.concat(F.lit("Page "), "title").alias("page_title"))).select("snapshot_id", "rank", "title_seo", "enriched"),
         f"WITH i AS ({_ITEMS}), t AS (SELECT url, max('Page ' || title) AS t FROM rank_items WHERE rank < 4 GROUP BY url) SELECT i.snapshot_id, i.rank, coalesce(t.t, i.title_seo) AS title_seo, t.t IS NOT NULL AS enriched FROM i LEFT JOIN t USING (url)")
