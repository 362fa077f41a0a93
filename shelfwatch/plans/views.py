"""Views over the driver's tables that give the operators realistic input.

Each view is one SQL text that Spark and DuckDB read alike; ``{name}`` stands for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()

VIEWS = {
    # A best-seller table: listing = brand, snapshot = month of shipping, rank by quantity.
    "sales": """
        SELECT p.p_brand AS listing_key, p.p_partkey AS partkey, p.p_name AS name, substr(CAST(l.l_shipdate AS STRING), 1, 7) AS ym, sum(l.l_quantity) AS quantity
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey GROUP BY 1, 2, 3, 4""",
    "rank_items": """
        SELECT listing_key, listing_key || ':' || ym AS snapshot_id, CAST(ym || '-01' AS TIMESTAMP) AS checked_at,
               CAST(row_number() OVER (PARTITION BY listing_key, ym ORDER BY quantity DESC, partkey) AS INT) AS rank,
               'handle:' || replace(lower(name), ' ', '-') || '-' || CAST(partkey AS STRING) AS product_key,
               replace(lower(name), ' ', '-') || '-' || CAST(partkey AS STRING) AS handle,
               'https://' || replace(lower(listing_key), '#', '-') || '.example.com/products/' || replace(lower(name), ' ', '-') || '-' || CAST(partkey AS STRING) AS url,
               name AS title, name || ' - ' || listing_key AS title_seo, CAST(partkey AS STRING) AS product_id,
               CASE WHEN partkey % 3 <> 0 THEN 'https://cdn.example.com/' || CAST(partkey AS STRING) || '.jpg' END AS image_url, 'html' AS source
        FROM {sales}""",
    "rank_snapshots": """
        SELECT snapshot_id, listing_key, replace(lower(listing_key), '#', '-') || '.example.com' AS store_domain, checked_at, CAST(count(*) AS INT) AS item_count,
               CASE WHEN max(rank) % 2 = 0 THEN 'html' ELSE 'both' END AS source_used
        FROM {rank_items} GROUP BY snapshot_id, listing_key, checked_at""",
    "feed_products": """
        SELECT 'store-' || CAST(p_partkey % 20 AS STRING) AS listing_key, replace(lower(p_name), ' ', '-') || '-' || CAST(p_partkey AS STRING) AS handle,
               p_name || ' (feed)' AS title, CAST(p_partkey AS STRING) AS product_id,
               CASE WHEN p_partkey % 4 <> 0 THEN 'https://cdn.example.com/feed/' || CAST(p_partkey AS STRING) || '.jpg' END AS image_url,
               CAST(row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey) AS INT) AS position
        FROM {part} WHERE p_partkey % 5 <> 0""",
    "product_docs": """
        SELECT p_partkey AS doc, 'https://store.example.com/products/p-' || CAST(p_partkey AS STRING) AS url,
               CASE WHEN p_partkey % 2 = 0 THEN '{"product":' ELSE '' END || '{"id":' || CAST(p_partkey AS STRING) || ',"handle":"p-' || CAST(p_partkey AS STRING) || '","title":" ' || p_name
               || ' ","vendor":"' || p_brand || '","product_type":"' || p_type || '",'
               || CASE WHEN p_partkey % 3 = 0 THEN '"body_html":"<p>Best ' || p_name || '</p>",' ELSE '"description":"Plain ' || p_name || '",' END
               || CASE p_partkey % 4 WHEN 0 THEN '"featured_image":"//cdn/' || CAST(p_partkey AS STRING) || '.jpg","images":["//cdn/a.jpg","//cdn/b.jpg"]'
                                     WHEN 1 THEN '"image":{"src":"//cdn/i.jpg"},"images":[{"src":"//cdn/i.jpg"},{"src":"//cdn/j.jpg"}]'
                                     WHEN 2 THEN '"images":[{"url":"//cdn/u.jpg"}]' ELSE '"images":[]' END
               || ',"variants":[{"id":1,"price":"' || CAST(p_size AS STRING) || '"},{"id":2,"price":"9"}]}' || CASE WHEN p_partkey % 2 = 0 THEN '}' ELSE '' END AS body
        FROM {part}""",
    "sitemaps": """
        SELECT p_partkey AS doc, 'https://s' || CAST(p_partkey % 7 AS STRING) || '.example.com' AS origin,
               'https://s' || CAST(p_partkey % 7 AS STRING) || '.example.com/' || CASE WHEN p_partkey % 10 = 0 THEN 'sitemap.xml' ELSE 'sitemap_products_' || CAST(p_partkey AS STRING) || '.xml' END AS sitemap_url,
               CASE WHEN p_partkey % 10 = 0
                    THEN '<sitemapindex><sitemap><loc>https://s' || CAST(p_partkey % 7 AS STRING) || '.example.com/sitemap_products_' || CAST(p_partkey + 7 AS STRING) || '.xml</loc></sitemap><sitemap><loc> https://s1.example.com/sitemap_pages_1.xml </loc></sitemap></sitemapindex>'
                    ELSE '<urlset><url><loc>https://s' || CAST(p_partkey % 7 AS STRING) || '.example.com/products/p-' || CAST(p_partkey AS STRING) || '</loc></url><url><loc>https://other.example.org/products/x</loc></url><url><loc>https://s'
                         || CAST(p_partkey % 7 AS STRING) || '.example.com/pages/about</loc></url></urlset>' END AS body
        FROM {part}""",
    "shop_urls": """
        SELECT p_partkey AS url_id, 'https://shop.example.com/en-us/collections/all?sort_by=best-selling&page=2' AS base,
               CASE p_partkey % 16
                 WHEN 0 THEN '/products/' || replace(lower(p_name), ' ', '-') || '-' || CAST(p_partkey AS STRING)
                 WHEN 1 THEN 'https://shop.example.com/collections/all/products/P-' || CAST(p_partkey AS STRING) || '?variant=1#reviews'
                 WHEN 2 THEN '/en-us/collections/summer/products/sun-' || CAST(p_partkey AS STRING)
                 WHEN 3 THEN '//shop.example.com/FR/products/chaise%C3%A9-' || CAST(p_partkey AS STRING) || '?utm_source=x&w=2&ref=y'
                 WHEN 4 THEN 'mailto:a@example.com' WHEN 5 THEN 'javascript:void(0)'
                 WHEN 6 THEN 'https://other.example.org/products/far-' || CAST(p_partkey AS STRING)
                 WHEN 7 THEN 'http://192.168.1.7/products/private' WHEN 8 THEN '/products/shipping-protection-' || CAST(p_partkey AS STRING)
                 WHEN 9 THEN '/products/gift-card' WHEN 10 THEN '/products/tip-toe-' || CAST(p_partkey AS STRING) WHEN 11 THEN '#top'
                 WHEN 12 THEN '?page=3&sort_by=price' WHEN 13 THEN 'p-' || CAST(p_partkey AS STRING)
                 WHEN 14 THEN 'https://www.shop.example.com/de/collections/Sale/?sort_by=title&utm_campaign=z' ELSE '/products/bad%ZZ+plus-' || CAST(p_partkey AS STRING) END AS raw
        FROM {part}
        UNION ALL
        SELECT 1000000 + p_partkey, 'https://shop.example.com/en-us/collections/all?sort_by=best-selling&page=2',
               CASE p_partkey % 12
                 WHEN 0 THEN '../../products/up-' || CAST(p_partkey AS STRING) WHEN 1 THEN './products/here-' || CAST(p_partkey AS STRING) || '/..'
                 WHEN 2 THEN '  /products/two words-' || CAST(p_partkey AS STRING) || '?q=a b ' WHEN 3 THEN '../../../../../products/top-' || CAST(p_partkey AS STRING)
                 WHEN 4 THEN 'https://shop.example.com/a/./b/../products/mid-' || CAST(p_partkey AS STRING) || '?from=/x/../y#/z/../w' WHEN 5 THEN '/products/.hidden..name-' || CAST(p_partkey AS STRING)
                 WHEN 6 THEN 'http://[::1]/products/loop' WHEN 7 THEN '//10.example.com/products/ten' WHEN 8 THEN 'http://10.0.0.' || CAST(p_partkey % 200 AS STRING) || ':8080/products/lan'
                 WHEN 9 THEN '..' WHEN 10 THEN '/a/b/./c/../../products/deep-' || CAST(p_partkey AS STRING) || '/' ELSE 'http://[fd00::7]:81/x/..' END
        FROM {part}""",
    "full_urls": """
        SELECT url_id, CASE WHEN url_id % 16 IN (1, 6, 7, 14) THEN raw WHEN url_id % 16 = 3 THEN 'https:' || raw WHEN url_id % 16 IN (0, 2, 8, 9, 10, 15) THEN 'https://shop.example.com' || raw ELSE base END AS url
        FROM {shop_urls} WHERE url_id < 1000000
        UNION ALL SELECT url_id, CASE WHEN url_id % 12 IN (2, 3) THEN 'https://user:pw@127.cdn.example.net/a' WHEN raw LIKE 'http%' THEN raw WHEN raw LIKE '//%' THEN 'https:' || raw ELSE base END FROM {shop_urls} WHERE url_id >= 1000000
        UNION ALL SELECT -1 - page_id, url FROM {pages}""",
    "redirects": """
        SELECT p_partkey AS redirect_id, 'https://shop.example.com/collections/hats?sort_by=best-selling' || CASE WHEN p_partkey % 3 = 0 THEN '&page=2' ELSE '' END AS requested,
               CASE p_partkey % 9 WHEN 0 THEN '/en-us/collections/hats' WHEN 1 THEN 'https://www.shop.example.com/collections/hats?sort_by=best-selling'
                 WHEN 2 THEN '/collections/caps?sort_by=best-selling' WHEN 3 THEN 'https://evil.example.org/collections/hats' WHEN 4 THEN '/collections/Hats/'
                 WHEN 5 THEN '/search?q=hats' WHEN 6 THEN '/collections/hats?sort_by=price&x=1' WHEN 7 THEN 'ftp://shop.example.com/collections/hats' ELSE '/collections/hats?sort_by=best-selling' END AS location
        FROM {part}""",
    # Pages with a head fragment behind <head>, a different one for each page_id modulo 8.
    "page_seo": """
        SELECT page_id, url, replace(html, '<head>', '<head>' || CASE page_id % 8
          WHEN 1 THEN '<meta property="og:title" content="OG ' || CAST(page_id AS STRING) || '"><meta property="og:description" content="About ' || CAST(page_id AS STRING) || '">'
          WHEN 2 THEN '<meta property="OG:Title" content=" Two  words "><meta name="twitter:title" content="TW ' || CAST(page_id AS STRING) || '"><meta property="og:image" content="/img/' || CAST(page_id AS STRING) || '.jpg">'
          WHEN 3 THEN '<link rel="canonical" href="' || url || '"><meta name="description" content="Meta description ' || CAST(page_id AS STRING) || '">'
          WHEN 4 THEN '<link rel="canonical" href="https://canon.example.com/other/path"><meta name="description" content="">'
          WHEN 5 THEN '<script type="application/ld+json">{"@type":"Product","name":"LD ' || CAST(page_id AS STRING) || '","description":"Said ' || CAST(page_id AS STRING) || '","image":["https://cdn.example.com/1.jpg",{"url":"https://cdn.example.com/2.jpg"}]}</script>'
          WHEN 6 THEN '<script type="application/ld+json">{"@graph":[{"@type":["Thing","product"],"name":"Graph ' || CAST(page_id AS STRING) || '"},{"@type":"BreadcrumbList"}]}</script><meta property="og:url" content="https://og.example.com/u">'
          WHEN 7 THEN '<script type="application/ld+json">{broken</script><meta property="og:site_name" content="Shop"><meta property="og:title" content="Better title ' || CAST(page_id AS STRING) || '">'
          ELSE '' END) AS html
        FROM {pages}""",
    "fetch_log": """
        SELECT p.page_id AS page_id, p.url AS url, a.attempt AS attempt, CAST(CASE (p.page_id + a.k * 3) % 9 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 403 WHEN 3 THEN 404 WHEN 4 THEN 429 WHEN 5 THEN 500 WHEN 6 THEN 503 WHEN 7 THEN 521 ELSE 200 END AS INT) AS status,
               CASE WHEN p.page_id % 2 = 0 THEN 'Cloudflare' ELSE 'nginx' END AS server, CASE WHEN p.page_id % 11 = 0 THEN 'challenge' WHEN p.page_id % 11 = 1 THEN ' ' END AS mitigated,
               CASE p.page_id % 5 WHEN 0 THEN '120' WHEN 1 THEN 'Wed, 31 Jan 2024 00:01:30 GMT' WHEN 2 THEN 'soon' WHEN 3 THEN 'Tue, 30 Jan 2024 23:00:00 GMT' END AS retry_after,
               CASE WHEN p.page_id % 13 = 0 THEN '<title>Just a moment...</title>' WHEN p.page_id % 13 = 1 THEN 'Error. Ray ID: 7' ELSE '<p>Fine ' || CAST(p.page_id AS STRING) || '</p>' END AS body,
               CASE p.page_id % 6 WHEN 0 THEN 'image/PNG' WHEN 1 THEN 'image/jpeg; q=1' WHEN 2 THEN 'text/html' WHEN 3 THEN 'image/svg+xml' WHEN 4 THEN 'image/webp' END AS content_type,
               CAST(p.page_id * 37 % 900 AS BIGINT) AS ms, CAST(length(p.html) AS BIGINT) AS bytes
        FROM {pages} p CROSS JOIN (SELECT 'proxy' AS attempt, 0 AS k UNION ALL SELECT 'direct', 1) a""",
    "rank_tiers": """
        SELECT listing_key, tier, rank, product_key, has_sort_by FROM (
          SELECT i.snapshot_id AS listing_key, t.tier AS tier, i.rank AS rank, i.product_key AS product_key, length(i.listing_key) % 2 = 0 OR ascii(substr(i.listing_key, length(i.listing_key), 1)) % 2 = 0 AS has_sort_by,
                 ascii(substr(i.listing_key, length(i.listing_key), 1)) % 4 AS c, ascii(substr(i.listing_key, length(i.listing_key) - 1, 1)) % 3 AS d, t.k AS k
          FROM {rank_items} i CROSS JOIN (SELECT 'fetched_html' AS tier, 0 AS k UNION ALL SELECT 'rendered_html', 1 UNION ALL SELECT 'feed', 2) t
        ) x WHERE (k = 0 AND c IN (0, 1)) OR (k = 1 AND c <> 3) OR (k = 2 AND d <> 1)""",
    "usage_events": """
        SELECT event_id, user_id, ts, event_type AS endpoint, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_type <> 'error' END AS ok,
               CAST(event_id % 1000 AS INT) AS duration_ms, CASE event_id % 3 WHEN 0 THEN 'request' WHEN 1 THEN 'env' END AS used_proxy, CAST(1 + event_id % 3 AS INT) AS units, event_type <> 'error' AS billable
        FROM {events}""",
    "credit_ledger": """
        SELECT event_id, user_id, CAST(CASE WHEN event_type = 'purchase' THEN 500 ELSE -1 - event_id % 7 END AS INT) AS units_delta, event_type AS source,
               CASE WHEN event_type = 'purchase' THEN 'order-' || CAST(event_id % 500 AS STRING) END AS provider_order_id, ts AS created_at
        FROM {events} WHERE event_type = 'purchase' OR (event_type = 'click' AND event_id % 10 = 0)""",
    "accounts": """
        SELECT CAST(c_custkey AS BIGINT) AS user_id, '  ' || c_name || '@Example.COM ' AS email, CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'user' END AS role,
               CAST(CAST(2000 + c_custkey % 20 AS STRING) || '-01-02 00:00:00' AS TIMESTAMP) AS created_at
        FROM {customer}""",
    "entitlements": """
        SELECT user_id, plan_code, billing_status, current_period_end, manual_plan_code, manual_unlimited, manual_expires_at FROM (
          SELECT CAST(o_custkey AS BIGINT) AS user_id, CASE o_orderkey % 4 WHEN 0 THEN 'starter' WHEN 1 THEN 'pro' WHEN 2 THEN 'scale' ELSE 'free' END AS plan_code,
                 CASE o_orderstatus WHEN 'F' THEN 'canceled' WHEN 'O' THEN 'active' ELSE 'trialing' END AS billing_status,
                 CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 < 3 THEN TIMESTAMP '2024-03-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS current_period_end,
                 CASE WHEN o_orderkey % 11 = 0 THEN 'pro' END AS manual_plan_code, o_orderkey % 23 = 0 AS manual_unlimited,
                 CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2024-02-15 00:00:00' WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2023-12-01 00:00:00' END AS manual_expires_at,
                 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
          FROM {orders}) x WHERE n = 1""",
    "tokens": """
        SELECT o_orderkey AS token_id, CAST(o_custkey AS BIGINT) AS user_id, o_orderdate AS created_at,
               CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2024-02-10 00:00:00' ELSE TIMESTAMP '2024-01-10 00:00:00' END AS expires_at,
               CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '2024-01-05 00:00:00' END AS used_at, CASE WHEN o_orderkey % 7 = 0 THEN TIMESTAMP '2024-01-06 00:00:00' END AS revoked_at,
               CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' END AS last_used_at, CASE WHEN o_orderkey % 9 <> 0 THEN 'po-' || CAST(o_orderkey % 3000 AS STRING) END AS provider_order_id
        FROM {orders}""",
    "image_meta": """
        SELECT d.doc_id AS image_id, d.doc_id % 40 AS product_id, d.doc_id AS ord, CAST((d.doc_id % 50 + 1) * 40 AS INT) AS width, CAST((d.doc_id % 13) * 60 + 40 AS INT) AS height,
               'https://cdn.example.com/' || CASE d.doc_id % 6 WHEN 0 THEN 'logo' WHEN 1 THEN 'icon-set' WHEN 2 THEN 'shoe' WHEN 3 THEN 'sprite' WHEN 4 THEN 'cart-icon' ELSE 'photo' END || '-' || CAST(d.doc_id AS STRING) || CASE WHEN d.doc_id % 10 = 0 THEN '.svg?v=1' ELSE '.jpg' END AS url,
               d.text AS content, CASE WHEN d.doc_id % 3 = 0 THEN d.source || ' ' || CAST(d.doc_id AS STRING) END AS alt
        FROM {documents} d""",
    "runs": """
        SELECT 'run-' || CAST(event_id AS STRING) AS run_id, 'd' || CAST(user_id % 9 AS STRING) || '.example.com' AS domain, ts AS created_at, CAST(event_id * 1000 + 1 AS BIGINT) AS bytes FROM {events}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver or a view over them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return view_over(spark, name, **{n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", VIEWS[name]))})


def view_over(spark: SparkSession, name: str, **used: DataFrame) -> DataFrame:
    """A view over the given tables, which stand for those that it names."""
    return spark.sql(re.sub(r"\{(?!\w+\})", "{{", re.sub(r"(?<!\{)\}", "}}", re.sub(r"\{(\w+)\}", r"<<\1>>", VIEWS[name]))).replace("<<", "{").replace(">>", "}"), **used)


def with_views(sql: str, *names: str) -> str:
    """A query for DuckDB with the views it names, and those they name, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in re.findall(r"\{(\w+)\}", VIEWS[name]):
                add(n)
            order.append(name)

    for name in names:
        add(name)
    ahead = ",\n".join(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', VIEWS[n])})" for n in order)
    body = sql.strip()
    if not ahead:
        return body
    return f"WITH {ahead}" + (f",\n{body[5:]}" if body[:5].upper() == "WITH " else f"\n{body}")
