"""Queries of image discovery, hashing and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import extract as E
from ..operators import media as M
from ..session import stored
from ..sources.html import html_elements
from .registry import columns, register

_c = F.col


#: What stands around the gallery, by page_id modulo 7: containers of several ranks, none, an empty one, one around the main element, a section that is left out.
_AROUND = (
    ('<main><div class="x product-gallery">', "</div></main>"), ('<main><div itemtype="https://schema.org/Product">', "</div></main>"), ("<main><article>", "</article></main>"), ("<section><article>", "</article></section>"),
    ('<main><div class="product-gallery"></div>', "</main>"), ('<div id="product-media"><main>', "</main></div>"), ('<main><div class="upsell">', "</div></main>"),
)


def _gallery(pages):
    """Pages with a small gallery that is made from their own id, in seven kinds of surroundings."""
    kind = (_c("page_id") % 7 + 1).cast("int")
    opened, closed = (F.element_at(F.array(*[F.lit(around[k]) for around in _AROUND]), kind) for k in (0, 1))
    piece = F.concat(opened, F.lit('<img class="review-photo" src="/r.jpg"><img src="/a-'), _c("page_id").cast("string"), F.lit('.jpg" alt="x"><img data-src="/b.jpg?utm_source=q&w=3" srcset="/c.jpg 1x, /a-'), _c("page_id").cast("string"), F.lit('.jpg 2x"><picture><source srcset="/d.webp 1x"></picture><div style="background-image: url(\'/e.png\')"></div>'), closed, F.lit('<nav><img src="/logo.png"></nav>'), F.when(kind != 4, '<p><img src="/elsewhere.jpg"></p>').otherwise(""))
    return pages.withColumn("html", F.concat(F.lit('<link rel="preload" as="image" href="/f.jpg">'), piece, "html"))


def discovered(pages):
    elements = html_elements(_gallery(pages), (*M.IMAGE_TAGS, "meta", "script"), M.IMAGE_LISTS)
    metas = E.og_twitter_maps(elements).where(F.col("key").isin("og:image", "twitter:image")).select("page_id", F.when(F.col("key") == "og:image", 0).otherwise(1).alias("ord"), F.col("content").alias("raw"), F.col("key").alias("source"))
    return M.discover_images(pages, M.jsonld_images(E.jsonld_nodes(elements)), metas, M.dom_images(elements))


_DOM = "(VALUES ('img', 2, '/a-' , 'img'), ('img', 3, '/b.jpg?w=3', 'data-src'), ('img', 4, '/c.jpg', 'srcset'), ('picture', 5, '/d.webp', 'picture-source'), ('css', 6, '/e.png', 'css-bg'), ('preload', 7, '/f.jpg', 'preload'))"
_SHOWN = "(d.tier = 'preload' OR page_id % 7 NOT IN (4, 6))"
_ORIGIN = "lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1))"
_FOUND = f"""found AS (SELECT * FROM (SELECT page_id, 'https://cdn.example.com/' || k::VARCHAR || '.jpg' AS image, 'jsonld' AS tier, k AS o FROM page_seo CROSS JOIN (VALUES (1), (2)) AS v(k) WHERE page_id % 8 = 5
  UNION ALL SELECT page_id, {_ORIGIN} || '/img/' || page_id::VARCHAR || '.jpg', 'og', 0 FROM page_seo WHERE page_id % 8 = 2
  UNION ALL SELECT page_id, {_ORIGIN} || CASE WHEN d.raw = '/a-' THEN '/a-' || page_id::VARCHAR || '.jpg' ELSE d.raw END, d.tier, d.o FROM page_seo JOIN {_DOM} AS d(tier, o, raw, source) ON {_SHOWN}) WHERE NOT regexp_matches(lower(image), 'hero|logo|share|cart|trust|badge'))"""
register("discover_images", ("page_seo",), lambda p: discovered(p).select("page_id", "image", "tier", "nth"),
         f"WITH {_FOUND} SELECT page_id, image, tier, CAST(row_number() OVER (PARTITION BY page_id ORDER BY CASE tier WHEN 'jsonld' THEN 0 WHEN 'og' THEN 1 WHEN 'img' THEN 2 WHEN 'picture' THEN 3 WHEN 'css' THEN 4 ELSE 5 END, o) AS INT) AS nth FROM found")
register("tier_counts", ("page_seo",), lambda p: M.tier_counts(discovered(p)), f"WITH {_FOUND} SELECT page_id, {', '.join(f'count(*) FILTER (WHERE tier = {chr(39)}{t}{chr(39)}) AS {t}' for t in M.TIERS)} FROM found GROUP BY page_id")
register("dom_images", ("page_seo",), lambda p: M.dom_images(html_elements(_gallery(p), M.IMAGE_TAGS, M.IMAGE_LISTS)).select("page_id", "raw", "source"),
         f"SELECT page_id, CASE WHEN d.raw = '/a-' THEN '/a-' || page_id::VARCHAR || '.jpg' WHEN d.o = 3 THEN '/b.jpg?utm_source=q&w=3' ELSE d.raw END AS raw, d.source AS source FROM page_seo JOIN {_DOM} AS d(tier, o, raw, source) ON {_SHOWN} UNION ALL SELECT page_id, '/a-' || page_id::VARCHAR || '.jpg', 'srcset' FROM page_seo WHERE page_id % 7 NOT IN (4, 6)")
register("product_scope", ("page_seo",), lambda p: M.product_scope(html_elements(_gallery(p), (), M.SCOPE_NAMES)).select("page_id", "scope"), "SELECT page_id, CAST(CASE WHEN page_id % 7 IN (5, 6) THEN 1 ELSE 2 END AS INT) AS scope FROM page_seo WHERE page_id % 7 <> 3")
register("excluded_section", ("page_seo",), lambda p: html_elements(_gallery(p), ("img",)).groupBy("page_id").agg(F.count_if(M.excluded_section()).alias("excluded"), F.count(F.lit(1)).alias("images")), "SELECT page_id, CAST(CASE WHEN page_id % 7 = 6 THEN 4 ELSE 2 END AS BIGINT) AS excluded, CAST(CASE WHEN page_id % 7 <> 3 THEN 5 ELSE 4 END AS BIGINT) AS images FROM page_seo")
register("jsonld_images", ("page_seo",), lambda p: M.jsonld_images(E.jsonld_nodes(html_elements(p, ("script",)))).select("page_id", "at", "raw", "source"),
         "SELECT page_id, CAST(k - 1 AS INT) AS at, 'https://cdn.example.com/' || k::VARCHAR || '.jpg' AS raw, CASE k WHEN 1 THEN 'jsonld' ELSE 'jsonld:ImageObject' END AS source FROM page_seo CROSS JOIN (VALUES (1), (2)) AS v(k) WHERE page_id % 8 = 5".replace("AS at,", 'AS "at",'))
columns("excluded_asset", "image_meta", ("image_id",), {"excluded": (lambda: M.excluded_asset(_c("url")), "regexp_matches(lower(url), '\\.svg($|\\?)|sprite|logo|\\bicon\\b|cart')")})
columns("template_placeholder", "image_meta", ("image_id",), {"placeholder": (lambda: M.template_placeholder(F.when(_c("image_id") % 3 == 0, F.concat(F.lit("/{{ "), _c("alt"), F.lit(" }}"))).when(_c("image_id") % 3 == 1, F.concat("url", F.lit("%3Cx"))).otherwise(_c("url"))), "image_id % 3 <> 2")})
register("fetch_first_images", ("page_seo",), lambda p: M.fetch_first_images(_gallery(p)),
         f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS INT) AS nth, image FROM (
  SELECT page_id, {_ORIGIN} || '/img/' || page_id::VARCHAR || '.jpg' AS image, 0 AS o FROM page_seo WHERE page_id % 8 = 2
  UNION ALL SELECT page_id, {_ORIGIN} || replace(v.path, '#', page_id::VARCHAR), v.o FROM page_seo CROSS JOIN (VALUES ('/r.jpg', 1), ('/a-#.jpg', 2), ('/b.jpg?utm_source=q&w=3', 3), ('/logo.png', 4)) AS v(path, o)
  UNION ALL SELECT page_id, {_ORIGIN} || '/elsewhere.jpg', 5 FROM page_seo WHERE page_id % 7 <> 3)""")
columns("content_sha256", "documents", ("doc_id",), {"sha": (lambda: H.content_sha256(_c("text").cast("binary")), "sha256(text)")})
_AT = [r * 8 + k for r in range(8) for k in range(7)]
_DHASH = "list_aggregate(list_transform([" + ", ".join(map(str, _AT)) + "], lambda i: CASE WHEN embedding[i + 1] < embedding[i + 2] THEN '1' ELSE '0' END), 'string_agg', '')"
_number = lambda bits: f"list_sum(list_transform(range(length({bits})), lambda i: CASE WHEN substr({bits}, length({bits}) - i::INT, 1) = '1' THEN CAST(1 AS BIGINT) << i::INT ELSE 0 END))::BIGINT"
columns("dhash_bits", "embeddings", ("vec_id",), {"dhash": (lambda: H.dhash_bits(_c("embedding"), 8, 8), f"(SELECT {_number('b')} FROM (SELECT {_DHASH} AS b))")})
columns("phash_threshold", "embeddings", ("vec_id",), {"ones": (lambda: F.bit_count(H.median_threshold_bits(_c("embedding"))), "CAST(len(list_filter(embedding, lambda x: x > list_sort(embedding[2:64])[32])) AS INT)")})
_HASHED = lambda d: d.select(_c("vec_id").cast("long").alias("id"), H.dhash_bits(_c("embedding"), 8, 8).alias("hash"))
# Each vector's hash and a copy of it with two bits changed.
_TWICE = lambda d: _HASHED(d).unionByName(_HASHED(d).select((_c("id") + 100000).alias("id"), _c("hash").bitwiseXOR(F.lit(5)).alias("hash")))
_H = f"h AS (SELECT vec_id::BIGINT AS id, {_DHASH} AS bits FROM embeddings)"
register("hamming", ("embeddings",), lambda d: _HASHED(d).crossJoin(F.broadcast(_HASHED(d.where("vec_id = 0")).select(_c("hash").alias("other")))).select("id", H.hamming(_c("hash"), _c("other")).alias("distance")),
         f"WITH {_H} SELECT h.id, CAST(hamming(h.bits, o.bits) AS INT) AS distance FROM h, (SELECT bits FROM h WHERE id = 0) o")
register("near_dup_pairs", ("embeddings",), lambda d: M.near_dup_pairs(_TWICE(d)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance"),
         f"WITH {_H}, t AS (SELECT * FROM h UNION ALL SELECT id + 100000, substr(bits, 1, 53) || translate(substr(bits, 54, 1), '01', '10') || substr(bits, 55, 1) || translate(substr(bits, 56, 1), '01', '10') FROM h), o AS (SELECT bits, min(id) AS id FROM t GROUP BY bits) SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, CAST(hamming(x.bits, y.bits) AS INT) AS distance FROM o x JOIN o y ON x.id < y.id AND hamming(x.bits, y.bits) <= 6")
_gray = lambda c: F.transform(c, lambda x: (x.cast("double") + 1) * 100)
register("ssim", ("embeddings",), lambda d: d.select("vec_id", F.round(H.ssim(_gray(_c("embedding")), F.reverse(_gray(_c("embedding")))), 6).alias("ssim")), """
WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE + 1) * 100) AS a FROM embeddings), z AS (SELECT vec_id, unnest(a) AS x, unnest(list_reverse(a)) AS y FROM g),
s AS (SELECT vec_id, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS c FROM z GROUP BY vec_id)
SELECT vec_id, round(greatest(0, least(1, (2 * mx * my + 6.5025) * (2 * c + 58.5225) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225)))), 6) AS ssim FROM s""")
register("edge_similarity", ("embeddings",), lambda d: d.select("vec_id", H.edge_similarity(_gray(_c("embedding")), F.reverse(_gray(_c("embedding")))).alias("share")))
register("phash_bits", ("embeddings",), lambda d: d.select("vec_id", H.phash_bits(F.flatten(F.array_repeat(_gray(_c("embedding")), 16))).alias("phash")))
_IMAGES = lambda d: d.select((F.floor(_c("vec_id") / 25)).cast("long").alias("product_id"), _c("vec_id").cast("long").alias("ord"), H.dhash_bits(_c("embedding"), 8, 8).alias("dhash"), _gray(_c("embedding")).alias("gray"))
register("leader_groups", ("embeddings",), lambda d: M.leader_groups(_IMAGES(d)))
_FAILED = lambda d: _IMAGES(d).groupBy("product_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(_c("ord") % 7 == 0).alias("failed"))
register("selection_fallback", ("embeddings",), lambda d: M.selection_fallback(M.leader_groups(_IMAGES(d)), _FAILED(d), enabled=True))


def _report(d):
    groups = stored(M.leader_groups(_IMAGES(d)), "groups")
    return M.selection_report(groups, M.selection_fallback(groups, _FAILED(d), enabled=True))


register("selection_report", ("embeddings",), _report)
register("exact_dup_filter", ("image_meta",), lambda i: M.exact_dup_filter(i.withColumn("sha", F.sha2("content", 256)), "product_id", "sha", "ord").select("image_id", "similar_to"),
         "WITH m AS (SELECT *, min(ord) OVER (PARTITION BY product_id, sha256(content)) AS first_ord FROM image_meta) SELECT image_id, CASE WHEN first_ord < ord THEN first_ord END AS similar_to FROM m")
register("quality_filter", ("image_meta",), lambda i: M.quality_filter(i).select("image_id", "reason"), "SELECT image_id, CASE WHEN width < 300 OR height < 300 THEN 'too_small' WHEN greatest(width / height, height / width) > 3 THEN 'extreme_ratio' END AS reason FROM image_meta")
register("image_downsample_features", ("image_meta",), lambda i: M.image_downsample_features(i).select("image_id", F.round("aspect", 6).alias("aspect")), "SELECT image_id, round(CASE WHEN width > 0 AND height > 0 THEN greatest(width / height, height / width) END, 6) AS aspect FROM image_meta")
