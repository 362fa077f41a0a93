"""Queries of page extraction over pages with spliced head tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import extract as E
from ..sources.html import html_elements
from ..sources.tables import scan_pages
from .registry import register, register_path
from .url_text import _host, _path

TAGS = ("title", "meta", "link", "script", "h1", "h2", "h3", "h4", "dt", "summary", "strong", "b")
LABEL_TAGS = ("h2", "h3", "h4", "dt", "summary", "strong", "b")


def elements(pages):
    return html_elements(pages, TAGS)


def facts(pages):
    return E.page_facts(pages, elements(pages))


def fields(pages):
    return E.seo_fields(facts(pages))


def _text(e):
    return f"nullif(trim(regexp_replace(replace(replace(replace({e}, '&amp;', '&'), '&amp', '&'), '&quot;', '\"'), '\\s+', ' ', 'g')), '')"


def _tag(pattern, group=1):
    return f"regexp_extract(html, '(?is){pattern}', {group})"


_META = {k: _text(_tag(p)) for k, p in {
    "og_title": '<meta property="og:title" content="([^"]*)"', "og_description": '<meta property="og:description" content="([^"]*)"', "og_url": '<meta property="og:url" content="([^"]*)"',
    "og_site_name": '<meta property="og:site_name" content="([^"]*)"', "tw_title": '<meta name="twitter:title" content="([^"]*)"', "meta": '<meta name="description" content="([^"]*)"', "canonical": '<link rel="canonical" href="([^"]*)"',
}.items()}
_LD = "CASE WHEN page_id % 8 IN (5, 6) THEN {} END"
FACTS = f"""f AS (SELECT page_id, url, html, {_text(_tag('<title>(.*?)</title>'))} AS title_tag, {_text(_tag('<h1>(.*?)</h1>'))} AS h1, {", ".join(f"{v} AS {k}" for k, v in _META.items())},
  {_LD.format("nullif(regexp_extract(html, '\"name\":\"([^\"]*)\"', 1), '')")} AS ld_name, {_LD.format("nullif(regexp_extract(html, '\"description\":\"([^\"]*)\"', 1), '')")} AS ld_description,
  CASE page_id % 8 WHEN 5 THEN 1 WHEN 6 THEN 2 ELSE 0 END AS n_structured FROM page_seo)"""


def _chain(*steps, none):
    """SQL for value, source, confidence and number of warnings of the first step with a value."""
    pick = lambda k: "CASE " + " ".join(f"WHEN {s[0]} IS NOT NULL THEN {s[k]}" for s in steps)
    return f"{pick(0)} END AS value, {pick(1)} ELSE '{none}' END AS source, CAST({pick(2)} ELSE 0 END AS DOUBLE) AS confidence, CAST({pick(3)} ELSE 1 END AS INT) AS warned"


_BAD = "coalesce(lower(og_site_name) = lower(title_tag), false)"
TITLE = _chain((f"CASE WHEN NOT {_BAD} THEN title_tag END", "'title_tag'", "0.95", "0"), ("og_title", "'og:title'", "0.85", "0"), ("tw_title", "'twitter:title'", "0.8", "0"), ("ld_name", "'jsonld:Product.name'", "0.95", "0"), ("h1", "'h1'", "0.6", "1"), none="none")
DESCRIPTION = _chain(("meta", "'meta_description'", "0.9", "0"), ("og_description", "'og:description'", "0.85", "0"), ("ld_description", "'jsonld:Product.description'", "0.95", "0"), none="none")
CANONICAL = _chain(("canonical", "'canonical_link'", "0.95", f"CASE WHEN ({_path('canonical')}) <> ({_path('url')}) THEN 1 ELSE 0 END"), ("og_url", "'og:url'", "0.85", "1"), none="none")
PRODUCT_TITLE = _chain(("ld_name", "'jsonld:Product.name'", "0.95", "0"), ("CASE WHEN NOT coalesce(og_title = title_tag AND h1 IS NOT NULL, false) THEN og_title END", "'og:title'", "0.85", "0"), ("h1", "'h1'", "0.6", "0"), none="none")
PRODUCT_DESCRIPTION = _chain(("ld_description", "'jsonld:Product.description'", "0.95", "0"), ("og_description", "'og:description'", "0.85", "0"), ("meta", "'meta_description'", "0.9", "0"), none="none")
FIVE = {"title": TITLE, "description": DESCRIPTION, "canonical_url": CANONICAL, "product_title": PRODUCT_TITLE, "product_description": PRODUCT_DESCRIPTION}

register_path("scan_pages", "pages", lambda spark, path: scan_pages(spark, path).select("page_id", "url", F.char_length("html").alias("chars")), "SELECT page_id, url, CAST(length(html) AS INT) AS chars FROM pages")
register("html_elements", ("pages",), lambda p: html_elements(p, ("title", "h1")).select("page_id", "tag", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")),
         f"SELECT page_id, 'title' AS tag, coalesce({_text(_tag('<title>(.*?)</title>'))}, '') AS text FROM pages UNION ALL SELECT page_id, 'h1', coalesce({_text(_tag('<h1>(.*?)</h1>'))}, '') FROM pages")
register("meta_tags", ("page_seo",), lambda p: E.meta_tags(elements(p)).select("page_id", "name", "property", "content"),
         """SELECT page_id, nullif(regexp_extract(m, 'name="([^"]*)"', 1), '') AS name, nullif(regexp_extract(m, 'property="([^"]*)"', 1), '') AS property, regexp_extract(m, 'content="([^"]*)"', 1) AS content
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<meta [^>]*content="[^>]*>')) AS m FROM page_seo)""")
register("og_twitter_maps", ("page_seo",), lambda p: E.og_twitter_maps(elements(p)),
         """SELECT page_id, lower(regexp_extract(m, '(?:name|property)="([^"]*)"', 1)) AS key, regexp_extract(m, 'content="([^"]*)"', 1) AS content
FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<meta (?:name|property)="(?:og|twitter):[^>]*>')) AS m FROM page_seo)""")
register("link_tags", ("page_seo",), lambda p: E.link_tags(elements(p)).select("page_id", "rel", "href"),
         """SELECT page_id, regexp_extract(m, 'rel="([^"]*)"', 1) AS rel, regexp_extract(m, 'href="([^"]*)"', 1) AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<link [^>]*>')) AS m FROM page_seo)""")
_NODES = """SELECT page_id, n.pos AS pos, CASE page_id % 8 WHEN 5 THEN 'product' ELSE n.t END AS type FROM page_seo CROSS JOIN (VALUES (0, 'thing,product'), (1, 'breadcrumblist'), (2, '')) AS n(pos, t) WHERE page_id % 8 = 6 OR (page_id % 8 = 5 AND n.pos = 0)"""
register("jsonld_nodes", ("page_seo",), lambda p: E.jsonld_nodes(elements(p)).select("page_id", "pos", F.coalesce(F.array_join(E.jsonld_types(F.col("node")), ","), F.lit("")).alias("type")), f"SELECT page_id, CAST(pos AS INT) AS pos, type FROM ({_NODES})")
register("jsonld_first_of_type", ("page_seo",), lambda p: E.jsonld_first_of_type(E.jsonld_nodes(elements(p)), "Product", "ProductGroup").select("page_id", F.get_json_object("node", "$.name").alias("name")), f"WITH {FACTS} SELECT page_id, ld_name AS name FROM f WHERE page_id % 8 IN (5, 6)")
register("structured_data", ("page_seo",), lambda p: E.structured_data(E.jsonld_nodes(elements(p))).select("page_id", "pos"), f"SELECT page_id, CAST(pos AS INT) AS pos FROM ({_NODES}) WHERE type <> ''")
for _name, _sql in FIVE.items():
    register({"title": "seo_title", "description": "seo_description"}.get(_name, _name), ("page_seo",),
             lambda p, n=_name: fields(p).select("page_id", f"{n}.value", f"{n}.source", f"{n}.confidence", F.size(f"{n}.warnings").alias("warned")), f"WITH {FACTS} SELECT page_id, {_sql} FROM f")
register("degenerate_title", ("page_seo",), lambda p: facts(p).select("page_id", E.degenerate_title(F.col("title_tag"), F.concat(F.col("title_tag"), F.when(F.col("page_id") % 2 == 0, "!").otherwise(" 2"))).alias("bad")),
         f"WITH {FACTS} SELECT page_id, coalesce(trim(regexp_replace(strip_accents(lower(title_tag)), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(strip_accents(lower(title_tag || CASE WHEN page_id % 2 = 0 THEN '!' ELSE ' 2' END)), '[^a-z0-9]+', ' ', 'g')), false) AS bad FROM f")
register("page_empty_flag", ("page_seo",), lambda p: fields(p).select("page_id", "empty"), f"WITH {FACTS} SELECT page_id, coalesce(ld_name, og_title, h1) IS NULL AND coalesce(ld_description, og_description, meta) IS NULL AND n_structured = 0 AS empty FROM f")
WARNED = " UNION ALL ".join(f"SELECT page_id, warned FROM (SELECT page_id, {s} FROM f)" for s in FIVE.values())
register("field_warnings", ("page_seo",), lambda p: fields(p).select("page_id", F.size("warnings").alias("warned")), f"WITH {FACTS} SELECT page_id, CAST(sum(warned) AS INT) AS warned FROM ({WARNED}) GROUP BY page_id")
register("seo_snapshot", ("page_seo",), lambda p: fields(p).select("page_id", U.host(F.col("url")).alias("domain"), F.to_json(F.struct(*[F.struct(F.col(f"{n}.source").alias("source"), F.size(f"{n}.warnings").alias("warned")).alias(n) for n in FIVE])).alias("snapshot")),
         f"WITH {FACTS} SELECT page_id, domain, '{{' || string_agg('\"' || n || '\":{{\"source\":\"' || source || '\",\"warned\":' || warned::VARCHAR || '}}', ',' ORDER BY k) || '}}' AS snapshot FROM (" + " UNION ALL ".join(f"SELECT page_id, {_host('url')} AS domain, '{n}' AS n, {k} AS k, source, warned FROM (SELECT page_id, url, {s} FROM f)" for k, (n, s) in enumerate(FIVE.items())) + ") GROUP BY page_id, domain")
_FF = {
    "title": _chain(("title_tag", "'title_tag'", "0.95", "0"), ("og_title", "'og:title'", "0.9", "0"), ("tw_title", "'twitter:title'", "0.85", "0"), ("ld_name", "'jsonld:Product.name'", "0.95", "0"), ("h1", "'h1'", "0.65", "1"), none="not_found"),
    "description": _chain(("meta", "'meta_description'", "0.9", "0"), ("og_description", "'og:description'", "0.85", "0"), ("ld_description", "'jsonld:Product.description'", "0.95", "0"), none="not_found"),
    "canonical_url": _chain(("canonical", "'canonical_link'", "0.95", "0"), ("og_url", "'og:url'", "0.8", "1"), none="not_found"),
    "product_title": _chain(("ld_name", "'jsonld:Product.name'", "0.95", "0"), ("og_title", "'og:title'", "0.85", "0"), ("h1", "'h1'", "0.7", "0"), none="not_found"),
    "product_description": _chain(("ld_description", "'jsonld:Product.description'", "0.95", "0"), ("og_description", "'og:description'", "0.8", "0"), ("meta", "'meta_description'", "0.75", "0"), none="not_found"),
}
_five = lambda d: d.select("page_id", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"{n}.source").alias("source"), F.col(f"{n}.confidence").alias("confidence"), F.size(f"{n}.warnings").alias("warned")) for n in FIVE])).alias("x")).select("page_id", "x.*")
register("fetch_first_fields", ("page_seo",), lambda p: _five(E.fetch_first_fields(p)), f"WITH {FACTS} " + " UNION ALL ".join(f"SELECT page_id, '{n}' AS field, source, confidence, warned FROM (SELECT page_id, {s} FROM f)" for n, s in _FF.items()))
register("thin_page_warnings", ("pages",), lambda p: E.thin_page_warnings(p, F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/"))).otherwise(F.col("url"))).select("page_id", F.array_join("warnings", ",").alias("warnings")),
         "SELECT page_id, concat_ws(',', CASE WHEN length(html) < 5000 THEN 'small' END, CASE WHEN page_id % 3 = 0 THEN 'moved' END) AS warnings FROM pages")
register("confidence_dim", ("page_seo",), lambda p: _five(fields(p)).groupBy(F.split_part("source", F.lit(":"), F.lit(1)).alias("source")).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(E.confidence_dim(p.sparkSession)), "source"),
         f"WITH {FACTS} SELECT source, count(*) AS n, max(confidence) AS confidence FROM (" + " UNION ALL ".join(f"SELECT split_part(source, ':', 1) AS source, confidence FROM (SELECT page_id, {s} FROM f)" for s in FIVE.values()) + ") GROUP BY source")
register("store_title_audit", ("page_seo",), lambda p: E.store_title_audit(facts(p)),
         f"WITH {FACTS}, c AS (SELECT {_host('url')} AS host, title_tag, count(*) AS n, sum(CASE WHEN {_BAD} THEN 1 ELSE 0 END) AS bad FROM f GROUP BY 1, 2) SELECT host, CAST(sum(n) AS BIGINT) AS pages, count(title_tag) AS titles, CAST(sum(bad) AS BIGINT) AS degenerate, arg_max(title_tag, (n, title_tag)) AS top_title FROM c GROUP BY host")
register("field_coverage", ("page_seo",), lambda p: E.field_coverage(fields(p)),
         f"WITH {FACTS}, r AS (" + " UNION ALL ".join(f"SELECT {_host('url')} AS host, '{n}' AS field, source, confidence, value IS NULL AS missing FROM (SELECT url, {s} FROM f)" for n, s in FIVE.items())
         + ") SELECT coalesce(field, '*') AS field, coalesce(source, '*') AS source, coalesce(host, '*') AS host, count(*) AS pages, round(avg(confidence), 6) AS confidence, round(avg(CASE WHEN missing THEN 1.0 ELSE 0 END), 6) AS missing FROM r GROUP BY ROLLUP (field, source, host)")
register("label_section_text", ("pages",), lambda p: E.label_section_text(html_elements(p.withColumn("html", F.concat(F.lit("<div><h3>Product Details "), F.col("page_id").cast("string"), F.lit("</h3><p>"), F.regexp_extract("html", "<p><b>([^<]*)", 1), F.lit("</p></div>"))), LABEL_TAGS)),
         f"SELECT page_id, CASE WHEN length(t) >= 30 THEN t ELSE 'Product Details ' || page_id::VARCHAR || t END AS label_text FROM (SELECT page_id, {_text(_tag('<p><b>([^<]*)'))} AS t FROM pages) WHERE length('Product Details ' || page_id::VARCHAR || t) >= 30")
