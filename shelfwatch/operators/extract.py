"""SEO and product fields of pages, each with its source, confidence and warnings.

``page_facts`` gathers what the chains choose from: one row for each page. The fetch-first family reads the
page by regular expressions alone and has its own confidences.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import urls as U
from ..functions.text import clean_text, decode_entities, normalize_for_compare

# Confidence by source, types kept as structured data, labels of description sections.
CONFIDENCE = {
    "jsonld": 0.95, "title_tag": 0.95, "meta_description": 0.9, "canonical_link": 0.95, "og": 0.85, "twitter": 0.8,
    "h1": 0.6, "dom_label_heuristic": 0.5, "dom_heading": 0.35, "none": 0.0,
}
STRUCTURED = ("product", "productgroup", "offer", "imageobject", "breadcrumblist")
LABELS = (
    "description", "omschrijving", "productinformatie", "productomschrijving", "details", "productdetails", "materiaal",
    "pasvorm", "kenmerken", "product details", "over dit product",
)

FIELD = "struct<value:string,source:string,confidence:double,warnings:array<string>>"


def field(value: Column, source: str, confidence: float, *warnings: str | Column) -> Column:
    notes = F.array(*[F.lit(w) if isinstance(w, str) else w for w in warnings]).cast("array<string>")
    notes = F.filter(notes, lambda w: w.isNotNull())
    return F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(source).alias("source"), F.lit(float(confidence)).alias("confidence"), notes.alias("warnings")))


def empty_field(warning: str, source: str = "none") -> Column:
    return F.struct(F.lit(None).cast("string").alias("value"), F.lit(source).alias("source"), F.lit(0.0).alias("confidence"), F.array(F.lit(warning)).alias("warnings"))


def _attr(name: str) -> Column:
    return F.element_at("attrs", name)


def meta_tags(elements: DataFrame) -> DataFrame:
    """Meta tags with content: (page_id, ord, name, property, content)."""
    return elements.where((F.col("tag") == "meta") & _attr("content").isNotNull()).select("page_id", "ord", _attr("name").alias("name"), _attr("property").alias("property"), _attr("content").alias("content"))


def og_twitter_maps(elements: DataFrame) -> DataFrame:
    """(page_id, key, content): Open Graph and Twitter entries; of repeated keys the last counts."""
    rows = meta_tags(elements).withColumn("key", F.lower(F.coalesce("property", "name", F.lit(""))))
    rows = rows.where(F.col("key").startswith("og:") | F.col("key").startswith("twitter:"))
    return rows.groupBy("page_id", "key").agg(F.max_by("content", "ord").alias("content"))


def link_tags(elements: DataFrame) -> DataFrame:
    good = (F.coalesce(_attr("rel"), F.lit("")) != "") & (F.coalesce(_attr("href"), F.lit("")) != "")
    return elements.where((F.col("tag") == "link") & good).select("page_id", "ord", _attr("rel").alias("rel"), _attr("href").alias("href"))


def _flatten(value) -> list[dict]:
    """Nodes of lists and graphs, what a graph holds before the node that holds it."""
    found, work = [], [(value, False)]
    while work:
        value, opened = work.pop()
        if isinstance(value, list):
            work += [(v, False) for v in reversed(value)]
        elif isinstance(value, dict):
            if isinstance(value.get("@graph"), list) and not opened:
                work += [(value, True), (value["@graph"], False)]
            else:
                found.append(value)
    return found


def jsonld_nodes(elements: DataFrame) -> DataFrame:
    """Script elements -> (page_id, pos, node JSON); blocks that aren't JSON, or are nested too deeply, are skipped."""

    @F.arrow_udf("array<string>")
    def nodes(blocks: pa.Array) -> pa.Array:
        made = []
        for texts in blocks.to_pylist():
            found: list = []
            for text in texts or []:
                try:
                    found += [json.dumps(n, ensure_ascii=False) for n in _flatten(json.loads(text))]
                except (ValueError, RecursionError):  # RecursionError: nested too deeply for the JSON parser
                    continue
            made.append(found)
        return pa.array(made, pa.list_(pa.string()))

    scripts = elements.where((F.col("tag") == "script") & (_attr("type") == "application/ld+json"))
    pages = scripts.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]).alias("blocks"))
    return pages.select("page_id", F.posexplode(nodes("blocks")).alias("pos", "node"))


def jsonld_types(node: Column) -> Column:
    """The lower-cased types of a node."""
    v = F.try_parse_json(node)
    listed = F.try_variant_get(v, "$['@type']", "array<string>")
    return F.transform(F.coalesce(listed, F.array(F.try_variant_get(v, "$['@type']", "string"))), lambda t: F.lower(t))


def jsonld_first_of_type(nodes: DataFrame, *types: str) -> DataFrame:
    """(page_id, node): the first node of the first type that a page has."""
    rank = F.least(*[F.when(F.array_contains(jsonld_types(F.col("node")), t.lower()), F.lit(k)) for k, t in enumerate(types)], F.lit(len(types)))
    return nodes.withColumn("_rank", rank).where(F.col("_rank") < len(types)).groupBy("page_id").agg(F.min_by("node", F.struct("_rank", "pos")).alias("node"))


def structured_data(nodes: DataFrame, types: tuple[str, ...] = STRUCTURED) -> DataFrame:
    return nodes.where(F.arrays_overlap(jsonld_types(F.col("node")), F.array(*map(F.lit, types))))


def page_facts(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """A row for each page with all that the chains need; texts are cleaned, missing ones null."""
    first = lambda cond: F.min_by("text", F.when(cond, F.col("ord")))
    tag = F.col("tag")
    heading = tag.isin("h1", "h2") | (_attr("role") == "heading")
    texts = elements.groupBy("page_id").agg(
        clean_text(first(tag == "title")).alias("title_tag"), clean_text(first(tag == "h1")).alias("h1"),
        F.min_by(_attr("content"), F.when((tag == "meta") & (_attr("name") == "description"), F.col("ord"))).alias("meta_description"),
        F.min_by(_attr("href"), F.when((tag == "link") & (_attr("rel") == "canonical"), F.col("ord"))).alias("canonical"),
        F.slice(F.sort_array(F.collect_list(F.when(heading, F.struct("ord", "text")))), 1, 10).alias("headings"),
    )
    names = {"og_title": "og:title", "og_description": "og:description", "og_url": "og:url", "og_site_name": "og:site_name", "og_image": "og:image", "tw_title": "twitter:title", "tw_description": "twitter:description"}
    maps = og_twitter_maps(elements).groupBy("page_id").agg(*[clean_text(F.max(F.when(F.col("key") == k, F.col("content")))).alias(n) for n, k in names.items()])
    nodes = jsonld_nodes(elements)
    ld = lambda types, name: jsonld_first_of_type(nodes, *types).select("page_id", F.col("node").alias(name))
    kept = structured_data(nodes).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_structured"))
    rows = pages.select("page_id", "url").join(texts, "page_id", "left").join(maps, "page_id", "left").join(ld(["Product"], "product"), "page_id", "left")
    rows = rows.join(ld(["Product", "ProductGroup"], "product_like"), "page_id", "left").join(kept, "page_id", "left").join(label_section_text(elements), "page_id", "left")
    get = lambda node, path: clean_text(F.try_variant_get(F.try_parse_json(node), path, "string"))
    return rows.select(
        "page_id", "url", "title_tag", "h1", clean_text(F.col("meta_description")).alias("meta_description"), clean_text(F.col("canonical")).alias("canonical"), "headings", *names,
        get("product", "$.name").alias("ld_name"), get("product", "$.description").alias("ld_description"), get("product_like", "$.name").alias("ld_any_name"),
        get("product_like", "$.description").alias("ld_any_description"), F.col("product").isNotNull().alias("has_product"), F.coalesce("n_structured", F.lit(0)).alias("n_structured"), "label_text",
    )


def degenerate_title(title: Column, site: Column) -> Column:
    """The title says no more than the name of the site."""
    return F.coalesce((normalize_for_compare(title) != "") & (normalize_for_compare(title) == normalize_for_compare(site)), F.lit(False))


def seo_title() -> Column:
    """Title tag (unless it only names the site), Open Graph, Twitter, JSON-LD, first heading."""
    c = F.col
    bad = degenerate_title(c("title_tag"), c("og_site_name"))
    warning = F.concat(F.lit("The title is only the store name ("), c("title_tag"), F.lit("); it says nothing of the page."))
    better = F.coalesce("og_title", "tw_title", "ld_name", "h1")
    other = F.when(bad & (normalize_for_compare(better) != normalize_for_compare(c("title_tag"))), better)
    return F.coalesce(
        field(F.when(~bad, c("title_tag")), "title_tag", CONFIDENCE["title_tag"]), field(other, "og:title", CONFIDENCE["og"], warning),
        field(c("title_tag"), "title_tag", CONFIDENCE["title_tag"], warning), field(c("og_title"), "og:title", CONFIDENCE["og"]), field(c("tw_title"), "twitter:title", CONFIDENCE["twitter"]),
        field(c("ld_name"), "jsonld:Product.name", CONFIDENCE["jsonld"]), field(c("h1"), "h1", CONFIDENCE["h1"], "Title taken from the first heading."), empty_field("No SEO title found."),
    )


def seo_description() -> Column:
    c = F.col
    return F.coalesce(
        field(c("meta_description"), "meta_description", CONFIDENCE["meta_description"]), field(c("og_description"), "og:description", CONFIDENCE["og"]),
        field(c("tw_description"), "twitter:description", CONFIDENCE["twitter"]), field(c("ld_description"), "jsonld:Product.description", CONFIDENCE["jsonld"]), empty_field("No SEO description found."),
    )


def canonical_url() -> Column:
    """The canonical link made absolute (with a warning if it leads elsewhere or can't be read), else og:url."""
    c = F.col
    absolute = U.url_resolve(c("canonical"), c("url"))
    elsewhere = F.when(U.path(absolute) != U.path(c("url")), "Canonical path differs from the page path.")
    return F.coalesce(
        field(absolute, "canonical_link", CONFIDENCE["canonical_link"], elsewhere), field(c("canonical"), "canonical_link", CONFIDENCE["canonical_link"], "Canonical link is not a URL."),
        field(c("og_url"), "og:url", CONFIDENCE["og"], "No canonical link; og:url used."), empty_field("No canonical URL found."),
    )


def product_title() -> Column:
    """JSON-LD, Open Graph unless it repeats the title tag of a page with a heading, heading, longest early heading."""
    c = F.col
    tag = F.when(seo_title()["source"] == "title_tag", c("title_tag"))
    echo = F.coalesce((c("og_title") == tag) & c("h1").isNotNull(), F.lit(False))
    texts = F.filter(F.transform("headings", lambda h: F.struct(F.char_length(clean_text(h["text"])).alias("n"), (-h["ord"]).alias("o"), clean_text(h["text"]).alias("t"))), lambda h: h["n"] >= 3)
    guess = F.array_max(texts)["t"]
    return F.coalesce(
        field(c("ld_any_name"), "jsonld:Product.name", CONFIDENCE["jsonld"]), field(F.when(~echo, c("og_title")), "og:title", CONFIDENCE["og"]), field(c("h1"), "h1", CONFIDENCE["h1"]),
        field(c("og_title"), "og:title", CONFIDENCE["og"]), field(guess, "dom_heading", CONFIDENCE["dom_heading"], "Product title guessed from a heading."), empty_field("No product title found."),
    )


def product_description() -> Column:
    c = F.col
    return F.coalesce(
        field(c("ld_any_description"), "jsonld:Product.description", CONFIDENCE["jsonld"]), field(c("og_description"), "og:description", CONFIDENCE["og"]), field(c("meta_description"), "meta_description", CONFIDENCE["meta_description"]),
        field(c("label_text"), "dom_label_heuristic", CONFIDENCE["dom_label_heuristic"], "Description guessed from a labelled section."), empty_field("No product description found."),
    )


def label_section_text(elements: DataFrame) -> DataFrame:
    """(page_id, label_text): the text beside the first short label of a description section, 30 characters at least."""
    label = F.lower(clean_text(F.col("text")))
    is_label = F.col("tag").isin("h2", "h3", "h4", "dt", "summary", "strong", "b") | (_attr("role") == "heading")
    rows = elements.where(is_label & (F.char_length(label) <= 40) & label.rlike("|".join(LABELS)))
    long = lambda c: F.when(F.char_length(clean_text(F.col(c))) >= 30, clean_text(F.col(c)))
    rows = rows.withColumn("label_text", F.coalesce(long("next_text"), long("parent_text"))).where("label_text is not null")
    return rows.groupBy("page_id").agg(F.min_by("label_text", "ord").alias("label_text"))


def seo_fields(facts: DataFrame) -> DataFrame:
    """The five fields of each page, whether it is empty, and all warnings in order."""
    rows = facts.select("page_id", "url", seo_title().alias("title"), seo_description().alias("description"), canonical_url().alias("canonical_url"), product_title().alias("product_title"), product_description().alias("product_description"), "n_structured", "og_site_name")
    return rows.withColumn("empty", page_empty_flag()).withColumn("warnings", field_warnings("title", "description", "canonical_url", "product_title", "product_description"))


def page_empty_flag() -> Column:
    return F.col("product_title.value").isNull() & F.col("product_description.value").isNull() & (F.col("n_structured") == 0)


def field_warnings(*fields: str) -> Column:
    return F.flatten(F.array(*[F.col(f"{f}.warnings") for f in fields]))


def confidence_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONFIDENCE.items()), "source string, confidence double")


def store_title_audit(facts: DataFrame) -> DataFrame:
    """By host: pages, distinct titles, pages whose title only names the site, and the most common title.

    Titles are counted by host and title first, so that one host with most pages is pre-aggregated.
    """
    rows = facts.select(U.host(F.col("url")).alias("host"), "title_tag", degenerate_title(F.col("title_tag"), F.col("og_site_name")).alias("bad"))
    counts = rows.groupBy("host", "title_tag").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"))
    top = F.max_by("title_tag", F.struct("n", "title_tag"))
    return counts.groupBy("host").agg(F.sum("n").alias("pages"), F.count("title_tag").alias("titles"), F.sum("bad").alias("degenerate"), top.alias("top_title"))


def field_coverage(fields: DataFrame) -> DataFrame:
    """By host, field and source, with subtotals: pages, mean confidence, share without a value."""
    names = ("title", "description", "canonical_url", "product_title", "product_description")
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"{n}.source").alias("source"), F.col(f"{n}.confidence").alias("confidence"), F.col(f"{n}.value").isNull().alias("missing")) for n in names])
    rows = fields.select(U.host(F.col("url")).alias("host"), F.explode(pairs).alias("f")).select("host", "f.*")
    made = rows.rollup("field", "source", "host").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg(F.col("missing").cast("int")), 6).alias("missing"))
    return made.select(*[F.coalesce(c, F.lit("*")).alias(c) for c in ("field", "source", "host")], "pages", "confidence", "missing")


# Fetch-first: regular expressions on the page text.


def _first(pattern: str) -> Column:
    found = F.regexp_extract("html", pattern, 1)
    cleaned = F.trim(F.regexp_replace(decode_entities(F.regexp_replace(found, "<[^>]*>", " "), True), r"\s+", " "))
    return F.when(cleaned != "", cleaned)


#: An attribute's value up to the quote that opened it.
_QUOTED = r"\s*=\s*([\"'])(.*?)\1"


def _value(tag: Column, name: str) -> Column:
    return decode_entities(F.regexp_extract(tag, rf"(?i)\b{name}{_QUOTED}", 2), True)


def _meta(attribute: str, key: str, last: bool = True) -> Column:
    """The cleaned content of the meta tags with the key: the last that has any, or that of the first tag."""
    tags = F.regexp_extract_all("html", F.lit(r"(?i)(<meta\b[^>]*>)"), 1)
    tags = F.filter(tags, lambda t: F.lower(_value(t, attribute)) == key)
    said = F.transform(tags, lambda t: F.trim(F.regexp_replace(_value(t, "content"), r"\s+", " ")))
    said = F.filter(said, lambda v: v != "") if last else said
    found = F.try_element_at(said, F.lit(-1)) if last else F.get(said, F.lit(0))
    return F.when(found != "", found)


def _canonical() -> Column:
    tags = F.regexp_extract_all("html", F.lit(r"(?i)(<link\b[^>]*>)"), 1)
    tag = F.get(F.filter(tags, lambda t: F.lower(_value(t, "rel")).contains("canonical")), F.lit(0))
    href = _value(tag, "href")
    return F.when(href != "", href)


def fetch_first_fields(pages: DataFrame) -> DataFrame:
    """The five fields by regular expressions only, with the confidences of this family; no parser, no UDF."""
    block = F.regexp_extract("html", r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1)
    v = F.try_parse_json(block)
    direct = F.when(F.lower(F.try_variant_get(v, "$['@type']", "string")) == "product", v)
    graph = F.get(F.filter(F.try_variant_get(v, "$['@graph']", "array<variant>"), lambda n: F.lower(F.try_variant_get(n, "$['@type']", "string")).contains("product")), F.lit(0))
    node = F.coalesce(direct, graph)
    rows = pages.select(
        "page_id", "url", "html", _first(r"(?is)<title[^>]*>(.*?)</title>").alias("t"), _first(r"(?is)<h1[^>]*>(.*?)</h1>").alias("h1"), _meta("property", "og:title").alias("og_title"), _meta("property", "og:description").alias("og_description"),
        _meta("property", "og:url").alias("og_url"), _meta("name", "twitter:title").alias("tw_title"), _meta("name", "twitter:description").alias("tw_description"), _meta("name", "description", last=False).alias("meta"), _canonical().alias("canonical"), node.alias("n"),
    )
    rows = rows.withColumn("ld_name", clean_text(F.try_variant_get("n", "$.name", "string"))).withColumn("ld_description", clean_text(F.try_variant_get("n", "$.description", "string")))
    c = F.col
    none = lambda w: empty_field(w, "not_found")
    return rows.select(
        "page_id", "url",
        F.coalesce(field(c("t"), "title_tag", 0.95), field(c("og_title"), "og:title", 0.9), field(c("tw_title"), "twitter:title", 0.85), field(c("ld_name"), "jsonld:Product.name", 0.95), field(c("h1"), "h1", 0.65, "Title taken from the first h1."), none("No SEO title found.")).alias("title"),
        F.coalesce(field(c("meta"), "meta_description", 0.9), field(c("og_description"), "og:description", 0.85), field(c("tw_description"), "twitter:description", 0.8), field(c("ld_description"), "jsonld:Product.description", 0.95), none("No SEO description found.")).alias("description"),
        F.coalesce(field(U.url_resolve(c("canonical"), c("url")), "canonical_link", 0.95), field(c("canonical"), "canonical_link", 0.75, "Canonical link is not a URL."), field(c("og_url"), "og:url", 0.8, "No canonical link; og:url used."), none("No canonical URL found.")).alias("canonical_url"),
        F.coalesce(field(c("ld_name"), "jsonld:Product.name", 0.95), field(c("og_title"), "og:title", 0.85), field(c("h1"), "h1", 0.7), none("No product title found.")).alias("product_title"),
        F.coalesce(field(c("ld_description"), "jsonld:Product.description", 0.95), field(c("og_description"), "og:description", 0.8), field(c("meta"), "meta_description", 0.75), none("No product description found.")).alias("product_description"),
    )


def thin_page_warnings(pages: DataFrame, final_url: Column) -> DataFrame:
    """Short pages and pages that were answered from another URL."""
    notes = F.array(F.when(F.length("html") < 5000, "small"), F.when(F.col("url") != final_url, "moved"))
    return pages.select("page_id", F.array_compact(notes).alias("warnings"))
