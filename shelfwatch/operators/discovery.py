"""Discovery of product links: domains, link lists, unions of candidates, and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import urls as U
from ..sources.selectors import PAGE
from ..session import bucketed, stored

# Path patterns of collection pages.
COLLECTION_PATHS = r"(?i)/(?:collections|category|categories|shop)(?:/|$)"


def url_domain_allowed(df: DataFrame, domains: DataFrame, host: Column) -> DataFrame:
    """Rows whose host is a listed domain or lies under one; private hosts never.

    Each host is looked up by all its suffixes, so the match is an equi-join and not a nested loop.
    """
    parts = F.split(F.col("_host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    rows = df.withColumn("_host", host).where("_host is not null").where(~U.url_is_private_host(F.col("_host")))
    hosts = rows.select("_host").distinct().select("_host", F.explode(suffixes).alias("domain"))
    allowed = hosts.join(domains.select(F.lower("domain").alias("domain")), "domain", "left_semi").select("_host").distinct()
    return rows.join(allowed, "_host", "left_semi").drop("_host")


def page_links(anchors: DataFrame, cap: int | None = None, product_only: bool = False) -> DataFrame:
    """(page_id, url, ord, href) -> each page's distinct links on its own host, in order of first appearance."""
    target = U.product_url_normalize_keep_prefix(F.col("href"), F.col("url")) if product_only else U.url_resolve(F.col("href"), F.col("url"))
    found = anchors.withColumn("link", target).where((U.host(F.col("link")) == U.host(F.col("url"))))
    first = found.groupBy("page_id", "link").agg(F.min("ord").alias("ord"))
    ranked = first.withColumn("nth", F.row_number().over(Window.partitionBy("page_id").orderBy("ord")))
    return ranked if cap is None else ranked.where(F.col("nth") <= cap)


def is_collection(path: Column, has_product: Column, links: Column) -> Column:
    """A product page with product data is none; else the path, or more than one product link, tells."""
    like = path.rlike(COLLECTION_PATHS)
    return F.when(has_product & (path.rlike("(?i)/products/") | ~like), False).otherwise(like | (links > 1))


def candidate_union(cap: int, **sources: DataFrame) -> DataFrame:
    """(origin, url, ord) of each source -> distinct URLs of an origin, earlier sources first, ``cap`` at most."""
    rows = None
    for k, (name, df) in enumerate(sources.items()):
        own = df.select("origin", "url", F.lit(k).alias("_tier"), F.lit(name).alias("source"), "ord")
        rows = own if rows is None else rows.unionByName(own)
    first = rows.groupBy("origin", "url").agg(F.min(F.struct("_tier", "ord", "source")).alias("m"))
    ranked = first.withColumn("nth", F.row_number().over(Window.partitionBy("origin").orderBy("m", "url")))
    return ranked.where(F.col("nth") <= cap).select("origin", "url", F.col("m.source").alias("source"), "nth")


def candidate_source_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("origin", "source").agg(F.count(F.lit(1)).alias("n"))


def collection_rollup(results: DataFrame, by: str) -> DataFrame:
    """Discovered, succeeded and failed entries of each collection."""
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("discovered"), F.count_if("success").alias("succeeded"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failed"))


def crawl_frontier(links: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """(source, target) links and (url) seeds -> (url, round) reached within the rounds, each once.

    A round joins the last frontier with the links and takes away what was visited (an anti-join). Links and visited URLs are
    stored in buckets by URL, to which each round adds its own rows: so a round shuffles its frontier and what that links to,
    whatever was visited before. The walk ends where a frontier is empty. Null ends are ignored; an empty table gives an
    empty table.
    """
    spark = links.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = spark.table(bucketed(links.select(F.col("source").alias("url"), "target").where("url is not null and target is not null"), "links", "url", buckets))
    start = stored(seeds.select("url").where("url is not null").distinct().withColumn("round", F.lit(0)), "frontier")
    visited, frontier = bucketed(start, "visited", "url", buckets), start
    for k in range(1, rounds + 1):
        step = frontier.select("url").join(edges, "url").select(F.col("target").alias("url")).repartition(buckets, "url").distinct()
        frontier = stored(step.join(spark.table(visited), "url", "left_anti").withColumn("round", F.lit(k)), "frontier")
        if frontier.isEmpty():
            break
        frontier.repartition(buckets, "url").write.mode("append").insertInto(visited)
        spark.catalog.refreshTable(visited)
    return spark.table(visited)


def next_page_url(elements: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """Elements for ``a`` and ``link`` -> (page_id, next_url) of pages with a safe next page.

    Candidates are rel=next links, anchors called next and links of pagination lists. One to the page after
    this is best; else the first that isn't a plain pagination link and keeps the path. ``visited`` (url) names
    pages that no candidate may lead to.
    """
    attr = lambda n: F.coalesce(F.element_at("attrs", n), F.lit(""))
    words = F.lower(F.concat_ws(" ", "text", attr("aria-label"), attr("rel"), attr("class")))
    control = words.rlike(r"\b(next|suivant|volgende|weiter|older|more)\b")
    named = (F.col("tag") == "a") & (attr("aria-label").rlike("(?i)next") | attr("class").rlike("(?i)next"))
    listed = (F.col("tag") == "a") & PAGE.within("pages")
    tier = F.when((attr("rel") == "next") & (F.col("tag") == "link"), 0).when((attr("rel") == "next") & (F.col("tag") == "a"), 1).when(named, 2).when(listed & control, 3).when(listed, 4)
    rows = elements.where(F.col("tag").isin("a", "link")).withColumn("tier", tier).where("tier is not null").withColumn("to", U.url_resolve(attr("href"), F.col("url")))
    rows = rows.where(U.host(F.col("to")) == U.host(F.col("url")))
    if visited is not None:
        rows = rows.join(visited.select(F.col("url").alias("to")).distinct(), "to", "left_anti")
    page = lambda u: F.coalesce(U.param(u, "page").try_cast("int"), F.lit(1))
    follows = U.param(F.col("to"), "page").try_cast("int") == page(F.col("url")) + 1
    bare = lambda u: F.regexp_replace(U.path(u), "/+$", "")
    keeps = (F.col("tier") < 4) & (bare(F.col("to")) == bare(F.col("url"))) & (F.regexp_replace("to", "#.*$", "") != F.regexp_replace("url", "#.*$", ""))
    best = F.when(F.coalesce(follows, F.lit(False)), F.struct(F.lit(0).alias("a"), "tier", "ord")).when(keeps, F.struct(F.lit(1).alias("a"), "tier", "ord"))
    return rows.withColumn("_best", best).where("_best is not null").groupBy("page_id").agg(F.min_by("to", "_best").alias("next_url"))
