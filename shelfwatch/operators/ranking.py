"""Best-seller ranks from the product links of listing pages, enriched from the catalog feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import urls as U
from ..functions.text import clean_text, srcset_urls
from ..sources.selectors import PAGE

# Handles of add-ons that are no products, and names that only look like them.
JUNK = (
    r"(?:shipping|package|parcel|order|delivery)[-_]?(?:protection|insurance|guarantee|warranty)|insurance|warranty|route[-_]?(?:insurance|protection)"
    r"|seel[-_]?protection|worry[-_]?free|(?:priority|express|rush)[-_]?(?:shipping|processing|handling|delivery)|carbon[-_]?(?:neutral|offset)"
    r"|e?[-_]?gift[-_]?card|tip|tipping|donation|round[-_]?up"
)
NOT_JUNK = r"(?:tip[-_]?toe|tulip|multi[-_]?tip)"


def junk_product_filter(handle: Column) -> Column:
    h = F.lower(handle)
    return F.coalesce(h.rlike(rf"(?:^|[-_])(?:{JUNK})s?(?:[-_]|$)") & ~h.rlike(NOT_JUNK), F.lit(False))


def drop_chrome_links(anchors: DataFrame) -> DataFrame:
    """Anchors that neither lie in page furniture nor are furniture by their own class."""
    return anchors.where(~PAGE.within("chrome"))


def grid_anchor_select(elements: DataFrame) -> DataFrame:
    """Anchors and grids of pages -> the anchors of the grid with most products, else those outside chrome, else all.

    Elements are those of ``html_elements`` for ``a``, with the list ``grid`` marked. A grid counts with two distinct products or more.
    """
    anchors = elements.where(F.col("tag") == "a").withColumn("href", F.element_at("attrs", "href")).where("href is not null")
    clean = drop_chrome_links(anchors)
    handle = F.lower(F.regexp_extract("href", U.PRODUCT, 1))
    grids = elements.where(PAGE.marked("grid")).select(F.col("page_id").alias("grid_page"), F.col("ord").alias("grid"), F.col("last").alias("grid_last"))
    holds = (F.col("page_id") == F.col("grid_page")) & (F.col("ord") > F.col("grid")) & (F.col("ord") <= F.col("grid_last"))
    linked = clean.select("page_id", "ord", handle.alias("h")).where("h <> ''")
    sizes = linked.join(grids, holds).groupBy("page_id", "grid", "grid_last").agg(F.count_distinct("h").alias("n")).where("n >= 2")
    best = sizes.groupBy("page_id").agg(F.min_by(F.struct("grid", "grid_last"), F.struct(-F.col("n"), F.col("grid"))).alias("best"))
    placed = clean.join(best, "page_id", "left")
    chosen = placed.where(F.col("best").isNull() | (F.col("ord") > F.col("best.grid")) & (F.col("ord") <= F.col("best.grid_last"))).drop("best")
    bare = anchors.join(clean.select("page_id").distinct(), "page_id", "left_anti")
    return chosen.unionByName(bare)


def card_fields(elements: DataFrame) -> DataFrame:
    """Elements of pages -> for each anchor (page_id, ord) its card's title and image.

    Elements are those of ``html_elements`` for ``a`` and ``img``, with the lists ``card``, ``heading`` and ``product title`` marked. Titles: the
    link's own attributes, the alternative text of its first image, the first data and heading of the card (of whatever
    tag), the link's text. Images: the link's first, else the card's. What lies first inside an element is what follows it,
    if its number isn't over the element's last: one pass over a page, from its end, finds all.
    """
    attr = lambda n: clean_text(F.element_at("attrs", n))
    src = F.coalesce(attr("src"), attr("data-src"), attr("data-original"), F.get(srcset_urls(attr("srcset")), F.lit(0)), F.get(srcset_urls(attr("data-srcset")), F.lit(0)))
    follows = Window.partitionBy("page_id").orderBy(F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, -1)
    nearest = lambda found, *fields: F.last(F.when(found, F.struct(F.col("ord").alias("at"), *fields)), ignorenulls=True).over(follows)
    rows = elements.select(
        "page_id",
        "url",
        "ord",
        "last",
        "tag",
        F.coalesce(PAGE.closest("card"), F.col("ord")).alias("card"),
        F.coalesce(attr("data-product-title"), attr("aria-label"), attr("title")).alias("own"),
        F.when(F.col("tag") == "a", clean_text(F.col("text"))).alias("said"),
        nearest(F.col("tag") == "img", attr("alt").alias("alt"), src.alias("src")).alias("image"),
        nearest(PAGE.marked("product title"), attr("data-product-title").alias("said")).alias("data"),
        nearest(PAGE.marked("heading"), clean_text(F.col("text")).alias("said")).alias("heading"),
    )
    within = lambda found, field: F.when(F.col(f"{found}.at") <= F.col("last"), F.col(f"{found}.{field}"))
    links = rows.where(F.col("tag") == "a").select("page_id", "url", "ord", "card", "own", "said", within("image", "alt").alias("alt"), within("image", "src").alias("link_src"))
    cards = rows.select("page_id", F.col("ord").alias("card"), within("data", "said").alias("data"), within("heading", "said").alias("heading"), within("image", "src").alias("card_src"))
    found = links.join(cards, ["page_id", "card"])
    image = F.coalesce(U.url_resolve(F.col("link_src"), F.col("url")), U.url_resolve(F.col("card_src"), F.col("url")))
    return found.select("page_id", "ord", F.coalesce("own", "alt", "data", "heading", "said").alias("title"), image.alias("image_url"))


# Fixed value: what stands behind the last separator of a title.
SITE = r"[|\-–—]\s*([^|\-–—]{2,40})\s*$"


def site_name(og: Column, title: Column) -> Column:
    """og:site_name, else what stands behind the last separator of the title (2 to 40 characters)."""
    tail = F.trim(F.regexp_extract(title, SITE, 1))
    return F.coalesce(clean_text(og), F.when(tail != "", tail))


def strip_site_suffix(title: Column, site: Column) -> Column:
    """The title without a closing separator and the site's name; never empty. The name is compared, not a pattern."""
    t = F.rtrim(title)
    ends = F.lower(F.right(t, F.char_length(site))) == F.lower(site)
    left = F.rtrim(F.left(t, F.char_length(t) - F.char_length(site)))
    cut = F.trim(F.regexp_replace(left, r"\s*[|\-–—]$", ""))
    return F.when(ends & left.rlike(r"[|\-–—]$") & (cut != ""), cut).otherwise(title)


def rank_assign(anchors: DataFrame, cap: int) -> DataFrame:
    """(listing_key, page_no, ord, product_key, handle, title, image_url) -> ranked products of each listing.

    The rank is the order of first appearance without junk. Later links of a product fill what is missing, but
    nothing behind the link that fills the cap is read.
    """
    good = anchors.where(F.col("product_key").isNotNull() & ~junk_product_filter(F.col("handle"))).withColumn("at", F.struct("page_no", "ord"))
    first = good.groupBy("listing_key", "product_key").agg(F.min("at").alias("first_at"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("listing_key").orderBy("first_at", "product_key"))).where(F.col("rank") <= cap)
    last = ranked.where(F.col("rank") == cap).select("listing_key", F.col("first_at").alias("last_at"))
    seen = good.join(last, "listing_key", "left").where(F.col("last_at").isNull() | (F.col("at") <= F.col("last_at")))
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    filled = seen.groupBy("listing_key", "product_key").agg(known("handle"), known("title"), known("image_url"))
    return ranked.select("listing_key", "product_key", "rank").join(filled, ["listing_key", "product_key"])


def barren_page_stop(anchors: DataFrame) -> DataFrame:
    """The anchors up to and with the first page of a listing that shows no new product."""
    first = anchors.groupBy("listing_key", "product_key").agg(F.min("page_no").alias("page_no"))
    new = first.groupBy("listing_key", "page_no").agg(F.count(F.lit(1)).alias("new"))
    pages = anchors.select("listing_key", "page_no").distinct().join(new, ["listing_key", "page_no"], "left")
    stop = pages.where("new is null").groupBy("listing_key").agg(F.min("page_no").alias("stop"))
    return anchors.join(stop, "listing_key", "left").where(F.col("stop").isNull() | (F.col("page_no") <= F.col("stop"))).drop("stop")


def payload_rank_fallback(items: DataFrame, payload: DataFrame) -> DataFrame:
    """The ranked items, and for listings without any those of the event payload."""
    rest = payload.join(items.select("listing_key").distinct(), "listing_key", "left_anti")
    return items.unionByName(rest.select(*items.columns))


def feed_rank(feed: DataFrame, cap: int) -> DataFrame:
    """Ranks by feed position without junk; the SEO title is the title."""
    good = feed.where(~junk_product_filter(F.col("handle")))
    rank = F.row_number().over(Window.partitionBy("listing_key").orderBy("position"))
    return good.withColumn("rank", rank).where(F.col("rank") <= cap).withColumn("title_seo", F.col("title"))


def enrich_from_feed(items: DataFrame, feed: DataFrame) -> DataFrame:
    """Fill titles, images and ids of ranked items from the feed, matched by lower-cased handle.

    The feed's title and id come first, the page's SEO title and image do. A handle that the feed has twice
    counts once, at its last position.
    """
    f = feed.where("handle is not null").groupBy(F.lower("handle").alias("_h")).agg(*[F.max_by(c, "position").alias(f"_{c}") for c in ("title", "image_url", "product_id")])
    rows = items.withColumn("_h", F.lower("handle")).join(f, "_h", "left")
    hit = F.col("_title").isNotNull() | F.col("_product_id").isNotNull()
    made = {
        "title_seo": F.coalesce("title_seo", "_title", "title"), "title": F.coalesce("_title", "title"), "image_url": F.coalesce("image_url", "_image_url"),
        "product_id": F.coalesce("_product_id", "product_id"), "source": F.when(hit, "both").otherwise(F.col("source")),
    }
    return rows.withColumns(made).select(*items.columns)


def enrich_seo_title(items: DataFrame, page_titles: DataFrame) -> DataFrame:
    """(…, url, title_seo) and (url, page_title, warning) -> items whose SEO title is the product page's, where known."""
    one = page_titles.groupBy("url").agg(F.max("page_title").alias("_t"))
    rows = items.join(one, "url", "left")
    return rows.withColumn("enriched", F.col("_t").isNotNull()).withColumn("title_seo", F.coalesce("_t", "title_seo")).drop("_t")
