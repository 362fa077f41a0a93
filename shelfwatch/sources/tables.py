"""Readers of stored feeds, product documents, sitemaps, fetch logs, images and event payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import urls as U
from ..functions.text import clean_text


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def scan_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_fetch_log(log: DataFrame) -> DataFrame:
    """Responses with the body kept only where the answer was good."""
    return log.withColumn("body", F.when(F.col("status").between(200, 299), F.col("body")))


def scan_image_files(spark: SparkSession, path: str, max_bytes: int = 15 * 1024 * 1024) -> DataFrame:
    """Files under a path as (path, bytes, content); larger ones are left out before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= max_bytes).select("path", F.col("length").alias("bytes"), "content")


def scan_catalog_feed(docs: DataFrame, cap: int | None = None, page_size: int = 250) -> DataFrame:
    """(listing_key, page_no, body) feed pages -> products with their position over the pages, each handle once.

    Pages after the first that isn't full are not part of the feed. Entries without a handle are left out.
    """
    entry = "struct<id:string,handle:string,title:string,image:string>"
    rows = docs.select("listing_key", "page_no", F.from_json("body", f"struct<products:array<{entry}>>").alias("b"))
    rows = rows.withColumn("n", F.coalesce(F.size("b.products"), F.lit(0)))
    short = Window.partitionBy("listing_key").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_over", F.max(F.col("n") < page_size).over(short)).where("_over is null or not _over")
    items = rows.select("listing_key", "page_no", F.posexplode("b.products").alias("at", "p")).where("trim(p.handle) <> ''")
    key = F.concat(F.lit("handle:"), F.lower(F.trim("p.handle")))
    first = items.groupBy("listing_key", key.alias("product_key")).agg(F.min_by("p", F.struct("page_no", "at")).alias("p"), F.min(F.struct("page_no", "at")).alias("where"))
    ranked = first.withColumn("position", F.row_number().over(Window.partitionBy("listing_key").orderBy("where")))
    ranked = ranked if cap is None else ranked.where(F.col("position") <= cap)
    return ranked.select("listing_key", "product_key", "position", F.trim("p.handle").alias("handle"), F.trim("p.title").alias("title"), F.col("p.id").alias("product_id"), F.col("p.image").alias("image_url"))


def _image(v: Column, path: str) -> Column:
    """An image given as a string or as an object with src or url."""
    get = lambda p: F.try_variant_get(v, p, "string")
    plain = F.when(~F.coalesce(get(path), F.lit("{")).startswith("{"), get(path))
    return F.coalesce(*[F.when(F.trim(x) != "", F.trim(x)) for x in (get(f"{path}.src"), get(f"{path}.url"), plain)])


def product_images_from_json(product: Column, most: int = 30) -> Column:
    """Featured image, image and image list of a product (variant), in order, each once."""
    listed = F.transform(F.coalesce(F.try_variant_get(product, "$.images", "array<variant>"), F.array().cast("array<variant>")), lambda v: _image(v, "$"))
    both = F.concat(F.array(_image(product, "$.featured_image"), _image(product, "$.image")), listed)
    return F.slice(F.array_distinct(F.filter(both, lambda u: u.isNotNull())), 1, most)


def scan_product_json(docs: DataFrame) -> DataFrame:
    """(doc, url, body) with one product, bare or wrapped -> its normalised fields; nothing for broken JSON."""
    v = F.try_parse_json("body")
    rows = docs.select("doc", "url", F.coalesce(F.try_variant_get(v, "$.product", "variant"), v).alias("p")).where("p is not null")
    get = lambda path: F.try_variant_get("p", path, "string")
    description = F.coalesce(clean_text(get("$.body_html"), True), clean_text(get("$.description"), True))
    return rows.select(
        "doc", "url", get("$.id").alias("product_id"), get("$.handle").alias("handle"), clean_text(get("$.title")).alias("title"), description.alias("description"),
        clean_text(get("$.vendor")).alias("vendor"), clean_text(F.coalesce(get("$.product_type"), get("$.type"))).alias("product_type"),
        F.coalesce(F.size(F.try_variant_get("p", "$.variants", "array<variant>")), F.lit(0)).alias("variants"), product_images_from_json(F.col("p")).alias("images"),
    )


def scan_sitemaps(docs: DataFrame, max_nested: int = 5) -> DataFrame:
    """(sitemap_url, origin, body) -> product URLs of each origin's own host, from sitemaps and one hop of nested ones.

    An index leads to ``max_nested`` product sitemaps at most, in the order in which it lists them.
    """
    locs = docs.select("sitemap_url", "origin", F.posexplode(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("ord", "loc"))
    own = locs.where(U.host(F.col("loc")) == U.host(F.col("origin")))
    nested = own.where(F.col("loc").rlike(r"(?i)sitemap[^/]*product[^/]*\.xml"))
    nested = nested.withColumn("nth", F.row_number().over(Window.partitionBy("sitemap_url").orderBy("ord"))).where(F.col("nth") <= max_nested)
    products = own.where(F.col("loc").rlike("(?i)/products/[^/]+"))
    hop = nested.select("origin", F.col("loc").alias("sitemap_url")).distinct().join(products.select("sitemap_url", "loc"), "sitemap_url")
    return products.select("origin", "loc").unionByName(hop.select("origin", "loc")).distinct()


def parse_collection_event_payload(scripts: DataFrame) -> DataFrame:
    """(page_id, payload) with [[name, data], ...] -> the variants of the first collection view that has a list of them.

    Gives (page_id, pos, product_id, title, product_url, image).
    """
    pairs = F.try_variant_get(F.try_parse_json("payload"), "$", "array<variant>")
    lists = F.transform(
        F.filter(pairs, lambda e: F.try_variant_get(e, "$[0]", "string") == "collection_viewed"),
        lambda e: F.try_variant_get(e, "$[1].collection.productVariants", "array<variant>"),
    )
    first = F.get(F.filter(lists, lambda x: x.isNotNull()), F.lit(0))
    rows = scripts.select("page_id", F.posexplode(first).alias("pos", "v"))
    get = lambda path: F.try_variant_get("v", path, "string")
    return rows.select("page_id", "pos", get("$.product.id").alias("product_id"), F.trim(get("$.product.title")).alias("title"), F.trim(get("$.product.url")).alias("product_url"), get("$.image.src").alias("image"))
