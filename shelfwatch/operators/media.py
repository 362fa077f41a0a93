"""Product images: discovery in pages, exact and near duplicates, and which ones to keep."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import urls as U
from ..functions.hashing import edges_of, hamming, ssim_of
from ..functions.text import srcset_urls
from ..session import stored
from ..sources.selectors import PAGE, SCOPE_NAMES

# Parts of URLs of assets that show no product.
ASSET_PARTS = (
    r"\.svg(?:$|\?)", "sprite", "logo", r"\bicon\b", "favicon", "badge", r"\bflag\b", "payment", "pixel", "tracking", "placeholder", "spinner", "loader",
    "1x1", "avatar", "profile", "newsletter", "banner", "hero", "/brand/", "/brands/", "trust", "review-star", "star-rating", "social", "share", "cart",
    "/cms/", "arrow", "chevron", "checkmark", "check-mark",
)
# Fixed value: what only stands in templates.
PLACEHOLDER = r"(?i)[<>]|%3c|%3e|\{\{|\}\}|\$\{"
TIERS = ("jsonld", "og", "img", "picture", "css", "preload")
#: The largest distance and the least similarities of one group; images kept of a page; the least size and the largest ratio.
DOUBT = 0.08
#: How many other hashes one may meet by chance before longer keys are taken.
CANDIDATES = 16
#: The same where a meeting is only a comparison, and a key a shuffled row.
MEETINGS = 4096
DISTANCE, SSIM, EDGES, MOST_IMAGES, LEAST_SIDE, MOST_RATIO = 6, 0.88, 0.9, 30, 300, 3.0


def excluded_asset(u: Column) -> Column:
    return F.coalesce(F.lower(u).rlike("|".join(ASSET_PARTS)), F.lit(False))


def template_placeholder(raw: Column) -> Column:
    """Markup that a template engine should have filled in."""
    return F.coalesce(raw.rlike(PLACEHOLDER), F.lit(False))


def excluded_section() -> Column:
    """The element or some ancestor is a section whose images aren't the product's."""
    return PAGE.within("excluded")


def product_scope(elements: DataFrame) -> DataFrame:
    """(page_id, scope, scope_last): the place of each page's best product container, whether it holds images or not.

    Elements are those of ``html_elements`` with the lists ``SCOPE_NAMES`` marked.
    """
    rank = F.coalesce(*[F.when(PAGE.marked(name), k) for k, name in enumerate(SCOPE_NAMES)])
    rows = elements.select("page_id", "ord", "last", rank.alias("r")).where("r is not null")
    best = rows.groupBy("page_id").agg(F.min_by(F.struct("ord", "last"), F.struct("r", "ord")).alias("best"))
    return best.select("page_id", F.col("best.ord").alias("scope"), F.col("best.last").alias("scope_last"))


#: What ``dom_images`` and ``product_scope`` need of a page.
IMAGE_TAGS, IMAGE_LISTS = ("img", "source", "link"), ("picture source", "background", *SCOPE_NAMES)
# Fixed value: the first address of a background, up to the quote that opened it.
BACKGROUND = r"""(?i)background(?:-image)?\s*:\s*[^;]*url\((['"]?)(.*?)\1\)"""


def dom_images(elements: DataFrame) -> DataFrame:
    """Images inside a page's product scope, or of the page if it has none: (page_id, url, tier, ord, at, raw, source, alt).

    Elements are those of ``html_elements`` for ``IMAGE_TAGS``, with ``IMAGE_LISTS`` marked.
    """
    attr = lambda n: F.element_at("attrs", n)
    scoped = elements.join(product_scope(elements), "page_id", "left")
    inside = F.col("scope").isNull() | (F.col("ord") > F.col("scope")) & (F.col("ord") <= F.col("scope_last"))
    free = inside & ~excluded_section()
    none = F.array().cast("array<struct<tier:int,raw:string,source:string>>")
    given = lambda tier, raw, source: F.struct(F.lit(tier).alias("tier"), raw.alias("raw"), F.lit(source).alias("source"))
    one = lambda tier, name, source: F.coalesce(F.when(attr(name).isNotNull(), F.array(given(tier, attr(name), source))), none)
    many = lambda tier, value, source: F.coalesce(F.transform(srcset_urls(value), lambda u: given(tier, u, source)), none)
    lazy = [one(2, n, "img" if n == "src" else n) for n in ("src", "data-src", "data-original", "data-lazy", "data-zoom-image", "data-large")]
    sets = [many(2, attr(n), n) for n in ("srcset", "data-srcset")]
    css = F.regexp_extract(F.coalesce(attr("style"), F.lit("")), BACKGROUND, 2)
    preload = (F.col("tag") == "link") & (attr("rel") == "preload") & (attr("as") == "image")
    found = F.concat(
        F.when(free & (F.col("tag") == "img"), F.concat(*lazy, *sets)).otherwise(none),
        F.when(free & PAGE.marked("picture source"), many(3, F.coalesce(attr("srcset"), attr("data-srcset")), "picture-source")).otherwise(none),
        F.when(free & PAGE.marked("background") & (css != ""), F.array(given(4, css, "css-bg"))).otherwise(none),
        F.when(preload, F.concat(one(5, "href", "preload"), many(5, attr("imagesrcset"), "preload-srcset"))).otherwise(none),
    )
    rows = scoped.select("page_id", "url", "ord", attr("alt").alias("alt"), F.posexplode(found).alias("at", "x"))
    return rows.select("page_id", "url", "x.tier", "ord", "at", "x.raw", "x.source", "alt")


def jsonld_images(nodes: DataFrame) -> DataFrame:
    """(page_id, pos, node) -> (page_id, pos, at, raw, source): the images of a node, strings or objects, alone or listed."""
    v = F.try_variant_get(F.try_parse_json("node"), "$.image", "variant")
    listed = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull(), F.array(v)))
    rows = nodes.select("page_id", "pos", F.posexplode(listed).alias("at", "v"))
    url, text = F.try_variant_get("v", "$.url", "string"), F.try_variant_get("v", "$", "string")
    plain = F.schema_of_variant("v") == "STRING"
    made = rows.select("page_id", "pos", "at", F.when(plain, text).otherwise(url).alias("raw"), F.when(plain, "jsonld").otherwise("jsonld:ImageObject").alias("source"))
    return made.where("raw is not null")


def discover_images(pages: DataFrame, jsonld: DataFrame, metas: DataFrame, dom: DataFrame, cap: int = MOST_IMAGES) -> DataFrame:
    """All tiers in order of priority -> each page's distinct usable images, ``cap`` at most (a limit of the report).

    jsonld (page_id, pos, at, raw, source), metas (page_id, ord, raw, source), dom as ``dom_images`` gives it.
    """
    urls = pages.select("page_id", "url")
    none = F.lit(None).cast("string")
    rows = jsonld.join(urls, "page_id").select("page_id", "url", F.lit(0).alias("tier"), F.col("pos").alias("ord"), "at", "raw", "source", none.alias("alt"))
    rows = rows.unionByName(metas.join(urls, "page_id").select("page_id", "url", F.lit(1).alias("tier"), "ord", F.lit(0).alias("at"), "raw", "source", none.alias("alt")))
    rows = rows.unionByName(dom.select("page_id", "url", "tier", "ord", "at", "raw", "source", "alt"))
    rows = rows.where(~template_placeholder(F.col("raw"))).withColumn("image", U.url_strip_tracking(U.url_resolve(F.col("raw"), F.col("url"))))
    rows = rows.where(F.col("image").isNotNull() & ~excluded_asset(F.col("image")))
    first = rows.groupBy("page_id", "image").agg(F.min(F.struct("tier", "ord", "at", "source", "alt")).alias("m"))
    ranked = first.withColumn("nth", F.row_number().over(Window.partitionBy("page_id").orderBy("m", "image"))).where(F.col("nth") <= cap)
    return ranked.select("page_id", "image", "nth", F.element_at(F.array(*map(F.lit, TIERS)), F.col("m.tier") + 1).alias("tier"), F.col("m.source").alias("source"), F.col("m.alt").alias("alt"))


def tier_counts(images: DataFrame) -> DataFrame:
    return images.groupBy("page_id").pivot("tier", list(TIERS)).count().fillna(0)


def fetch_first_images(pages: DataFrame, cap: int = MOST_IMAGES) -> DataFrame:
    """Open Graph images, then img sources, by regular expressions: (page_id, image, nth), in page order."""
    og = F.regexp_extract_all("html", F.lit(r"(?is)<meta\b[^>]*property=[\"']og:image[\"'][^>]*content=[\"']([^\"']+)[\"']"), 1)
    img = F.regexp_extract_all("html", F.lit(r"(?is)<img\b[^>]*\bsrc=[\"']([^\"']+)[\"']"), 1)
    found = F.transform(F.concat(og, img), lambda r: U.url_resolve(r, F.col("url")))
    kept = F.slice(F.array_distinct(F.filter(found, lambda u: u.isNotNull())), 1, cap)
    return pages.select("page_id", F.posexplode(kept).alias("nth", "image"))


def exact_dup_filter(images: DataFrame, by: str, digest: str, order: str) -> DataFrame:
    """Mark later copies within ``by`` with the first one's ``order`` in ``similar_to``."""
    first = images.groupBy(by, digest).agg(F.min(order).alias("_first"))
    rows = images.join(first, [by, digest])
    return rows.withColumn("similar_to", F.when(F.col("_first") < F.col(order), F.col("_first"))).drop("_first")


def image_downsample_features(images: DataFrame) -> DataFrame:
    """Add ``aspect``: the longer side by the shorter, null without sizes."""
    return images.withColumn("aspect", F.when((F.col("width") > 0) & (F.col("height") > 0), F.greatest(F.col("width") / F.col("height"), F.col("height") / F.col("width"))))


def quality_filter(images: DataFrame) -> DataFrame:
    """Add ``reason``: too_small, extreme_ratio or null."""
    small = (F.col("width") < LEAST_SIDE) | (F.col("height") < LEAST_SIDE)
    return image_downsample_features(images).withColumn("reason", F.when(F.coalesce(small, F.lit(False)), "too_small").when(F.col("aspect") > MOST_RATIO, "extreme_ratio"))


def leader_groups(images: DataFrame) -> DataFrame:
    """(product_id, ord, dhash, gray) -> (product_id, ord, group, ambiguous), in order, one product at a time.

    An image joins the first group whose leader is near in hash, or alike in structure and edges; else it
    leads a group of its own. It is in doubt if both likenesses to a leader that it was held against lie within DOUBT
    of their least values, even if a later group takes it. A product has the images of one page, of which
    ``discover_images`` keeps 30, so a group fits a task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        leaders, groups, doubts = [], [], []
        for h, gray in zip(pdf["dhash"], pdf["gray"], strict=True):
            doubt, chosen = False, -1
            for k, (other, image) in enumerate(leaders):
                if bin((int(h) ^ int(other)) & (2**64 - 1)).count("1") <= DISTANCE:
                    chosen = k
                    break
                alike, edges = ssim_of(gray, image), float((edges_of(gray) == edges_of(image)).mean())
                if alike >= SSIM and edges >= EDGES:
                    chosen = k
                    break
                doubt |= abs(alike - SSIM) <= DOUBT and abs(edges - EDGES) <= DOUBT
            if chosen < 0:
                leaders.append((h, np.asarray(gray, float)))
                chosen = len(leaders) - 1
            groups.append(chosen)
            doubts.append(bool(doubt))
        return pd.DataFrame({"product_id": pdf["product_id"], "ord": pdf["ord"], "group": groups, "ambiguous": doubts})

    return images.select("product_id", "ord", "dhash", "gray").groupBy("product_id").applyInPandas(run, "product_id long, ord long, group int, ambiguous boolean")


def selection_fallback(groups: DataFrame, failed: DataFrame, enabled: bool = False) -> DataFrame:
    """(product_id, mode): keep_all where under two images are usable, over half failed, or one is in doubt.

    ``groups`` has a row for each usable image; ``failed`` has (product_id, total, failed). Off unless enabled.
    """
    seen = groups.groupBy("product_id").agg(F.count(F.lit(1)).alias("usable"), F.max("ambiguous").alias("ambiguous"))
    rows = failed.join(seen, "product_id", "left")
    doubt = (F.coalesce("usable", F.lit(0)) < 2) | (F.col("failed") > 0.5 * F.col("total")) | F.coalesce("ambiguous", F.lit(False))
    return rows.select("product_id", F.when(F.lit(enabled) & doubt, "keep_all").otherwise("deduplicated").alias("mode"))


def selection_report(groups: DataFrame, modes: DataFrame) -> DataFrame:
    """(product_id, ord, kept, similar_to): the first of each group stays, or all in keep_all mode."""
    first = groups.groupBy("product_id", "group").agg(F.min("ord").alias("leader"))
    rows = groups.join(first, ["product_id", "group"]).join(modes, "product_id")
    kept = (F.col("ord") == F.col("leader")) | (F.col("mode") == "keep_all")
    return rows.select("product_id", "ord", kept.alias("kept"), F.when(~kept, F.col("leader")).alias("similar_to"))


def agreeing_bands(n: int, max_dist: int = DISTANCE, candidates: int = CANDIDATES, bits: int = 64) -> int:
    """How many bands have to agree, so that one of ``n`` random hashes meets few others: more bands make more and longer keys."""
    for k in range(2, 6):
        bands = max_dist + k
        if comb(bands, k) * n / 2 ** (bits * k / bands) <= candidates:
            return k
    return 5


def _masks(count: int, varying: int) -> list[int]:
    """The bits that vary, in ``count`` bands of about the same width."""
    places = [b for b in range(64) if varying >> b & 1]
    edges = [round(len(places) * k / count) for k in range(count + 1)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(1 << b for b in places[edges[k] : edges[k + 1]])) for k in range(count)]


def _meetings(one: DataFrame, masks: list[int], agree: int) -> DataFrame:
    """Distinct (id, hash) -> (a, b, x, y, bands): pairs of hashes x < y for every set of ``agree`` bands that they agree on.

    Never a broadcast: Spark takes the size of the rows for that of the hashes that they are made from, and a hash makes dozens
    of them. Both sides are one shuffle.
    """
    chosen = [(sum(1 << k for k in some), sum(masks[k] for k in some)) for some in combinations(range(len(masks)), agree)]
    keys = F.expr("array(" + ", ".join(f"named_struct('bands', {bands}, 'bits', {bits}L)" for bands, bits in chosen) + ")")
    rows = one.select("id", "hash", F.inline(F.transform(keys, lambda k: F.struct(k["bands"].alias("bands"), F.col("hash").bitwiseAND(k["bits"]).alias("bits")))))
    other = rows.select(F.col("id").alias("b"), F.col("hash").alias("y"), "bands", "bits")
    met = rows.select(F.col("id").alias("a"), F.col("hash").alias("x"), "bands", "bits").hint("merge").join(other.hint("merge"), ["bands", "bits"])
    return met.where("x < y")


def _counts(masks: list[int]) -> Column:
    """A pair counts where it first agrees: on the bands of this set, and up to the last of them on no others."""
    same = " + ".join(f"CASE WHEN ((x ^ y) & {m}L) = 0 THEN {1 << k} ELSE 0 END" for k, m in enumerate(masks))
    reach = F.col("bands")
    for step in (1, 2, 4, 8):
        reach = reach.bitwiseOR(F.shiftright(reach, step))
    return F.expr(same).bitwiseAND(reach) == F.col("bands")


def hash_candidates(one: DataFrame, agree: int, max_dist: int = DISTANCE, varying: int = (1 << 64) - 1) -> DataFrame:
    """Distinct (id, hash) -> (a, b, x, y): pairs of hashes x < y that agree on ``agree`` of max_dist + agree bands, each pair once."""
    masks = _masks(max_dist + agree, varying)
    return _meetings(one, masks, agree).where(_counts(masks)).select("a", "b", "x", "y")


def near_dup_pairs(hashes: DataFrame, max_dist: int = DISTANCE) -> DataFrame:
    """(id, hash) -> (a, b, distance) of all pairs of distinct hashes within ``max_dist`` bits, with a < b as hashes.

    The hash is cut into max_dist + k bands; two hashes in reach agree on k of them, so an equi-join on sets of k bands
    finds every pair without a cross join. Bits that are the same in all hashes are in no band. k follows the number of hashes, so
    that what a random hash meets stays within MEETINGS: to compare two costs far less than to shuffle one. Images that share a hash
    are one entry, named by the least id: copies make no pairs. Null hashes are in no pair; an empty table gives none.
    """
    one = stored(hashes.where("hash is not null").groupBy("hash").agg(F.min("id").alias("id")), "hashes")
    seen = one.agg(F.count(F.lit(1)).alias("n"), F.bit_or("hash").alias("some"), F.bit_and("hash").alias("all")).first()
    varying = ((seen.some or 0) ^ (seen.all or 0)) & ((1 << 64) - 1)
    agree = agreeing_bands(seen.n, max_dist, MEETINGS, varying.bit_count())
    masks = _masks(max_dist + agree, varying)
    distance = hamming(F.col("x"), F.col("y"))
    return _meetings(one, masks, agree).where(distance <= max_dist).where(_counts(masks)).select("a", "b", distance.alias("distance"))
