"""Outcomes of fetches: blocked, redirected, failed, and which attempt or source to use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# What an interstitial page says near its top.
BLOCK_MARKERS = (
    "just a moment", "cf-browser-verification", "cf-challenge", "/cdn-cgi/challenge-platform", "attention required",
    "verifying your connection", "connection needs to be verified", "enable javascript and cookies to continue", "verifying you are human",
)


def blocked_response(status: Column, html: Column, server: Column, mitigated: Column) -> Column:
    """A mitigation header, a blocking status, or the text of an interstitial in the first 4000 characters."""
    head = F.lower(F.substring(F.coalesce(html, F.lit("")), 1, 4000))
    says = head.contains(BLOCK_MARKERS[0])
    for marker in BLOCK_MARKERS[1:]:
        says = says | head.contains(marker)
    says = says | (head.contains("cloudflare") & head.contains("captcha")) | ((F.lower(server) == "cloudflare") & head.contains("ray id"))
    code = status.isin(403, 429, 430, 503) | status.between(520, 530)
    return F.coalesce(F.trim(mitigated) != "", F.lit(False)) | F.coalesce(code, F.lit(False)) | F.coalesce(says, F.lit(False))


def fetch_outcome(log: DataFrame) -> DataFrame:
    """Add ``outcome``: redirect, blocked, store_error (a plain 5xx), http_error or ok."""
    c = F.col
    good = c("status").between(200, 299)
    blocked = blocked_response(c("status"), F.when(good, c("body")), c("server"), c("mitigated"))
    outcome = F.when(c("status").between(300, 399), "redirect").when(blocked, "blocked").when(good, "ok").when(c("status") >= 500, "store_error").otherwise("http_error")
    return log.withColumn("outcome", outcome)


def best_attempt(log: DataFrame) -> DataFrame:
    """Of each page: the proxied answer if good; the direct one if that was blocked and this is good; else the first."""
    rows = fetch_outcome(log)
    by = Window.partitionBy("page_id")
    proxied = F.max(F.when(F.col("attempt") == "proxy", F.col("outcome"))).over(by)
    rank = F.when((F.col("attempt") == "proxy") & (F.col("outcome") == "ok"), 0).when((F.col("attempt") == "direct") & (F.col("outcome") == "ok") & (proxied == "blocked"), 1).when(F.col("attempt") == "proxy", 2).otherwise(3)
    order = by.orderBy("_rank", "attempt")
    return rows.withColumn("_rank", rank).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_rank")


def definitive_failure(status: Column) -> Column:
    """Answers that another attempt won't change."""
    return status.between(500, 599) | (status == 404)


def error_summary(results: DataFrame) -> DataFrame:
    """Failures by error code with the status that is answered for it."""
    answered = F.when(F.col("code").isin("INVALID_URL", "DOMAIN_NOT_ALLOWED"), 400).when(F.col("code").isin("blocked", "store_error", "http_error", "redirect"), 502).otherwise(500)
    return results.groupBy("code").agg(F.count(F.lit(1)).alias("n")).withColumn("answered", answered)


def source_tier_pick(tiers: DataFrame, order: tuple[str, ...] = ("fetched_html", "rendered_html", "feed")) -> DataFrame:
    """(listing_key, tier, rank, product_key, has_sort_by) -> the items of each listing's first tier that has any.

    ``order_reliable`` is false where a sort order was asked for and only the feed answered.
    """
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("tier"))
    found = tiers.where(rank > 0)
    first = found.groupBy("listing_key").agg(F.min(rank).alias("_rank"), F.max("has_sort_by").alias("_sorted"), F.count_if(F.col("tier") == "feed").alias("feed_items"))
    rows = found.join(first, "listing_key").where(rank == F.col("_rank"))
    feed_only = F.col("tier") == "feed"
    used = F.when(feed_only, "feed").when(F.col("feed_items") > 0, "both").otherwise("html")
    return rows.select("listing_key", "tier", "rank", "product_key", used.alias("source_used"), (~(feed_only & F.col("_sorted"))).alias("order_reliable"))


def order_warning(has_sort: Column, html_items: Column, feed_items: Column) -> Column:
    return F.when(has_sort & (html_items == 0) & (feed_items > 0), "The feed can't honour the requested order; ranks follow its own.")
