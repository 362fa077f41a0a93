"""Queries that write what they make, or stream over it, and read it back from the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import urls as U
from ..operators import extract as E
from ..operators.snapshots import unique_items
from ..session import freed_shuffles, scratch, shared_folder, stored
from ..sources import sinks
from ..sources.tables import scan_image_files, scan_usage
from ..streaming import streams
from .extract_queries import DESCRIPTION, FACTS, PRODUCT_TITLE, TITLE, WARNED, elements, fields
from .registry import ORACLE_SQL, register
from .snapshot_queries import CHANGES
from .stream_queries import PROGRESS, stamped
from .url_text import _host
from .views import view_over

def seo_json(pages: DataFrame) -> DataFrame:
    folder = shared_folder(pages.sparkSession, "seo")
    sinks.write_seo_json(fields(pages).withColumn("domain", U.host(F.col("url"))), folder)
    kind = "page_id long, domain string, title struct<value:string,source:string>"
    return pages.sparkSession.read.schema(kind).json(folder).select("page_id", "domain", "title.value", "title.source")


def data_json(pages: DataFrame) -> DataFrame:
    folder = shared_folder(pages.sparkSession, "data")
    whole = fields(pages).withColumn("domain", U.host(F.col("url")))
    sinks.write_data_json(whole, folder)
    back = pages.sparkSession.read.schema(whole.schema).json(folder)
    return back.select("page_id", "domain", F.col("title.value").alias("title"), F.col("description.value").alias("description"), "product_title.source", "empty", F.size("warnings").alias("warned"))


def raw(pages: DataFrame) -> DataFrame:
    folder, spark = shared_folder(pages.sparkSession, "raw"), pages.sparkSession
    found = elements(pages)
    metas = E.meta_tags(found).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("ord", "name", "property", "content"))).alias("metas"))
    nodes = E.jsonld_nodes(found).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("jsonld"))
    metadata = pages.select("page_id", U.host(F.col("url")).alias("domain")).join(metas, "page_id", "left").join(nodes, "page_id", "left")
    sinks.write_raw(pages.select("page_id", "html"), metadata, folder)
    both = spark.read.parquet(f"{folder}/html").join(spark.read.parquet(f"{folder}/metadata"), "page_id")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return both.select("page_id", "domain", F.char_length("html").alias("chars"), size("metas").alias("metas"), size("jsonld").alias("nodes"), F.concat_ws("|", F.transform("metas", lambda m: m["content"])).alias("contents"))


def usage_files(usage: DataFrame) -> DataFrame:
    folder = shared_folder(usage.sparkSession, "usage")
    usage.write.parquet(folder)
    return scan_usage(usage.sparkSession, folder).where("endpoint = 'view'").select("event_id", "user_id", "ts", "units", "billable")


def image_files(documents: DataFrame) -> DataFrame:
    """Documents as files by id modulo 40, found again as (file, bytes)."""
    folder = shared_folder(documents.sparkSession, "images")
    rows = documents.select((F.col("doc_id") % 40).alias("file"), "text")
    rows.repartition("file").write.partitionBy("file").text(folder)
    found = scan_image_files(documents.sparkSession, folder, 1 << 40)
    return found.groupBy(F.regexp_extract("path", "file=([0-9]+)", 1).cast("long").alias("file")).agg(F.sum("bytes").alias("bytes"), F.sum(F.length("content")).alias("read"))


def snapshots(sales: DataFrame) -> DataFrame:
    """Two runs are appended: the items, and the same again further down, which ``unique_items`` leaves out.

    Sales are dealt by listing and month while they are narrow, so that ranking them deals out nothing. Items are worked out and stored
    once, and the headers counted from there. A run's items are dealt by ranges of snapshots, which begin with their listing, before they
    are doubled, so neither ``unique_items`` nor the writer deals them out. What is stored on the way goes when both runs are written.
    """
    spark = sales.sparkSession
    folder = shared_folder(spark, "snapshots")
    with scratch(spark), freed_shuffles(spark):
        items = stored(view_over(spark, "rank_items", sales=sales.repartition("listing_key", "ym")), "items")
        headers = stored(view_over(spark, "rank_snapshots", rank_items=items), "headers")
        for part in (headers.where("checked_at < timestamp'1998-01-01'"), headers.where("checked_at >= timestamp'1998-01-01'")):
            own = items.join(part.select("snapshot_id"), "snapshot_id", "left_semi").repartitionByRange("snapshot_id")
            sinks.append_snapshot(part, unique_items(own.withColumn("rank", F.explode(F.array("rank", F.col("rank") + 100)))), folder, dealt=True)
    headers, back = sinks.read_snapshots(spark, folder)
    return back.join(headers.select("snapshot_id", "item_count"), "snapshot_id").select("snapshot_id", "product_key", "rank", "item_count")


def _as_stream(df: DataFrame, folder: str) -> DataFrame:
    df.write.parquet(f"{folder}/in")
    return df.sparkSession.readStream.schema(df.schema).parquet(f"{folder}/in")


def updated(df: DataFrame, name: str, make: Callable[[DataFrame], DataFrame], *keys: str) -> DataFrame:
    """The batch as a stream of files, through a streaming operator, with the last row of each key."""
    folder = shared_folder(df.sparkSession, name)
    streams.write_updates(make(_as_stream(df, folder)), f"{folder}/out", f"{folder}/state").awaitTermination()
    return streams.latest(df.sparkSession.read.parquet(f"{folder}/out"), *keys)


def rank_changes_stream(items: DataFrame) -> DataFrame:
    """The history comes year by year, each year in any order."""
    source = items.select("listing_key", "snapshot_id", F.col("checked_at").cast("timestamp").alias("checked_at"), "rank", "product_key")
    folder, spark = shared_folder(items.sparkSession, "ranks"), items.sparkSession
    source = stored(source, "ranks")
    for year in [r.y for r in source.select(F.year("checked_at").alias("y")).distinct().orderBy("y").collect()]:
        source.where(F.year("checked_at") == year).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    streams.write_updates(streams.rank_diff_stream(stream), f"{folder}/out", f"{folder}/state").awaitTermination()
    return streams.latest(spark.read.parquet(f"{folder}/out"), "listing_key", "snapshot_id", "product_key").where("direction is not null")


def tails_stream(events: DataFrame) -> DataFrame:
    made = updated(PROGRESS(events), "tails", lambda d: streams.progress_tail_stream(d, 5), "run_id")
    rows = made.select("run_id", F.explode(F.from_json("tail", "array<array<string>>")).alias("event"))
    return rows.select("run_id", F.get("event", F.lit(0)).cast("long").alias("seq"))


def repeats_stream(ledger: DataFrame) -> DataFrame:
    """Keys once each, and every event without one; which event of a key a stream keeps is the first to come."""
    folder, spark = shared_folder(ledger.sparkSession, "repeats"), ledger.sparkSession
    kept = streams.idempotent_events(_as_stream(ledger, folder), "provider_order_id", "4000 days")
    query = kept.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    return rows.select("provider_order_id", F.when(F.col("provider_order_id").isNull(), F.col("event_id")).alias("event_id"))


def page_stream(pages: DataFrame) -> DataFrame:
    folder, spark = shared_folder(pages.sparkSession, "pages"), pages.sparkSession
    pick = lambda d: fields(d).select("page_id", "title.value", "title.source")
    streams.page_extract_stream(_as_stream(pages, folder), pick, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("page_id", "value", "source")


register("write_seo_json", ("page_seo",), seo_json, f"WITH {FACTS} SELECT page_id, {_host('url')} AS domain, value, source FROM (SELECT page_id, url, {TITLE} FROM f)")
_JOINED = f"""(SELECT page_id, {_host("url")} AS domain, value AS title FROM (SELECT page_id, url, {TITLE} FROM f)) t
JOIN (SELECT page_id, value AS description FROM (SELECT page_id, {DESCRIPTION} FROM f)) d USING (page_id)
JOIN (SELECT page_id, source FROM (SELECT page_id, {PRODUCT_TITLE} FROM f)) p USING (page_id)
JOIN (SELECT page_id, coalesce(ld_name, og_title, h1) IS NULL AND coalesce(ld_description, og_description, meta) IS NULL AND n_structured = 0 AS empty FROM f) e USING (page_id)
JOIN (SELECT page_id, CAST(sum(warned) AS INT) AS warned FROM ({WARNED}) GROUP BY page_id) w USING (page_id)"""
register("write_data_json", ("page_seo",), data_json, f"WITH {FACTS} SELECT page_id, domain, title, description, source, empty, warned FROM {_JOINED}")
register("write_raw", ("page_seo",), raw, f"""
WITH m AS (SELECT page_id, {_host("url")} AS domain, CAST(length(html) AS INT) AS chars, regexp_extract_all(html, '<meta [^>]*content="([^"]*)"[^>]*>', 1) AS found FROM page_seo)
SELECT page_id, domain, chars, CAST(len(found) AS INT) AS metas, CASE page_id % 8 WHEN 5 THEN 1 WHEN 6 THEN 3 ELSE 0 END AS nodes, array_to_string(found, '|') AS contents FROM m""")
register("scan_usage", ("usage_events",), usage_files, "SELECT event_id, user_id, ts, units, billable FROM usage_events WHERE endpoint = 'view'")
register("scan_image_files", ("documents",), image_files, "SELECT doc_id % 40 AS file, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS read FROM documents GROUP BY 1")
register("append_snapshot", ("rank_snapshots", "rank_items", "sales"), lambda h, i, s: snapshots(s), "SELECT snapshot_id, product_key, min(rank) AS rank, max(item_count) AS item_count FROM rank_items JOIN rank_snapshots USING (snapshot_id) GROUP BY snapshot_id, product_key")
register("rank_diff_stream", ("rank_items", "rank_snapshots"), lambda i, h: rank_changes_stream(i), f"WITH {CHANGES} SELECT pairs.listing_key, snapshot_id, product_key, CAST(previous_rank AS BIGINT) AS previous_rank, CAST(current_rank AS BIGINT) AS current_rank, direction FROM changes JOIN pairs USING (snapshot_id)")
register("page_extract_stream", ("page_seo",), page_stream, f"WITH {FACTS} SELECT page_id, value, source FROM (SELECT page_id, {TITLE} FROM f)")

# The other streaming operators over streams of files; each gives what its batch form gives.
register("progress_tail_stream", ("events",), tails_stream)
register("rate_limit_windows_stream", ("usage_events",), lambda e: updated(stamped(e), "minutes", lambda d: streams.rate_limit_windows(d, 1), "minute", "user_id"))
register("usage_stream_daily_stream", ("usage_events",), lambda e: updated(stamped(e), "days", streams.usage_stream_daily, "user_id", "day"))
register("quota_stream_sliding", ("usage_events",), lambda e: updated(stamped(e), "quota", lambda d: streams.quota_stream(d, 5, "1 hour"), "user_id", "until"))
register("idempotent_events_stream", ("credit_ledger",), lambda d: repeats_stream(d.withColumn("ts", F.col("created_at").cast("timestamp"))), "SELECT DISTINCT provider_order_id, CASE WHEN provider_order_id IS NULL THEN event_id END AS event_id FROM credit_ledger")
for _stream, _batch in (("progress_tail_stream", "progress_tail"), ("rate_limit_windows_stream", "rate_limit_windows"), ("usage_stream_daily_stream", "usage_stream_daily"), ("quota_stream_sliding", "quota_stream")):
    ORACLE_SQL[_stream] = ORACLE_SQL[_batch]
