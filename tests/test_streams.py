"""A stream gives what its batch twin gives."""

import datetime
import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from shelfwatch.plans.views import view
from shelfwatch.streaming import streams

from .compare import rows_of


def streamed(spark, df, parts=1):
    """The rows of a batch as a stream of files."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df.coalesce(1).write.mode("overwrite").parquet(folder + "/in")
    return spark.readStream.schema(df.schema).parquet(folder + "/in")


def collected(spark, stream, mode, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def usage(spark, sf_dir):
    return view(spark, sf_dir, "usage_events").withColumn("ts", F.col("ts").cast("timestamp"))


def test_windows(spark, sf_dir):
    rows = usage(spark, sf_dir)
    for name, op in (("daily", streams.usage_stream_daily), ("minute", lambda d: streams.rate_limit_windows(d, 1)), ("quota", lambda d: streams.quota_stream(d, 5, "1 hour"))):
        assert rows_of(collected(spark, op(streamed(spark, rows)), "complete", name)) == rows_of(op(rows))


def test_progress_tail(spark):
    rows = [(f"r{k % 3}", k, "complete" if k == 30 else "step", f"m{k}") for k in range(60)]
    df = spark.createDataFrame(rows, "run_id string, seq long, phase string, message string")
    batch = {}
    for r in streams.progress_tail(df, 5).collect():
        batch.setdefault(r.run_id, set()).add(r.seq)
    assert tails(spark, [rows]) == batch
    assert tails(spark, [rows[30:], rows[:30]]) == batch  # what comes after a later complete event stays out
    assert tails(spark, [rows[k::9] for k in range(9)]) == batch


def tails(spark, parts, late=None):
    """The tails after the last trigger; each part is one, and the query is stopped and started anew between two of them."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    kind = "run_id string, seq long, phase string, message string" + (", ts timestamp" if late else "")
    for half in (parts[: len(parts) // 2], parts[len(parts) // 2 :]):
        for part in half:
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if half:
            stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            streams.write_updates(streams.progress_tail_stream(stream, 5, late), f"{folder}/out", f"{folder}/state").awaitTermination()
    return {r.run_id: {e[0] for e in json.loads(r.tail)} for r in streams.latest(spark.read.parquet(f"{folder}/out"), "run_id").collect()}


def test_silent_runs_are_forgotten(spark):
    at = lambda day: datetime.datetime(2024, 1, day)
    parts = [[("a", 1, "x", "m", at(1)), ("a", 2, "complete", "m", at(1)), ("b", 1, "x", "m", at(1))], [("b", 2, "x", "m", at(20))], [("b", 3, "x", "m", at(21))], [("a", 1, "x", "late", at(2)), ("b", 4, "x", "m", at(21))], [("a", 1, "x", "new", at(22))]]
    assert tails(spark, parts, "2 days") == {"a": {1}, "b": {1, 2, 3, 4}}  # the run is anew, its old number of complete is gone; the late event is dropped


@pytest.mark.parametrize("order", ["whole", "parts", "backwards"])
def test_rank_diff_stream(spark, order):
    """Whatever the order in which rows come, the last updates are the changes between neighbours in time."""
    rng = random.Random(3)
    ranks = {(listing, k): rng.sample("abcdefg", 4) for listing in ("l1", "l2") for k in range(5)}
    rows = [(listing, f"s{k}", datetime.datetime(2024, 1, 1 + k), n + 1, p) for (listing, k), found in ranks.items() for n, p in enumerate(found)]
    rows.sort(key=lambda r: (r[2], r[3]), reverse=order == "backwards")
    if order == "parts":
        rng.shuffle(rows)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    kind = "listing_key string, snapshot_id string, checked_at timestamp, rank int, product_key string"
    parts = [rows] if order == "whole" else [rows[k::7] for k in range(7)] if order == "parts" else [rows[k : k + 8] for k in range(0, len(rows), 8)]
    for half in (parts[: len(parts) // 2], parts[len(parts) // 2 :]):  # stopped and started anew between them
        for part in half:
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if half:
            stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            streams.write_updates(streams.rank_diff_stream(stream), f"{folder}/out", f"{folder}/state").awaitTermination()
    found = streams.latest(spark.read.parquet(f"{folder}/out"), "listing_key", "snapshot_id", "product_key").where("direction is not null").collect()
    wanted = set()
    for listing in ("l1", "l2"):
        for k in range(5):
            before, now = ranks.get((listing, k - 1), []), ranks[listing, k]
            for p in {*before, *now}:
                old, new = (before.index(p) + 1 if p in before else None), (now.index(p) + 1 if p in now else None)
                way = "new" if old is None else "missing" if new is None else "up" if old > new else "down" if old < new else "same"
                wanted.add((listing, f"s{k}", p, old, new, way))
    assert {tuple(r) for r in found} == wanted


def test_snapshots_behind_the_watermark(spark):
    at = lambda day: datetime.datetime(2024, 1, day)
    kind = "listing_key string, snapshot_id string, checked_at timestamp, rank int, product_key string"
    days = [[1], [2], [10], [11], [3, 12], [9, 13]]  # the third comes too late, the ninth doesn't: at that time the watermark is at 7
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for part in days:
        spark.createDataFrame([("l", f"s{d:02}", at(d), 1 + d % 2, "p") for d in part], kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    streams.write_updates(streams.rank_diff_stream(stream, "4 days"), f"{folder}/out", f"{folder}/state").awaitTermination()
    found = {r.snapshot_id: (r.previous_rank, r.current_rank) for r in streams.latest(spark.read.parquet(f"{folder}/out"), "listing_key", "snapshot_id", "product_key").collect()}
    assert found == {"s01": (None, 2), "s02": (2, 1), "s09": (1, 2), "s10": (2, 1), "s11": (1, 2), "s12": (2, 1), "s13": (1, 2)}


def test_repeats_and_page_stream(spark, sf_dir):
    ledger = view(spark, sf_dir, "credit_ledger").withColumn("ts", F.col("created_at").cast("timestamp"))
    got = collected(spark, streams.idempotent_events(streamed(spark, ledger), "provider_order_id", "400 days"), "append", "once")
    bare = ledger.where("provider_order_id is null").count()
    assert bare and got.count() == ledger.select("provider_order_id").where("provider_order_id is not null").distinct().count() + bare
    pages = view(spark, sf_dir, "pages")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    streams.page_extract_stream(streamed(spark, pages), lambda d: d.select("page_id", F.length("html").alias("n")), folder + "/out", folder + "/check").awaitTermination()
    assert spark.read.parquet(folder + "/out").count() == pages.count()
