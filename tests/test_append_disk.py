"""What the append of snapshots deals out: line items once and narrow, wide items once a run."""

import glob
import tempfile
import time

from pyspark.sql import functions as F

from shelfwatch.plans import catalog, roundtrip_queries
from shelfwatch.plans.views import view
from shelfwatch.sources import sinks


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_items_are_read_once(spark, sf_dir, monkeypatch):
    """Each append worked the items out again, and ranked them as whole rows."""
    made, written, stored, replace = [], [], roundtrip_queries.stored, sinks._replace

    def spied(df, name):
        made.append((name, plan_of(df)))
        return stored(df, name)

    def spied_replace(rows, path, *parts):
        written.append((path.rsplit("/", 1)[1], plan_of(rows)))
        replace(rows, path, *parts)

    monkeypatch.setattr(roundtrip_queries, "stored", spied)
    monkeypatch.setattr(sinks, "_replace", spied_replace)
    found = catalog.QUERIES["append_snapshot"](spark, sf_dir)
    assert found.count() == view(spark, sf_dir, "rank_items").count()
    plans = made + written
    assert sum("lineitem.parquet" in plan for _, plan in plans) == 1
    ranked = dict(made)["items"]
    assert all("url#" not in line for line in ranked.split("Window")[1].split("\n") if "Exchange" in line)
    assert "Exchange" not in ranked[ranked.index("Window") : ranked.index("Sort")]  # ranking deals out nothing
    for kind, plan in written:
        if kind == "items":
            assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1 and "Exchange rangepartitioning(snapshot_id" in plan


def test_a_large_bucket_is_written_by_several_tasks(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = spark.range(40_000).select(F.lit("s1").alias("snapshot_id"), F.lit("l").alias("listing_key"), F.md5(F.col("id").cast("string")).alias("product_key"), F.col("id").cast("int").alias("rank"))
    header = spark.createDataFrame([("s1", "l", 40_000)], "snapshot_id string, listing_key string, item_count int")
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "128k")
    try:
        sinks.append_snapshot(header, rows, path)
    finally:
        spark.conf.set(name, before)
    assert len(glob.glob(f"{path}/items/*/*/*.parquet")) > 1
    assert [d.count() for d in sinks.read_snapshots(spark, path)] == [1, 40_000]


def test_no_shuffle_outlives_the_writes(spark, sf_dir):
    """Shuffles of finished writes lay on disk until the driver's next collection."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = shuffles()
    catalog.QUERIES["append_snapshot"](spark, sf_dir)
    end = time.time() + 10
    while shuffles() - before and time.time() < end:  # they are removed in the background
        time.sleep(0.2)
    assert not shuffles() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") in (None, "false")
