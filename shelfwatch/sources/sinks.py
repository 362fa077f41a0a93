"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.snapshots import upsert_latest
from ..session import stored

#: Folders that a table is dealt into by a hash of its key; a folder for each key would make millions of small files.
BUCKETS = 64


def _in_buckets(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).repartition("bucket", F.pmod(F.xxhash64(*rows.columns[:2]), F.lit(4)))


def write_seo_json(rows: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object for each page, in folders by a hash of the domain; missing values are left out."""
    _in_buckets(rows, "domain").write.mode(mode).partitionBy("bucket").option("ignoreNullFields", "true").json(path)


def write_data_json(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).option("ignoreNullFields", "true").json(path)


def write_raw(pages: DataFrame, metadata: DataFrame, path: str, mode: str = "append") -> None:
    """Raw pages and raw metadata side by side."""
    pages.write.mode(mode).parquet(f"{path}/html")
    metadata.write.mode(mode).parquet(f"{path}/metadata")


def _replace(rows: DataFrame, path: str, *parts: str) -> None:
    """Write rows in folders by ``parts``; the folders that they touch are replaced, all others stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def append_snapshot(header: DataFrame, items: DataFrame, path: str, dealt: bool = False) -> None:
    """Append snapshots: items in folders by batch and by a hash of the listing, and then their headers.

    A header marks a whole snapshot: until it is written, ``read_snapshots`` doesn't see the items. The batch is named by its
    snapshots, so an append that broke, or comes twice, is simply repeated: what it had written is replaced. A large bucket is
    written by several tasks. Items that are ``dealt`` already, so that a task has those of a few listings, are not dealt again.
    """
    batch, deal = F.lit(_digest(header)), F.pmod(F.xxhash64("listing_key"), F.lit(BUCKETS)).cast("int")
    rows = items.withColumn("batch", batch).withColumn("bucket", deal)
    _replace(rows if dealt else rows.hint("rebalance", "bucket"), f"{path}/items", "batch", "bucket")
    _replace(header.withColumn("batch", batch), f"{path}/snapshots", "batch")


def _digest(header: DataFrame) -> str:
    """A name that the same set of snapshots always has."""
    row = header.select(F.xxhash64("snapshot_id").alias("h")).agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count("h").alias("n")).first()
    return f"{row.n}_{row.s or 0}".replace("-", "m")


def read_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, items) of the snapshots that are whole."""
    headers = spark.read.parquet(f"{path}/snapshots").drop("batch")
    items = spark.read.parquet(f"{path}/items").drop("batch", "bucket")
    return headers, items.join(headers.select("snapshot_id"), "snapshot_id", "left_semi")


def upsert_table(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], order: list[str], keep_old_when_null: tuple[str, ...] = (), buckets: int = BUCKETS) -> None:
    """``upsert_latest`` into a stored table, which is made if it isn't there; only buckets that the updates touch are read and replaced.

    Rows lie in folders by a hash of their keys. A broken write is repeated with the same updates. The table's columns are those
    of the first updates.
    """
    deal = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = stored(updates.withColumn("bucket", deal), "updates")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
    else:
        old = new.limit(0)
    merged = stored(upsert_latest(old, new, [*keys, "bucket"], order, keep_old_when_null), "merged")
    _replace(merged.repartition("bucket"), path, "bucket")
