"""The session settings that the operators count on."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configured(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build(master: str = "local[*]", app: str = "shelfwatch", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Folders that belong to the session, and those of each thread's open scratches.
_OWNED: list[str] = []
_OPEN = threading.local()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; a temporary one only in a local session without it.

    It belongs to the innermost ``scratch``, or to the session until ``close``.
    """
    root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not root:
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    scratches = getattr(_OPEN, "scratches", None)
    (scratches[-1] if scratches else _OWNED).append(folder)
    return folder


def _remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        if folder.startswith("table "):
            spark.sql(f"DROP TABLE IF EXISTS {folder[6:]}")
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    folders.clear()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside the block are removed at its end; what was read from them must be written by then."""
    _OPEN.scratches = [*getattr(_OPEN, "scratches", []), []]
    try:
        yield
    finally:
        _remove(spark, _OPEN.scratches.pop())


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what is written inside the block are removed once it is written, not whenever the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def close(spark: SparkSession) -> None:
    """Remove all tables that were stored for this session; frames that read them can't be used any more."""
    _remove(spark, _OWNED)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to a shared folder and read from there: many branches, one computation."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> str:
    """The rows of ``df`` as a table that is dealt into buckets by ``key``: joins on it need not shuffle it. Gives its name."""
    folder = shared_folder(df.sparkSession, name)
    table = f"{name}_{uuid.uuid4().hex}"
    scratches = getattr(_OPEN, "scratches", None)
    (scratches[-1] if scratches else _OWNED).append(f"table {table}")
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", folder).saveAsTable(table)
    return table
