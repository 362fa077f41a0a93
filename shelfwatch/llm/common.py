"""Helpers that the operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space: the characters that separate words and pad lines.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder that all executors share and read it from there.

    The folder is the session's ``spark.checkpoint.dir``. Only where none is set (a local test session) is
    a temporary one chosen.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


#: The most rows of a side that is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def sized(side: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, marked for broadcast if it has few rows."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def hashed_bucket(*cols: str | Column, n: int) -> Column:
    """A bucket from 0 to n-1 that depends on the values alone, so a repeated task gives the same rows."""
    return F.pmod(F.xxhash64(*cols), F.lit(n))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the named public tokenizer file lies; it is part of every worker's Python environment."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
