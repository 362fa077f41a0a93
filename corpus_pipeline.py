"""A corpus pipeline over ``documents``: each stage applies one operator to what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwatch.llm import decontaminate, linededup, nearcopies, packing, quality
from shelfwatch.llm.common import cut_lineage, read_table, tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the others stay as they are.

    A null or empty text is scored as a text without words. Repeated rows have one score and stay or go together, and
    rows without a doc_id are scored like any other. Without usable labels every document stays. Any further columns
    are kept and never read; an empty table gives an empty table.
    """
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that an earlier document holds; n_chars, where there is such a column, follows.

    Every row stays, even if its text is emptied; a null text becomes an empty one. Rows that share a doc_id count as
    one document; rows without a doc_id lose nothing. Any further columns stay; an empty table gives an empty table.
    """
    kept = linededup.line_dedup(docs, counts=False)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by SimHash or by five-word shingles, the document with the least doc_id stays.

    SimHash links at 3 differing bits; near copies beyond that are linked where their shingles have a similarity of 0.8
    or more. Null, empty and blank texts are one group. Rows that share a doc_id stay or go together; rows without a
    doc_id stay. Any further columns are kept; an empty table gives an empty table.
    """
    return nearcopies.near_dedup(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, by 80 % of its five-word shingles or more, go.

    Null and empty texts hold nothing and stay, as do rows without a doc_id. Rows that share a doc_id are one document.
    Items without words match nothing. Any further columns are kept; an empty table gives an empty table.
    """
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places; the columns are the packing's own.

    A null or empty text is a piece of its closing id alone. Repeated rows and rows without a doc_id are packed each for
    itself. Any further columns are dropped; an empty table gives an empty table.
    """
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: SQL can express neither trained trees nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
