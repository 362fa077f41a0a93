"""The stages of the pipeline on odd tables, and names of the caller's that operators use inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwatch.llm import linededup

SHARED = "this line is shared by all of them"
ROWS = [(1, None), (2, ""), (3, " \t"), (4, f"{SHARED}\nfirst words that nobody else holds"), (5, f"second words that nobody else holds\n{SHARED}"),
        (5, f"second words that nobody else holds\n{SHARED}"), (None, SHARED), (6, "word " * 200_000), (7, "third, own words in one line")]
#: Names that results and helpers bear.
EXTRA = ["id", "row", "keys", "made", "h", "rest", "n_lines", "n_dropped", "copy", "fp", "component_id", "item_id", "words", "score", "length", "size", "shard", "sequence_id", "piece"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string")
    return rows.select("*", F.char_length("text").cast("long").alias("n_chars"), *[F.lit(f"own {c}").alias(c) for c in EXTRA])


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_keeps_columns_and_defined_rows(spark, sf_dir, docs, name, stage):
    found = stage(spark, docs, sf_dir)
    assert found.columns == docs.columns and found.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = found.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in EXTRA)
    ids = sorted(str(r.doc_id) for r in rows)
    if name == "line_dedup":
        assert ids == sorted(str(d) for d, _ in ROWS)
        text = {r.doc_id: r.text for r in rows}
        assert text[1] == "" and text[4].startswith(SHARED) and text[5] == "second words that nobody else holds" and text[None] == SHARED
        assert all(r.n_chars == len(r.text) for r in rows)
    if name == "simhash_near_dedup":
        assert ids == sorted(["1", "4", "5", "5", "6", "7", "None"])
    if name == "benchmark_decontamination":
        assert ids == sorted(str(d) for d, _ in ROWS)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    less = docs.select("doc_id", "text")
    assert stage(spark, less, sf_dir).columns == less.columns


def test_packed_stage(spark, sf_dir, docs):
    rows = corpus_pipeline.packed(spark, docs, sf_dir).collect()
    assert {r.doc_id for r in rows} == {d for d, _ in ROWS} and sum(r.piece == 0 for r in rows) == len(ROWS)
    assert corpus_pipeline.packed(spark, docs.limit(0), sf_dir).count() == 0


def test_full_filters_and_shuffled_joins_change_nothing(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    few, wanted = linededup.suspects(docs).count(), {tuple(r) for r in linededup.line_dedup(docs).collect()}
    assert linededup.suspects(docs, 6).count() > 2 * few  # 64 bits are full: nearly every key is suspected
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", 0)
    assert {tuple(r) for r in linededup.line_dedup(docs, 6).collect()} == wanted
