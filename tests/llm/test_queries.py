import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwatch.llm import queries, quality, simhash

from ..compare import connect, rows_of, rows_of_sql
from .test_operators import check_sequences, plain_contained, plain_line_dedup


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(connect(sf_dir), queries.ORACLE_SQL[name])


def test_other_queries_cover_their_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op2_mpeg_audio", "op3_simhash_near_dedup", "op5_quality_classifier", "op6_token_counts"):
        assert queries.QUERIES[name](spark, sf_dir).count() == docs
    assert queries.QUERIES["op10_html_extraction"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def test_pipeline_equals_its_steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    good = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    rows = {d: t for d, _, _, t in plain_line_dedup(list(rows.items()))}
    least = {r.doc_id: r.component_id for r in simhash.simhash_components(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    rows = {d: t for d, t in rows.items() if least[d] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {f[0] for f in plain_contained(list(rows.items()), items)}
    rows = {d: t for d, t in rows.items() if d not in bad}

    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == names
    got = {r.doc_id: r for r in kept.withColumn("own", F.char_length("text")).collect()}
    assert {d: r.text for d, r in got.items()} == rows and all(r.n_chars == r.own for r in got.values())
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(rows)
    check_sequences(packed)
