import glob
import json
import os
import tempfile

from shelfwatch import session
from shelfwatch.sources import sinks, tables


def test_sinks_and_image_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = spark.createDataFrame([("a.com", 1, "x"), ("b.com", 2, None)], "domain string, page_id int, title string")
    sinks.write_seo_json(rows, f"{folder}/seo")
    written = [json.loads(line) for name in glob.glob(f"{folder}/seo/bucket=*/*.json") for line in open(name)]
    assert sorted(written, key=lambda r: r["domain"]) == [{"domain": "a.com", "page_id": 1, "title": "x"}, {"domain": "b.com", "page_id": 2}]
    sinks.write_data_json(rows, f"{folder}/data")
    sinks.write_raw(rows, rows.select("page_id"), f"{folder}/raw")
    assert spark.read.parquet(f"{folder}/raw/metadata").count() == 2
    open(f"{folder}/small.bin", "wb").write(b"12")
    open(f"{folder}/large.bin", "wb").write(b"1" * 50)
    assert [r.bytes for r in tables.scan_image_files(spark, f"{folder}/*.bin", 10).collect()] == [2]
    header = spark.createDataFrame([("s", "l")], "snapshot_id string, listing_key string")
    sinks.append_snapshot(header, header, f"{folder}/snap")
    assert spark.read.parquet(f"{folder}/snap/items").count() == 1


def test_stored_tables_have_an_owner(spark):
    df = spark.range(5).toDF("k")
    with session.scratch(spark):
        inner = session.stored(df, "inner")
        assert inner.count() == 5
        place = inner.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.isdir(place)
    assert not os.path.exists(place)
    kept = session.stored(df, "kept")
    assert kept.count() == 5
    session.close(spark)
    assert not os.path.exists(kept.inputFiles()[0].removeprefix("file://"))
