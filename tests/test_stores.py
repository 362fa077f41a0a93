"""Stored tables that are changed in part, states that go on, windows that are dealt out, and the SQL functions."""

import datetime
import glob
import os
import random
import tempfile

import pytest
from pyspark.sql import Window, functions as F

from shelfwatch.functions import sql, text, urls
from shelfwatch.operators import discovery, snapshots, usage
from shelfwatch.plans.views import view
from shelfwatch.sources import sinks

from .compare import rows_of


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_upsert_rewrites_touched_buckets_only(spark):
    path, kind = f"{folder()}/t", "k int, owner int, at int, v string, w string"
    first = spark.createDataFrame([(k, None if k % 2 else 1, 1, f"v{k}", f"w{k}") for k in range(200)], kind)
    sinks.upsert_table(spark, path, first, ["k", "owner"], ["at"], ("w",), buckets=16)
    times = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}
    assert len({os.path.dirname(f) for f in times}) == 16
    updates = spark.createDataFrame([(3, None, 2, "new", None), (3, None, 1, "older", "x"), (1000, 5, 1, "added", None)], kind)
    for _ in range(2):  # the same updates once more change nothing
        sinks.upsert_table(spark, path, updates, ["k", "owner"], ["at"], ("w",), buckets=16)
        rows = {(r.k, r.owner): (r.v, r.w) for r in spark.read.parquet(path).collect()}
        assert len(rows) == 201 and rows[3, None] == ("new", "x") and rows[1000, 5] == ("added", None) and rows[4, 1] == ("v4", "w4")
    kept = [f for f, t in times.items() if os.path.exists(f) and os.stat(f).st_mtime_ns == t]
    assert len({os.path.dirname(f) for f in kept}) >= 14
    assert sorted(map(str, rows)) == sorted(str((r.k, r.owner)) for r in snapshots.upsert_latest(first, updates, ["k", "owner"], ["at"], ("w",)).collect())


def test_broken_and_repeated_appends(spark, monkeypatch):
    path = f"{folder()}/s"
    header = lambda k: spark.createDataFrame([(f"s{k}", "l", 2)], "snapshot_id string, listing_key string, item_count int")
    items = lambda k: spark.createDataFrame([(f"s{k}", "l", "a", 1), (f"s{k}", "l", "b", 2)], "snapshot_id string, listing_key string, product_key string, rank int")
    sinks.append_snapshot(header(1), items(1), path)
    whole = sinks._replace

    def breaks(rows, to, *parts):
        if to.endswith("snapshots"):
            raise OSError("gone")
        whole(rows, to, *parts)

    monkeypatch.setattr(sinks, "_replace", breaks)
    with pytest.raises(OSError):
        sinks.append_snapshot(header(2), items(2), path)
    monkeypatch.undo()
    assert [d.count() for d in sinks.read_snapshots(spark, path)] == [1, 2]
    for _ in range(2):
        sinks.append_snapshot(header(2), items(2), path)
        assert [d.count() for d in sinks.read_snapshots(spark, path)] == [2, 4]


def test_history_goes_on_month_by_month(spark, sf_dir):
    headers, items = view(spark, sf_dir, "rank_snapshots"), view(spark, sf_dir, "rank_items")
    keys = [r.listing_key for r in headers.select("listing_key").distinct().orderBy("listing_key").limit(2).collect()]
    headers = headers.where(F.col("listing_key").isin(keys)).withColumn("checked_at", F.col("checked_at").cast("timestamp"))
    rows = items.drop("checked_at").join(headers.select("snapshot_id", "checked_at"), "snapshot_id").select("listing_key", "product_key", "checked_at", "snapshot_id", "rank")
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    cuts = [datetime.datetime(1992, 1, 1), datetime.datetime(1994, 1, 1), datetime.datetime(1994, 2, 1), datetime.datetime(1996, 7, 1), datetime.datetime(2010, 1, 1)]
    between = lambda a, b: rows.where((F.col("checked_at") >= F.lit(a)) & (F.col("checked_at") < F.lit(b)))
    state, made = snapshots.history_state(rows.limit(0)), None
    for a, b in zip(cuts, cuts[1:], strict=False):
        state, new = snapshots.advance_history(spark.createDataFrame(state.collect(), state.schema), between(a, b))
        made = new if made is None else made.unionByName(new)
    want = snapshots.rank_history(headers, items.where(F.col("listing_key").isin(keys)))
    got = snapshots.with_history(made, state).select(*want.columns)
    assert want.count() > 300 and rows_of(got) == rows_of(want)


def test_units_of_a_hot_user(spark):
    rng, start = random.Random(6), datetime.datetime(2024, 1, 1)
    rows = [(k, "hot" if k % 2 else rng.choice(["a", "b", None]), start + datetime.timedelta(seconds=rng.choice([0, 300, 1, rng.randrange(90_000)]) + 18_000 * rng.randrange(4)), rng.random() < 0.8, rng.choice([1, 2, None, -1])) for k in range(1500)]
    df = spark.createDataFrame(rows, "event_id int, user_id string, ts timestamp, billable boolean, units int")
    window = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-5 * 3_600_000_000 + 1, 0)
    want = df.withColumn("units_so_far", F.coalesce(F.sum(F.when(F.col("billable"), F.col("units"))).over(window), F.lit(0)))
    assert rows_of(usage.units_before_event(df)) == rows_of(want)
    assert usage.units_before_event(df.limit(0)).count() == 0


def test_a_round_does_not_shuffle_what_was_visited(spark):
    links = spark.createDataFrame([(f"u{k}", f"u{2 * k + d}") for k in range(500) for d in (0, 1)], "source string, target string")
    found = discovery.crawl_frontier(links, spark.createDataFrame([("u1",)], "url string"), 20)
    got = {r.url: r["round"] for r in found.collect()}
    assert len(got) == 999 and all(got[f"u{k}"] == k.bit_length() - 1 for k in range(1, 1000))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        step = spark.createDataFrame([("u7",)], "url string").join(found, "url", "left_anti")
        plan = step._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # only the new rows are dealt out


def test_names_and_their_keys(spark):
    cases = {"Việt Nam": "viet nam", "Łódź": "odz", "CAFÉ": "cafe", "Ångström": "angstrom", "été": "ete", "İstanbul": "istanbul", "Ṩ ȱ ữ": "s o u", "ﬁ": "", "٣3": "3", "ñandú-Ⅳ": "nandu"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.k for r in df.select("s", text.normalize_for_compare(F.col("s")).alias("k")).collect()} == cases
    pairs = spark.createDataFrame([("Việt", "viet"), ("STRASSE", "strasse"), ("Дом", "дом"), ("a", "b"), (None, "a")], "a string, b string")
    assert [r.same for r in pairs.select(text.same_name(F.col("a"), F.col("b")).alias("same")).collect()] == [True, True, True, False, None]


def test_sql_functions(spark):
    sql.register(spark)
    rows = [("HTTPS://Ex.com:443/a/../é", "/b"), (r"/\evil.example.org/x", "https://shop.example.com/y"), ("http://127.1/", None), (None, "https://a.b/")]
    df = spark.createDataFrame(rows, "u string, base string")
    df.createOrReplaceTempView("sql_urls")
    got = spark.sql("SELECT url_standard(u), url_resolve(u, base), url_host(u), hamming(5, 6) FROM sql_urls").collect()
    want = df.select(urls.url_standard(F.col("u")), urls.url_resolve(F.col("u"), F.col("base")), F.coalesce(urls.host(urls.url_standard(F.col("u"))), F.lit(None)), F.lit(2)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and got[0][0] == "https://ex.com/%C3%A9"
    assert [r.h for r in spark.sql("SELECT host_standard(h) AS h FROM VALUES ('0x7f.1'), ('BÜCHER.de'), ('a b') AS t(h)").collect()] == ["127.0.0.1", "xn--bcher-kva.de", None]
    page = "<ul><li>one<li><b>two</b></ul>"
    found = spark.sql(f"SELECT p.id, e.tag, e.text, e.parent FROM VALUES (7, '{page}') AS p(id, html), LATERAL html_elements(p.html, 'li, b') AS e ORDER BY e.ord").collect()
    assert [tuple(r) for r in found] == [(7, "li", "one", 0), (7, "li", "two", 0), (7, "b", "two", 2)]
