"""Small cases with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from shelfwatch.functions import hashing, text, urls
from shelfwatch.operators import discovery, extract, fetchlog, media, ranking, snapshots, usage
from shelfwatch.sources.html import html_elements


def values(spark, column, *rows, names=("a", "b")):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], ["k"] + [f"{n}" for n in names[: len(rows[0])]])
    return [r[0] for r in df.orderBy("k").select(column.alias("v")).collect()]


def test_private_hosts(spark):
    hosts = ["localhost", "10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.1.1", "shop.example.com", "a.local", "fcbarcelona.com", "0.0.0.0", "169.254.1.1", "8.8.8.8"]
    assert values(spark, urls.url_is_private_host(F.col("a")), *[(h,) for h in hosts]) == [True, True, True, False, True, False, True, True, True, True, False]


def test_hosts_and_private_addresses(spark):
    pages = ["https://[::1]/x", "http://[fd00::7]:81/", "https://u:p@10.example.com:8/x", "http://127.cdn.net/", "http://0.pool.ntp.org", "http://10.0.0.1/", "http://1.2.3.4"]
    assert values(spark, urls.host(F.col("a")), *[(p,) for p in pages]) == ["[::1]", "[fd00::7]", "10.example.com", "127.cdn.net", "0.pool.ntp.org", "10.0.0.1", "1.2.3.4"]
    assert values(spark, urls.url_is_private_host(urls.host(F.col("a"))), *[(p,) for p in pages]) == [True, True, False, False, False, True, False]


def test_resolving_as_the_url_standard_does(spark):
    base = "https://shop.example.com/a/b/page?x=1#y"
    cases = {
        "../products/a": "https://shop.example.com/a/products/a", "./b": "https://shop.example.com/a/b/b", "/a b.jpg": "https://shop.example.com/a%20b.jpg", "../../../../x": "https://shop.example.com/x",
        "..": "https://shop.example.com/a/", ".": "https://shop.example.com/a/b/", "../..": "https://shop.example.com/", "c/./d/../e?q=/../z": "https://shop.example.com/a/b/c/e?q=/../z", "/x/%2e%2E/y": "https://shop.example.com/y",
        " /trim\n": "https://shop.example.com/trim", "/ta\tb": "https://shop.example.com/tab", "//o.example.com/a/../b": "https://o.example.com/b", "https://o.example.com/a/..": "https://o.example.com/", "...": "https://shop.example.com/a/b/...",
        "/.hid..den/x": "https://shop.example.com/.hid..den/x", "?q=2": "https://shop.example.com/a/b/page?q=2", "mailto:a@b": None, "#z": None, "": None,
    }
    assert values(spark, urls.url_resolve(F.col("a"), F.col("b")), *[(raw, base) for raw in cases]) == list(cases.values())


def test_tracking_and_variant_parameters(spark):
    found = values(spark, urls.url_strip_tracking(F.col("a")), ("https://c.d/i.jpg?utm_source=x&w=2&ref=1&w=3#z",), ("https://c.d/i.jpg?fbclid=1",), ("nothing",))
    assert found == ["https://c.d/i.jpg?w=2&w=3", "https://c.d/i.jpg", None]


def test_redirects(spark):
    base = "https://shop.com/collections/hats?sort_by=best-selling&page=2"
    cases = [(base, "/en-us/collections/hats"), (base, "/collections/caps"), (base, "https://evil.com/collections/hats"), (base, "https://www.shop.com/collections/HATS?sort_by=best-selling&page=2")]
    assert values(spark, urls.safe_redirect_target(F.col("a"), F.col("b")), *cases) == [
        "https://shop.com/en-us/collections/hats?sort_by=best-selling&page=2", None, None, "https://www.shop.com/collections/HATS?sort_by=best-selling&page=2",
    ]


def test_product_identity_decodes_and_never_fails(spark):
    got = values(spark, urls.product_identity(F.col("a"))["handle"], ("https://s/products/Caf%C3%A9",), ("https://s/products/bad%ZZ",), ("https://s/products/a+b",), ("https://s/x",))
    assert got == ["café", "bad%zz", "a+b", None]


def test_text_functions(spark):
    assert values(spark, text.clean_text(F.col("a")), ("  a   b\n",), ("   ",)) == ["a b", None]
    assert values(spark, text.decode_entities(F.col("a")), ("&amp;lt; &quot;x&quot;",)) == ['&lt; "x"'.replace("&lt;", "<")]
    assert values(spark, text.sanitize_segment(F.col("a")), ("Hello, World!",), ("***",)) == ["hello-world", "item"]
    assert values(spark, text.srcset_urls(F.col("a")), ("/a.jpg 1x, /b.jpg 2x, ",)) == [["/a.jpg", "/b.jpg"]]


def test_junk_handles(spark):
    handles = ["shipping-protection", "add-a-tip", "tipperary", "tip-toe", "gift-cards", "your-parcel-insurance-plan", "tulip-dress", None]
    assert values(spark, ranking.junk_product_filter(F.col("a")), *[(h,) for h in handles]) == [True, True, False, False, True, True, False, False]


def test_site_suffix(spark):
    cases = [("Shorts - Blue Heron", "Blue Heron"), ("Tee - Black", "Shop"), ("- Shop", "Shop"), ("A | shop ", "Shop")]
    assert values(spark, ranking.strip_site_suffix(F.col("a"), F.col("b")), *cases) == ["Shorts", "Tee - Black", "- Shop", "A"]


def test_blocked(spark):
    df = spark.createDataFrame([(0, 200, "Just a moment...", None, None), (1, 200, "ok", "cloudflare", None), (2, 200, "x Ray ID 1", "Cloudflare", None), (3, 521, "", None, None), (4, 404, "", None, " "), (5, 200, "", None, "challenge")], "k int, s int, h string, server string, m string")
    got = [r.v for r in df.orderBy("k").select(fetchlog.blocked_response(F.col("s"), F.col("h"), F.col("server"), F.col("m")).alias("v")).collect()]
    assert got == [True, False, True, True, False, True]


def test_hashes(spark):
    assert values(spark, hashing.hamming_hex(F.col("a"), F.col("b")), ("0000000000000000", "ffffffffffffffff"), ("3", "c"), ("abc", "ab")) == [64, 4, 12]
    df = spark.createDataFrame([([float(k) for k in range(64)],) * 2], "a array<double>, b array<double>")
    assert df.select(F.round(hashing.ssim(F.col("a"), F.col("b")), 9)).first()[0] == 1.0
    assert df.select(hashing.edge_similarity(F.col("a"), F.col("b"))).first()[0] == 1.0


def test_rank_diff(spark):
    kind = "product_key string, rank int, url string, title string"
    old = spark.createDataFrame([("a", 1, "u", "A"), ("b", 2, "u", "B"), ("c", 3, "u", "C")], kind)
    new = spark.createDataFrame([("b", 1, "u", "B"), ("a", 2, "u", "A"), ("d", 3, "u", "D")], kind)
    got = {r.product_key: (r.previous_rank, r.current_rank, r.delta, r.direction) for r in snapshots.rank_diff(old, new).collect()}
    assert got == {"a": (1, 2, -1, "down"), "b": (2, 1, 1, "up"), "c": (3, None, None, "missing"), "d": (None, 3, None, "new")}
    first = {r.direction for r in snapshots.rank_diff(old.limit(0), new).collect()}
    assert first == {"new"}


def test_every_snapshot_adds_up(spark, sf_dir):
    from shelfwatch.plans.views import view

    headers, items = view(spark, sf_dir, "rank_snapshots"), view(spark, sf_dir, "rank_items")
    rows = snapshots.diff_summary(snapshots.rank_diff_all(headers, items), "snapshot_id").join(headers, "snapshot_id").collect()
    assert len(rows) == headers.count()
    assert all(r.tracked == r.new + r.moved_up + r.moved_down + r.unchanged == r.item_count for r in rows)


def test_units(spark):
    assert values(spark, usage.listing_units(F.col("a"), F.col("b")), (10, False), (150, False), (10, True), (150, True)) == [1, 3, 2, 8]


@pytest.mark.parametrize(
    ("page", "title", "source"),
    [
        ("<title> A  B </title>", "A B", "title_tag"),
        ('<title>Shop</title><meta property="og:site_name" content="shop"><meta property="og:title" content="Real">', "Real", "og:title"),
        ('<title>Café Łódź</title><meta property="og:site_name" content="Cafe Lodz">', "Café Łódź", "title_tag"),
        ('<meta name="twitter:title" content="T">', "T", "twitter:title"),
        ('<script type="application/ld+json">{"@graph":[{"@type":["x","Product"],"name":"L"}]}</script>', "L", "jsonld:Product.name"),
        ("<h1>Head <b>line</b></h1>", "Head line", "h1"),
        ("<p>nothing</p>", None, "none"),
    ],
)
def test_title_chain(spark, page, title, source):
    pages = spark.createDataFrame([(1, "https://s.com/p", page)], "page_id long, url string, html string")
    els = html_elements(pages, ("title", "meta", "link", "script", "h1", "h2", "h3", "b"))
    row = extract.seo_fields(extract.page_facts(pages, els)).first()
    assert (row.title.value, row.title.source) == (title, source)


def test_label_heuristic_and_graph_order(spark):
    page = '<h3>Product details</h3><p>A long enough text about the material of it.</p><script type="application/ld+json">{"@graph":[{"@type":"A"},{"@type":"B"}],"@type":"W"}</script><script type="application/ld+json">{oops</script>'
    pages = spark.createDataFrame([(1, "https://s.com/p", page)], "page_id long, url string, html string")
    els = html_elements(pages, ("h3", "script"))
    assert extract.label_section_text(els).first().label_text == "A long enough text about the material of it."
    assert [r.t for r in extract.jsonld_nodes(els).orderBy("pos").select(F.get_json_object("node", "$.@type").alias("t")).collect()] == ["A", "B", "W"]


def test_grid_beats_chrome(spark):
    page = '<div class="upsell"><a href="/products/u1">x</a><a href="/products/u2">x</a><a href="/products/u3">x</a></div><div class="collection--filters-drawer" id="product-grid"><a href="/products/a"></a><a href="/products/b"></a></div>'
    pages = spark.createDataFrame([(1, "https://s.com/c", page), (2, "https://s.com/c", '<nav><a href="/x">x</a></nav>')], "page_id long, url string, html string")
    got = sorted((r.page_id, r.href) for r in ranking.grid_anchor_select(html_elements(pages, ("a",), ("grid",))).collect())
    assert got == [(1, "/products/a"), (1, "/products/b"), (2, "/x")]


def test_rank_cap_fills_only_up_to_the_last_link(spark):
    rows = [("l", 1, 1, "a", "a", None, None), ("l", 1, 2, "a", "a", "A", None), ("l", 1, 3, "b", "b", None, None), ("l", 1, 4, "b", "b", "B", None), ("l", 1, 5, "c", "c", "C", None)]
    df = spark.createDataFrame(rows, "listing_key string, page_no int, ord int, product_key string, handle string, title string, image_url string")
    assert sorted((r.rank, r.product_key, r.title) for r in ranking.rank_assign(df, 2).collect()) == [(1, "a", "A"), (2, "b", None)]


def test_next_page(spark):
    cases = {
        1: ("https://s.com/c", '<link rel="next" href="/c?page=2">', "https://s.com/c?page=2"),
        2: ("https://s.com/c?page=2", '<ul class="pagination"><a href="?page=1">1</a><a href="?page=3">3</a></ul>', "https://s.com/c?page=3"),
        3: ("https://s.com/c", '<a class="next" href="/other?x=1">Next</a>', None),
        4: ("https://s.com/c", '<a aria-label="Next" href="/c?cursor=9">Next</a>', "https://s.com/c?cursor=9"),
        5: ("https://s.com/c", '<nav class="mobile-pages"><a href="/">Home</a></nav>', None),
    }
    pages = spark.createDataFrame([(k, u, h) for k, (u, h, _) in cases.items()], "page_id long, url string, html string")
    got = {r.page_id: r.next_url for r in discovery.next_page_url(html_elements(pages, ("a", "link"))).collect()}
    assert got == {k: w for k, (_, _, w) in cases.items() if w}


def test_near_pairs_equal_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.h) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", hashing.dhash_bits(F.col("embedding"), 8, 8).alias("h")).collect()]
    rows = rows[:150] + [(1000 + i, h ^ (1 << (i % 56)) ^ 3) for i, h in rows[:80]]
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in media.near_dup_pairs(spark.createDataFrame(rows, "id long, hash long")).collect()}
    wanted = {(min(a, b), max(a, b)) for a, x in rows for b, y in rows if x < y and bin((x ^ y) & (2**64 - 1)).count("1") <= 6}
    assert got == wanted and wanted


def test_random_hashes_meet_few_others(spark):
    """What a hash meets by chance stays within bounds from a thousand to a million hashes, and all k find the same pairs."""
    assert [media.agreeing_bands(n) for n in (1_000, 10**4, 10**5, 10**6, 10**7, 10**8)] == [2, 2, 3, 4, 5, 5]
    hashes = lambda n: spark.range(n).select("id", F.xxhash64("id").alias("hash"))
    for n in (2_000, 100_000):
        met = media.hash_candidates(hashes(n), media.agreeing_bands(n)).count()
        assert met / n <= media.CANDIDATES / 2 * 1.2
    near = hashes(300).unionByName(hashes(300).select((F.col("id") + 1000).alias("id"), F.col("hash").bitwiseXOR(F.lit((0b1011001 * 9) << 20)).alias("hash")))
    wanted = None
    for k in (2, 3, 4, 5):
        rows = media.hash_candidates(near, k).where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= 6).select("a", "b").collect()
        found = {tuple(sorted(r)) for r in rows}
        assert len(rows) == len(found) and (wanted is None or found == wanted)
        wanted = found
    assert len(wanted) >= 300
