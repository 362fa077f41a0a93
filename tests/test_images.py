"""Image operators that SQL can't express, against plain loops."""

import math
import random

from pyspark.sql import functions as F

from shelfwatch.functions import hashing
from shelfwatch.operators import media
from shelfwatch.plans import catalog


def plain_phash(image):
    low = []
    for u in range(8):
        for v in range(8):
            low.append(sum(image[y * 32 + x] * math.cos((2 * y + 1) * u * math.pi / 64) * math.cos((2 * x + 1) * v * math.pi / 64) for y in range(32) for x in range(32)))
    median = sorted(low[1:])[31]
    bits = int("".join("1" if c > median else "0" for c in low), 2)
    return bits - 2**64 if bits >= 2**63 else bits


def test_phash(spark):
    rng = random.Random(6)
    images = [[rng.uniform(0, 255) for _ in range(1024)] for _ in range(3)]
    df = spark.createDataFrame([(k, i) for k, i in enumerate([*images, [1.0], None])], "k int, gray array<double>")
    got = [r.h for r in df.orderBy("k").select(hashing.phash_bits(F.col("gray")).alias("h")).collect()]
    assert got == [*map(plain_phash, images), None, None]


def test_groups_and_report(spark):
    rng = random.Random(2)
    a, b = ([float(rng.randint(0, 255)) for _ in range(64)] for _ in range(2))
    rows = [(1, 1, 0, a), (1, 2, 0b111, b), (1, 3, -1, a), (1, 4, 0x5555555555555555, b), (2, 1, 5, a)]
    images = spark.createDataFrame(rows, "product_id long, ord long, dhash long, gray array<double>")
    groups = media.leader_groups(images)
    # 2 is near 1 in hash; 3 is alike 1 in structure and edges; 4 resembles no leader.
    assert {(r.product_id, r.ord, r.group) for r in groups.collect()} == {(1, 1, 0), (1, 2, 0), (1, 3, 0), (1, 4, 1), (2, 1, 0)}
    failed = spark.createDataFrame([(1, 4, 0), (2, 1, 0)], "product_id long, total int, failed int")
    modes = {r.product_id: r.mode for r in media.selection_fallback(groups, failed, enabled=True).collect()}
    assert modes == {1: "deduplicated", 2: "keep_all"}
    assert {r.mode for r in media.selection_fallback(groups, failed).collect()} == {"deduplicated"}  # off unless enabled
    report = media.selection_report(groups, media.selection_fallback(groups, failed, enabled=True))
    assert {(r.product_id, r.ord, r.kept, r.similar_to) for r in report.collect()} == {(1, 1, True, None), (1, 2, False, 1), (1, 3, False, 1), (1, 4, True, None), (2, 1, True, None)}


def test_five_equal_images_are_usable_and_deduplicated(spark):
    gray = [float(k * 3 % 250) for k in range(64)]
    groups = media.leader_groups(spark.createDataFrame([(7, k, 9, gray) for k in range(5)], "product_id long, ord long, dhash long, gray array<double>"))
    modes = media.selection_fallback(groups, spark.createDataFrame([(7, 5, 0)], "product_id long, total int, failed int"), enabled=True)
    assert [r.mode for r in modes.collect()] == ["deduplicated"]
    assert sorted(r.ord for r in media.selection_report(groups, modes).where("kept").collect()) == [0]


def plain_edges(gray):
    side = int(len(gray) ** 0.5)
    at = lambda y, x: gray[y * side + x]
    strength = [math.hypot(at(y, x + 1) - at(y, x) if x + 1 < side else 0, at(y + 1, x) - at(y, x) if y + 1 < side else 0) for y in range(side) for x in range(side)]
    mean = sum(strength) / len(strength)
    return [s > mean for s in strength]


def plain_ssim(a, b):
    n = len(a)
    ma, mb = sum(a) / n, sum(b) / n
    va, vb = (sum((x - m) ** 2 for x in v) / (n - 1) for v, m in ((a, ma), (b, mb)))
    cov = sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / (n - 1)
    return max(0, min(1, (2 * ma * mb + 2.55**2) * (2 * cov + 7.65**2) / ((ma * ma + mb * mb + 2.55**2) * (va + vb + 7.65**2))))


def plain_groups(images):
    """(group, doubt) of each image of a product, in order."""
    leaders, found = [], []
    for dhash, gray in images:
        chosen, doubt = None, False
        for k, (other, image) in enumerate(leaders):
            alike = plain_ssim(gray, image)
            edges = sum(x == y for x, y in zip(plain_edges(gray), plain_edges(image), strict=True)) / len(gray)
            if bin((dhash ^ other) % 2**64).count("1") <= 6 or alike >= 0.88 and edges >= 0.9:
                chosen = k
                break
            doubt = doubt or abs(alike - 0.88) <= 0.08 and abs(edges - 0.9) <= 0.08
        if chosen is None:
            chosen = len(leaders)
            leaders.append((dhash, gray))
        found.append((chosen, doubt))
    return found


def test_group_queries_equal_plain_loops(spark, sf_dir):
    """The queries of edges, groups, modes and reports, over the whole table; and images on both sides of each threshold."""
    rows = [(r.vec_id, [(x + 1) * 100 for x in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()]
    shares = {r.vec_id: r.share for r in catalog.QUERIES["edge_similarity"](spark, sf_dir).collect()}
    for v, gray in rows[:200]:
        assert abs(shares[v] - sum(x == y for x, y in zip(plain_edges(gray), plain_edges(gray[::-1]), strict=True)) / 64) < 1e-9
    hashes = {r.vec_id: r.dhash for r in catalog.QUERIES["dhash_bits"](spark, sf_dir).collect()}
    got = {(r.product_id, r.ord): (r.group, r.ambiguous) for r in catalog.QUERIES["leader_groups"](spark, sf_dir).collect()}
    wanted = {}
    for product in {v // 25 for v, _ in rows}:
        own = [(v, gray) for v, gray in rows if v // 25 == product]
        wanted |= {(product, v): f for (v, _), f in zip(own, plain_groups([(hashes[v], g) for v, g in own]), strict=True)}
    assert got == wanted
    modes, leaders = {}, {}
    for product in {v // 25 for v, _ in rows}:
        own = [v for v, _ in rows if v // 25 == product]
        doubt = len(own) < 2 or sum(v % 7 == 0 for v in own) > 0.5 * len(own) or any(wanted[product, v][1] for v in own)
        modes[product] = "keep_all" if doubt else "deduplicated"
        for v in own:
            leaders.setdefault((product, wanted[product, v][0]), v)
    assert {r.product_id: r.mode for r in catalog.QUERIES["selection_fallback"](spark, sf_dir).collect()} == modes
    report = {(p, v): (leaders[p, g] == v or modes[p] == "keep_all", None if leaders[p, g] == v or modes[p] == "keep_all" else leaders[p, g]) for (p, v), (g, _) in wanted.items()}
    assert {(r.product_id, r.ord): (r.kept, r.similar_to) for r in catalog.QUERIES["selection_report"](spark, sf_dir).collect()} == report
    rng, base = random.Random(8), [random.Random(1).uniform(0, 255) for _ in range(64)]
    images = [(rng.getrandbits(63), [min(255.0, max(0.0, x + rng.gauss(0, s))) for x in base]) for s in (0, 5, 20, 35, 50, 60, 70, 80, 90, 100, 20, 40, 60)]
    df = spark.createDataFrame([(1, k, h, g) for k, (h, g) in enumerate(images)], "product_id long, ord long, dhash long, gray array<double>")
    assert [(r.group, r.ambiguous) for r in media.leader_groups(df).orderBy("ord").collect()] == plain_groups(images)
