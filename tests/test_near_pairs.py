"""Near pairs of hashes whose keys would be broadcast by their estimated size, and whose bits do not all vary."""

import random

from pyspark.sql import functions as F

from shelfwatch.operators import media


def test_keys_are_never_broadcast(spark):
    """Spark estimates the rows of keys by the hashes that they come from: any number of hashes up to some MB was broadcast 28 to 462 times over."""
    hashes = spark.range(3000).select("id", F.xxhash64("id").alias("hash"))
    plan = media.near_dup_pairs(hashes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_bits_that_never_vary_are_in_no_band(spark):
    rng = random.Random(5)
    for fixed, varying in ((0, 0x00FFFFFFFFFFFFFF), (0xA5 << 56, 0x0000FFFF0F0F0F0F), (0, 0b111 << 20), (0, 0)):
        base = [rng.getrandbits(64) & varying for _ in range(150)]
        base += [h ^ sum(1 << b for b in rng.sample(range(64), 5)) & varying for h in base]
        values = [h | fixed for h in dict.fromkeys(base)]
        values = [h - (1 << 64) if h >> 63 else h for h in values]
        got = media.near_dup_pairs(spark.createDataFrame(list(enumerate([*values, *values, None])), "id long, hash long")).collect()
        wanted = {(a, b, bin((x ^ y) & (2**64 - 1)).count("1")) for a, x in enumerate(values) for b, y in enumerate(values) if x < y}
        assert sorted(map(tuple, got)) == sorted(w for w in wanted if w[2] <= 6)
    assert media.near_dup_pairs(spark.createDataFrame([], "id long, hash long")).collect() == []


def test_half_of_a_hash_meets_as_few_by_its_own_bits(spark):
    """A band of bits that never vary parts nothing; the bands are cut among those that do."""
    half = spark.range(4000).select("id", F.xxhash64("id").bitwiseAND((1 << 32) - 1).alias("hash"))
    assert media.hash_candidates(half, 3, varying=(1 << 32) - 1).count() * 10 < media.hash_candidates(half, 3).count()
