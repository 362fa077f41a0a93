import random

import numpy as np
import pytest

import corpus_pipeline
from shelfwatch.llm import nearcopies, simhash


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return words


def test_near_copies_equal_brute_force(spark, sf_dir):
    rng, texts = random.Random(4), [None, "", " \n", "one two", "ONE  two", "one two three"]
    for k in range(40):  # copies of copies, on both sides of the threshold
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 300))]
        for _ in range(3):
            texts.append(" ".join(words))
            words = edited(rng, words, max(1, len(words) // rng.choice((40, 60, 120))))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows] + [(None, "one two", 2), (8, texts[8], 1)], "doc_id long, text string, n_chars int")
    least = {r.doc_id: r.component_id for r in simhash.simhash_components(docs.where("doc_id is not null")).collect()}
    sets, root = {d: plain_shingles(t) for d, t in rows}, dict(least)
    linked = 0
    for a in sets:
        for b in range(a):
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                linked += least[a] != least[b]
                new, old = sorted((root[a], root[b]))
                root = {d: new if r == old else r for d, r in root.items()}
    assert linked > 20  # SimHash alone keeps these
    assert {r.doc_id: r.component_id for r in nearcopies.near_copy_components(docs).collect()} == root
    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, set(root.values())), "None"])
    assert nearcopies.near_dedup(docs.limit(0)).count() == 0


def test_large_group_of_near_copies_becomes_one(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(edited(rng, words, 2))) for k in range(300)]  # two of them differ in up to 20 shingles each
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in nearcopies.near_dedup(docs).collect()] == [0]


def test_recall_in_large_buckets(spark):
    """Texts that are alike below the threshold share buckets by the hundred; of the planted pairs above it nine in ten at least are linked."""
    rng = random.Random(8)
    frame = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(700):
        words = list(frame)
        for at in rng.sample(range(15), 3):  # three stretches of their own: about 0.7 alike
            words[at * 10] = f"own{k}x{at}"
        rows.append(" ".join(words))
        rows.append(" ".join([*words[:140], f"end{k}"]))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    root = {r.doc_id: r.component_id for r in nearcopies.near_copy_components(docs).collect()}
    sets = [plain_shingles(t) for t in rows]
    alike = [(2 * k, 2 * k + 1) for k in range(700) if 5 * len(sets[2 * k] & sets[2 * k + 1]) >= 4 * len(sets[2 * k] | sets[2 * k + 1])]
    found = sum(root[a] == root[b] for a, b in alike)
    assert len(alike) > 600 and found >= 0.9 * len(alike)


def test_head_of_many(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "GROUP", 7)
    test_large_group_of_near_copies_becomes_one(spark)


def joined(root, links):
    for u, v in links:
        new, old = sorted((root[u], root[v]))
        root = {d: new if r == old else r for d, r in root.items()}
    return root


def scattered(rng, n):
    """Texts that differ from one frame in two words: most pairs are about 0.65 alike, few are at 0.8, and all share large buckets."""
    frame = [f"w{k}" for k in range(100)]
    return [" ".join(edited(rng, frame, 2)) for _ in range(n)]


def alike(sets):
    return [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


@pytest.mark.parametrize("block", [1 << 19, 6000])
def test_large_buckets_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    rows = list(enumerate(scattered(random.Random(11), 500)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    least = {r.doc_id: r.component_id for r in simhash.simhash_components(docs).collect()}
    got = {r.doc_id: r.component_id for r in nearcopies.near_copy_components(docs).collect()}
    assert got == joined(least, alike([plain_shingles(t) for _, t in rows]))


def test_block_links_equal_brute_force():
    rng = random.Random(12)
    texts = scattered(rng, 200) + ["one two", "three"]
    sets, found = [plain_shingles(t) for t in texts], [nearcopies.shingles(t) for t in texts]
    roots = [1000 + 7 * (k if k % 3 else 0) for k in range(len(texts))]  # a class of many members, the others alone
    for sides in ([0] * len(texts), [rng.randrange(2) for _ in texts]):
        pairs = [(roots[a], roots[b]) for a, b in alike(sets) if sides[a] != sides[b] or not any(sides)]
        links = nearcopies.block_links(found, np.array(roots), np.array(sides))
        start = {r: r for r in roots}
        assert joined(start, links) == joined(start, pairs) and len(links) == len(start) - len(set(joined(start, pairs).values()))
