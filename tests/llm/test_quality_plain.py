"""The quality query against a plain form of it: statistics by words and characters, trees by loops."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfwatch.llm import queries, quality


def plain_statistics(text):
    octets = text.encode()
    if not octets:
        return [0.0] * 27
    n, count = len(octets), Counter(octets)
    words, lines = octets.split(), octets.split(b"\n")
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    seen, total = Counter(words), max(1, len(words))
    is_in = lambda chars: sum(count[c] for c in chars)
    stops = b",.;:'\"?"
    others = [c for c in range(33, 127) if not chr(c).isalnum() and c not in stops and c != ord("|")]
    marks = is_in(stops) + is_in(others) + count[ord("|")]
    pairs = len({(a, b) for a, b in zip(words, words[1:], strict=False)}) if len(words) > 1 else 0
    return [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(lines)), mean, math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)),
        len(seen) / total, max(seen.values(), default=0) / total, sum(s <= 3 for s in sizes) / len(sizes), sum(s >= 12 for s in sizes) / len(sizes),
        is_in(range(65, 91)) / n, is_in(range(97, 123)) / n, is_in(range(48, 58)) / n, is_in([9, 10, 11, 12, 13, 32]) / n, count[46] / n,
        is_in(stops) / n, is_in(others) / n, count[ord("|")] / n, is_in(range(128, 256)) / n, -sum(c / n * math.log2(c / n) for c in count.values()),
        marks / total, len(set(lines)) / len(lines), math.log1p(n / len(lines)), sum(not x.strip() for x in lines) / len(lines),
        sum(w.isupper() for w in words) / total, max(count.values()) / n, len(count) / 256, 1 - pairs / max(1, len(words) - 1),
    ]


def plain_fit(x, y):
    """[(splits by node, leaves)] and the base: each node takes the cut between bins that gains most."""
    base = math.log((sum(y) + 0.5) / (len(y) - sum(y) + 0.5))
    cuts = [sorted(set(np.quantile([r[f] for r in x], np.linspace(0, 1, quality.BINS + 1)[1:-1]).tolist())) for f in range(27)]
    bins = [[sum(v > c for c in cuts[f]) for f, v in enumerate(r)] for r in x]
    margin, trees = [base] * len(y), []
    for _ in range(quality.TREES):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        place, splits = [0] * len(y), {}
        for level in range(quality.DEPTH):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows, best = [k for k in range(len(y)) if place[k] == node], (1e-6, None)
                for f in range(27) if rows else ():
                    own_g, own_h = np.zeros(quality.BINS), np.zeros(quality.BINS)
                    for k in rows:
                        own_g[bins[k][f]] += g[k]
                        own_h[bins[k][f]] += h[k]
                    all_g, all_h, left_g, left_h = own_g.sum(), own_h.sum(), 0.0, 0.0
                    for b in range(len(cuts[f])):
                        left_g, left_h = left_g + own_g[b], left_h + own_h[b]
                        if min(left_h, all_h - left_h) < quality.LEAST_HESSIAN:
                            continue
                        gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, cuts[f][b]))
                splits[node] = best[1]
            place = [2 * n + 1 + (splits[n] is not None and x[k][splits[n][0]] > splits[n][1]) for k, n in enumerate(place)]
        leaves = {n: -quality.RATE * sum(g[k] for k in range(len(y)) if place[k] == n) / (sum(h[k] for k in range(len(y)) if place[k] == n) + 1) for n in set(place)}
        margin = [m + leaves[n] for m, n in zip(margin, place, strict=True)]
        trees.append((splits, leaves))
    return base, trees


def plain_score(row, base, trees):
    total = base
    for splits, leaves in trees:
        n = 0
        for _ in range(quality.DEPTH):
            n = 2 * n + 1 + (splits[n] is not None and row[splits[n][0]] > splits[n][1])
        total += leaves.get(n, 0.0)
    return 1 / (1 + math.exp(-total))


def test_fit_equals_plain_fit_where_no_cuts_tie():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 27))
    y = (x[:, 3] + 0.5 * x[:, 7] * x[:, 1] + rng.normal(size=300) > 0).astype(float)
    base, trees = plain_fit(x[:200].tolist(), y[:200].tolist())
    found = quality.fit(x[:200], y[:200]).scores(x)
    assert found.tolist() == pytest.approx([plain_score(r, base, trees) for r in x.tolist()], abs=1e-6)


def test_query_equals_plain_form(spark, sf_dir):
    """Every column from the texts and labels alone. Many cuts part these few rows alike, so the trees are those of ``fit``."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    x = {d: plain_statistics(t) for d, t in texts.items()}
    for d, t in texts.items():
        assert quality.statistics(t.encode()) == pytest.approx(x[d], rel=1e-12, abs=1e-12)
    held_out = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in texts}
    labels = sorted((r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality in (0, 1) and r.doc_id in texts and not held_out[r.doc_id])
    made = quality.fit(np.array([quality.statistics(texts[d].encode()) for d, _ in labels]), np.array([q for _, q in labels], float))
    trees = [({n: (int(f), c) if c < np.inf else None for n, (f, c) in enumerate(zip(fs, cs, strict=True))}, dict(enumerate(leaf, len(fs)))) for fs, cs, leaf in zip(made.feature, made.cut, made.leaf, strict=True)]
    rows = queries.op5_quality_classifier(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert r.held_out == held_out[r.doc_id] and r.predicted == (r.score >= 0.3)
        assert r.score == pytest.approx(plain_score(quality.statistics(texts[r.doc_id].encode()), made.base, trees), abs=1e-9)
