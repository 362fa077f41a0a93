"""Periodic runs against trying every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from shelfwatch.llm import queries, wordruns


def plain_runs(words, least=6, periods=4):
    """(start, length, period) of stretches that can't be extended, whose least period it is."""
    found = {}
    for q in range(1, len(words) // periods + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end + q - at >= max(least, periods * q) and end > at:
                found.setdefault((at, end + q), q)  # a smaller period comes first
            at = end + 1
    return sorted((a, e - a, q) for (a, e), q in found.items())


def plain_collapsed(words, runs):
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_runs_equal_every_period_tried():
    rng = random.Random(1)
    for trial in range(600):
        letters = "ab" if trial % 3 else "abcd"
        words = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 40)))
        for _ in range(rng.randrange(3)):
            unit = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))
            words += unit * rng.randrange(2, 7) + unit[: rng.randrange(len(unit) + 1)] + "".join(rng.choice(letters) for _ in range(rng.randrange(5)))
        docs = np.sort(np.array([rng.randrange(3) for _ in words], np.int64))
        want = []
        for d in range(3):
            own = np.nonzero(docs == d)[0]
            if len(own):
                want += [(a + own[0], a + own[0] + n, q) for a, n, q in plain_runs([words[k] for k in own])]
        got = wordruns.runs_of(np.array([ord(c) for c in words], np.int64), docs)
        assert [tuple(r) for r in got.tolist()] == sorted(want, key=lambda r: (r[0], r[2]))


ROWS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a"), (5, "a a a a a"), (6, "x y " * 5 + "x"), (7, "A a A a A a A a"), (8, "so so so so so so and on and on and on and on and on and"),
    (9, "p q r " * 4 + "p q r s " * 4), (9, "p q r " * 4 + "p q r s " * 4), (None, "z " * 9), (10, "ü ß " * 30_000), (11, "one\x0btwo\x0c" * 8 + " x"), (12, " ".join(f"w{k}" for k in range(70)) + " q" * 300),
]


def test_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in ROWS], "doc_id long, text string, runs string, collapsed int")
    split = lambda t: (t or "").encode().split()
    want = []
    for d, t in ROWS:
        words = [w.decode() for w in split(t)]
        runs = plain_runs(words) if len(words) < 1000 else [(0, len(words), 2)]
        want.append((str(d), len(words), runs, plain_collapsed(words, runs)))
    read = lambda: sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in wordruns.find_runs(docs).collect())
    assert read() == sorted(want)
    monkeypatch.setattr(wordruns, "CHUNK", 3)
    assert read() == sorted(want)
    assert wordruns.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        wordruns.find_runs(docs, periods=3)


def test_planted_texts(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(k % 23))) for k in range(300)] + [(None, "a b"), (1000, None)]
    got = {r.doc_id: r.text for r in wordruns.planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: " ".join(plain_planted(d, t)) if d is not None and t is not None else t for d, t in rows}
    assert sum(got[d] != t for d, t in rows) > 10


def plain_planted(doc, text):
    words, h = [w.decode() for w in (text or "").encode().split()], zlib.crc32(str(doc).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]


def test_query_equals_plain_form(spark, sf_dir):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        words = plain_planted(r.doc_id, r.text)
        numbers = np.unique(np.array(words or [""]), return_inverse=True)[1][: len(words)]
        runs = []
        for q in range(1, len(words) // 4 + 1):  # as plain_runs, for long texts
            same = np.r_[0, numbers[:-q] == numbers[q:], 0]
            for a, e in zip(np.nonzero(np.diff(same) == 1)[0].tolist(), np.nonzero(np.diff(same) == -1)[0].tolist(), strict=True):
                if e + q - a >= max(6, 4 * q) and not any(x[0] == a and x[1] == e + q - a for x in runs):
                    runs.append((a, e + q - a, q))
        runs.sort(key=lambda x: (x[0], x[2]))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        want.append((r.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{a},{n},{q}\n" for a, n, q in runs)), digest(plain_collapsed(words, runs))))
    found = queries.QUERIES["op12_periodic_runs"](spark, sf_dir)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(want) and any(w[1] for w in want)
