"""A quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Training takes a bounded sample of labelled rows (SAMPLE) to one place; scoring runs where the documents lie.
Trees are complete binary trees held in flat arrays, so that a batch of documents steps down all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: The most labelled rows that a model is fitted on.
SAMPLE = 20_000
#: A document with a lower score is rejected.
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_HESSIAN = 60, 4, 64, 0.2, 1.0, 2.0

STATISTICS = (
    "chars words lines word_mean word_deviation distinct_words top_word short_words long_words upper lower digits "
    "spaces full_stops marks other_marks bars high_bytes entropy marks_a_word distinct_lines line_mean blank_lines "
    "upper_words top_byte distinct_bytes repeated_pairs"
).split()

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 space, 5 , . ; : ' " ?, 6 other mark, 7 bar, 8 high byte
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]] = 1, 2, 3, 4
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 6
_CLASS[[*b",.;:'\"?"]] = 5
_CLASS[ord("|")], _CLASS[128:] = 7, 8


def statistics(text: bytes) -> list[float]:
    """The statistics of one UTF-8 text, in the order of STATISTICS; an empty text has zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    octets = np.frombuffer(text, np.uint8)
    by_byte = np.bincount(octets, minlength=256)
    by_class = np.bincount(_CLASS, weights=by_byte, minlength=9)
    n = len(text)
    chars = n - int(by_byte[128:192].sum())
    share = by_byte[by_byte > 0] / n
    words = text.split()
    lines = text.split(b"\n")
    count = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 0
    marks = by_class[5] + by_class[6] + by_class[7]
    return [
        float(np.log1p(chars)), float(np.log1p(len(words))), float(np.log1p(len(lines))), sizes.mean(), sizes.std(),
        len(seen) / count, max(seen.values(), default=0) / count, float((sizes <= 3).mean()), float((sizes >= 12).mean()),
        by_class[1] / n, by_class[2] / n, by_class[3] / n, by_class[4] / n, by_byte[46] / n, by_class[5] / n, by_class[6] / n,
        by_class[7] / n, by_class[8] / n, float(-(share * np.log2(share)).sum()), marks / count, len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))), sum(not x.strip() for x in lines) / len(lines), sum(map(bytes.isupper, words)) / count,
        by_byte.max() / n, int((by_byte > 0).sum()) / 256, 1 - pairs / max(1, len(words) - 1),
    ]


@dataclass
class Trees:
    """Node i of a tree has the children 2i+1 and 2i+2; a node that isn't split sends all to the left."""

    base: float
    feature: np.ndarray  # trees, inner nodes
    cut: np.ndarray  # the same: larger values go right
    leaf: np.ndarray  # trees, leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        node = np.zeros((len(x), trees), np.int64)
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        while inner:
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
            inner //= 2
        total = self.base + self.leaf[tree, node - self.feature.shape[1]].sum(axis=1) if trees else np.full(len(x), self.base)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the labels y (0 or 1). Without rows every score is a half; with one label, near it."""
    positive = float(y.sum())
    base = float(np.log((positive + 0.5) / (len(y) - positive + 0.5)))
    inner = (1 << DEPTH) - 1
    feature, cut, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    if not 0 < positive < len(y):
        return Trees(base, feature[:0], cut[:0], leaf[:0])
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    bins = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    width = x.shape[1]
    flat = bins + np.arange(width) * BINS
    margin = np.full(len(y), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, nodes = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * width * BINS + flat).ravel()
            sums = [np.bincount(at, weights=np.repeat(v, width), minlength=nodes * width * BINS).reshape(nodes, width, BINS) for v in (g, h)]
            left_g, left_h = (np.cumsum(s, axis=2) for s in sums)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(left_h < LEAST_HESSIAN) | (right_h < LEAST_HESSIAN)] = -np.inf
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k in range(nodes):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[t, first + k], cut[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[t, node]] > cut[t, node])
        k = node - inner
        leaf[t] = -RATE * np.bincount(k, weights=g, minlength=inner + 1) / (np.bincount(k, weights=h, minlength=inner + 1) + RIDGE)
        margin += leaf[t][k]
    return Trees(base, feature, cut, leaf)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled documents that are not held out, chosen by a hash of doc_id.

    Labels other than 0 and 1 are left out. Only statistics and labels reach the driver, never texts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(~is_held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
    share = min(1.0, 0.95 * sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy("doc_id", "quality").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    # A doc_id that many rows share can't outgrow the sample: the limit holds for rows as well.
    found = rows.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, x array<double>").limit(sample).collect()
    found.sort(key=lambda r: (r.doc_id, r.quality, r.x))
    x = np.array([r.x for r in found], float).reshape(len(found), len(STATISTICS))
    return fit(x, np.array([r.quality for r in found], float))


def score(text: str | Column, trees: Trees) -> Column:
    """The score of each whole text, 0 to 1; a null text is an empty one."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t or b"") for t in texts.cast(pa.binary()).to_pylist()], float).reshape(-1, len(STATISTICS))
        return pa.array(np.concatenate([np.empty(0), *(trees.scores(x[k : k + 4096]) for k in range(0, len(x), 4096))]))

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text, ...) and (doc_id, quality, ...) -> (doc_id, held_out, score, predicted), a row for each document.

    A null text is scored as an empty one; a null doc_id has a null held_out. Repeated rows have equal scores.
    Without usable labels every score is 0.5. Other columns are never read. An empty table gives an empty table.
    """
    trees = train(docs, labels)
    found = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score("text", trees).alias("score"))
    return found.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    return docs.where(score("text", train(docs, labels)) >= threshold)
