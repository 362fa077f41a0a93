"""Runs of words that repeat with a period, found with a dictionary of basic factors.

For each power of two L the dictionary names the stretches of L words: two have the same name if they are equal. Where a
factor and its next occurrence lie within twice its length (d <= L words apart), the occurrences form an arithmetic
progression, and d is proposed as a period: it is the least period of what both cover, because a smaller one would have
brought an earlier occurrence. Neighbouring factors with the same step are joined, which extends the stretch as far as
it keeps its period. A run of four periods d holds factors of the least power of two from d on, so level L proposes
L/2 < d <= L and no run is missed. The documents of a chunk are named in common, never across a border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WHITE

#: The least length of a run: in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that are looked at together; a longer document is a chunk of its own.
CHUNK = 200_000
_WORD = rf"[{WHITE}]+"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _named(keys: np.ndarray) -> np.ndarray:
    """Small numbers for keys; -1 for those that occur once."""
    _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts > 1
    numbers = np.where(again, np.cumsum(again) - 1, -1)
    return numbers[at]


def _steps(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of named factors that occur again, in order, and the distance to the next occurrence of each."""
    places = np.nonzero(names >= 0)[0]
    order = places[np.argsort(names[places], kind="stable")]
    same = names[order[1:]] == names[order[:-1]]
    at, step = order[:-1][same], np.diff(order)[same]
    back = np.argsort(at, kind="stable")
    return at[back], step[back]


def runs_of(words: np.ndarray, docs: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, end, period) by start and period; words[k] is a number of docs[k], which is in order.

    Runs have ``least`` words and ``periods`` periods at least; from four periods on none is missed.
    """
    total = len(words)
    names = _named(docs * (int(words.max(initial=0)) + 1) + words)
    found, length = [np.empty((0, 3), np.int64)], 1
    longest = int(np.bincount(docs).max(initial=0))
    while length < longest:
        at, step = _steps(names)
        near = (2 * step > length) & (step <= length)
        at, step = at[near], step[near]
        if len(at):
            starts = np.r_[True, (np.diff(at) != 1) | (np.diff(step) != 0)]
            first, last = np.nonzero(starts)[0], np.r_[np.nonzero(starts)[0][1:], len(at)] - 1
            period = step[first]
            end = at[last] + length + period
            enough = end - at[first] >= np.maximum(least, periods * period)
            found.append(np.stack([at[first], end, period], axis=1)[enough])
        places = np.nonzero(names[: total - length] >= 0)[0]
        places = places[names[places + length] >= 0]
        if not len(places):
            break
        doubled = np.full(total, -1, np.int64)
        doubled[places] = _named(names[places] * (int(names.max()) + 1) + names[places + length])
        names, length = doubled, 2 * length
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    rows: list = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                rows.append((doc, (text or b"").split()))
                size += len(rows[-1][1])
                if size >= CHUNK:
                    yield rows
                    rows, size = [], 0
    if rows:
        yield rows


def find_runs(docs: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_words, runs array<struct<start, length, period>>, collapsed), a row for each row.

    Words are runs without ASCII white space, told apart by case, numbered from 0. A run is a stretch whose least period
    is ``period``, of ``least`` words and ``periods`` (four at least) periods or more, that can't be extended. Runs are
    ordered by start, then period; they may overlap. ``collapsed`` joins by one space what is in no run after its first
    period. A null, empty or blank text has no words and no runs and collapses to ''. Repeated rows give repeated rows,
    rows without a doc_id stay; other columns are ignored; an empty table gives an empty table. A task holds one
    document's words and two numbers for each at a time.
    """
    if periods < 4:
        raise ValueError("runs of less than four periods may hold no factor twice")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            numbers = _Numbers()
            flat = np.array([n for _, words in rows for n in map(numbers.__getitem__, words)], np.int64)
            sizes = np.array([len(words) for _, words in rows], np.int64)
            starts = np.cumsum(sizes) - sizes
            which = np.repeat(np.arange(len(rows)), sizes)
            found = runs_of(flat, which, least, periods)
            inside = np.zeros(len(flat) + 1, np.int64)
            np.add.at(inside, found[:, 0] + found[:, 2], 1)
            np.add.at(inside, found[:, 1], -1)
            stays = np.cumsum(inside)[:-1] == 0
            owner = which[found[:, 0]] if len(found) else np.empty(0, np.int64)
            texts = []
            held = set(owner.tolist())
            for k, (_, words) in enumerate(rows):
                if k in held:
                    words = [words[j] for j in np.nonzero(stays[starts[k] : starts[k] + sizes[k]])[0].tolist()]
                texts.append(b" ".join(words))
            ends = np.searchsorted(owner, np.arange(len(rows) + 1))
            parts = [pa.array(found[:, 0] - starts[owner]), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])]
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(run)))
            columns = [pa.array([d for d, _ in rows], pa.int64()), pa.array(sizes), listed, pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, schema)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts as they are, but one document in ten repeats some of its words to its end.

    h is the CRC-32 of the decimal doc_id and g = h div 10. Where h mod 10 is 0 and the text has n > 0 words, each word
    from number a = g mod n on becomes word a + (its distance from a) mod p, with p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", _WORD), "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    rows = rows.select("doc_id", "text", "words", n.alias("n"), g.alias("g"), F.when(n > 0, g % n).alias("a"))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))
    said = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", at(i).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(said, " ")).otherwise(F.col("text")).alias("text"))


def summary(found: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) -> the number of runs, the longest (ties: least start, then period), and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"), "collapsed")
    return rows.select(
        "doc_id",
        "n_runs",
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.q")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.q")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
