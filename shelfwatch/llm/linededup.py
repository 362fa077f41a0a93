"""Exact line dedup across documents; two Bloom filters choose the lines that have to be shuffled.

A line's key is told by a 128-bit digest of its text. First only the 8 bytes of its upper half travel, once for each
batch of documents, dealt by value: every task holds the two filters, for keys seen once and seen twice, of its own
share of all hashes, so filters grow with the number of tasks and are never gathered or broadcast. What a task sees
again is a suspect, and so is what one batch holds in two documents. Only suspects are then shuffled with both halves
of their digests, confirmed exactly, and the least doc_id keeps its lines. Texts are not shuffled unless the repeated
keys, each counted once, are too many to be broadcast. A full filter makes more suspects, not other results.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WHITE, cut_lineage, sized

LEAST_CHARS = 10
#: Bits of each of a task's two filters (16 MiB), and the bits that a key sets.
FILTER_BITS, HASHES = 27, 2
#: Hashes that a task gathers before it sends what is distinct among them.
GATHERED = 1 << 20
#: The most suspects, and the most repeated keys, that are broadcast (24 bytes each); beyond that joins shuffle.
BROADCAST_KEYS = 400_000
_PAD = WHITE.encode()


def line_keys(text: bytes) -> list[bytes | None]:
    """For each line its key: padding stripped, A-Z lower-cased; None where that is under ten code points."""
    keys: list[bytes | None] = [line.strip(_PAD) for line in text.lower().split(b"\n")]
    for k, key in enumerate(keys):
        if len(key) < LEAST_CHARS or len(key) < 4 * LEAST_CHARS and len(key.decode()) < LEAST_CHARS:
            keys[k] = None
    return keys


def key_digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _digests(text: bytes | None) -> set[bytes]:
    return {key_digest(key) for key in set(line_keys(text or b"")) if key is not None}


def _halves(digests: list[bytes]) -> np.ndarray:
    """A row of two longs for each digest."""
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def key_hashes(docs: DataFrame) -> DataFrame:
    """(text, ...) -> (h, twice): hashes of keys, distinct in each batch; ``twice`` if two documents of it hold the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def distinct() -> pa.RecordBatch:
            hashes, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(counts > 1)], ["h", "twice"])

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                held.append(_halves(list(_digests(text)))[:, 0])
                size += len(held[-1])
                if size >= GATHERED:
                    yield distinct()
                    held, size = [], 0
        if size:
            yield distinct()

    return docs.select("text").mapInArrow(run, "h long, twice boolean")


class Filter:
    """A Bloom filter over 64-bit hashes."""

    def __init__(self, bits: int):
        self.mask, self.octets = np.uint64((1 << bits) - 1), np.zeros(1 << (bits - 3), np.uint8)

    def _bits(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        mixed = hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(HASHES):
            at = mixed >> np.uint64(64 // HASHES * k) & self.mask
            yield at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for octet, bit in self._bits(hashes):
            found &= self.octets[octet] & bit > 0
        return found

    def add(self, hashes: np.ndarray) -> None:
        for octet, bit in self._bits(hashes):
            np.bitwise_or.at(self.octets, octet, bit)


def suspects(docs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(h): the hashes of all keys that two documents hold, and of some others.

    A task keeps 8 bytes of each of its hashes until both filters are complete. There are as many tasks as the input
    has partitions at least, so that its share doesn't grow with the corpus; a key that all batches hold is one row of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, held = Filter(bits), Filter(bits), []
        for batch in batches:
            hashes, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            times = np.bincount(at, weights=1 + batch.column(1).to_numpy(zero_copy_only=False), minlength=len(hashes))
            twice.add(hashes[(times > 1) | once.holds(hashes)])
            once.add(hashes)
            held.append(hashes)
        for hashes in held:
            yield pa.RecordBatch.from_arrays([pa.array(hashes[twice.holds(hashes)])], ["h"])

    found = key_hashes(docs)
    tasks = max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return found.repartition(tasks, "h").mapInArrow(run, "h long").distinct()


def held_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> distinct (doc_id, h, rest) of each row: the halves of the digests of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digests(text) for text in batch.column(1).cast(pa.binary()).to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            halves = _halves([d for f in found for d in f])
            columns = [batch.column(0).take(pa.array(rows)), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "rest"])

    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return known.mapInArrow(run, "doc_id long, h long, rest long")


def repeated_keys(docs: DataFrame, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(h, rest, keeper), the keys of two documents at least, and (doc_id, h, rest), where suspects are held; both stored."""
    known = docs.where("doc_id is not null").select("doc_id", "text")
    wanted = sized(cut_lineage(suspects(known, bits)), BROADCAST_KEYS)
    held = cut_lineage(held_keys(known).join(wanted, "h").select("doc_id", "h", "rest"))
    ends = held.groupBy("h", "rest").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("other"))
    # A stored side has no partitioning that the join must keep, so a hot key's rows may be split over tasks.
    return cut_lineage(ends.where("keeper <> other").select("h", "rest", "keeper")), held


def _without(texts: pa.Array, gone) -> pa.Array:
    """Texts without the lines whose keys are gone; gone(rows, digests) tells for each key of the batch, given by its row."""
    octets = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    keys = [line_keys(t) for t in octets]
    own = [list(set(k) - {None}) for k in keys]
    rows = np.repeat(np.arange(len(own)), [len(k) for k in own])
    lost: list[set[bytes]] = [set() for _ in own]
    flat = [key for k in own for key in k]
    for at in np.nonzero(gone(rows, _halves([key_digest(key) for key in flat])))[0].tolist():
        lost[rows[at]].add(flat[at])
    lines, dropped = [t.count(b"\n") + 1 for t in octets], [0] * len(octets)
    for k, out in enumerate(lost):
        if out:
            stay = [line for line, key in zip(octets[k].split(b"\n"), keys[k], strict=True) if key not in out]
            dropped[k], octets[k] = lines[k] - len(stay), b"\n".join(stay)
    columns = [pa.array(octets, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
    return pa.StructArray.from_arrays(columns, ["text", "n_lines", "n_dropped"])


class Keepers:
    """Repeated keys in order, to look up who keeps them."""

    def __init__(self, rows: list):
        table = np.array(sorted((r.h, r.rest, r.keeper) for r in rows), np.int64).reshape(-1, 3)
        self.h, self.rest, self.keeper = (np.ascontiguousarray(table[:, k]) for k in range(3))

    def of(self, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is repeated, keeper) of each key."""
        found, keeper = np.zeros(len(halves), bool), np.zeros(len(halves), np.int64)
        at = np.searchsorted(self.h, halves[:, 0])
        while True:  # keys that share the first half follow one another
            inside = np.minimum(at, max(0, len(self.h) - 1))
            same = (at < len(self.h)) & ~found
            same[same] &= self.h[inside[same]] == halves[same, 0]
            if not same.any():
                return found, keeper
            hit = same.copy()
            hit[same] = self.rest[inside[same]] == halves[same, 1]
            found |= hit
            keeper[hit] = self.keeper[inside[hit]]
            at = at + 1


def line_dedup(docs: DataFrame, bits: int = FILTER_BITS, counts: bool = True) -> DataFrame:
    """(doc_id, text, ...) -> the same rows and columns with the kept text, and n_lines, n_dropped (longs).

    A key of ten code points or more that at least two documents hold loses all its lines except in the
    smallest doc_id that holds it; there they all stay. Other lines stay, joined by a line feed. A null text
    counts as one empty line and becomes an empty text. Rows that share a doc_id count as one document and each
    loses the same keys. Rows without a doc_id lose nothing and take nothing. An empty table gives an empty one.
    Columns that are named n_lines or n_dropped already are replaced, unless ``counts`` is off; then these two are
    not made. Any other name may be used by the caller.
    """
    repeated, held = repeated_keys(docs, bits)
    added = ["n_lines", "n_dropped"] if counts else []
    names = [c for c in docs.columns if c not in added]
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*names).alias("row"))  # the caller's names lie inside
    made = "struct<text:string,n_lines:bigint,n_dropped:bigint>"
    if repeated.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        shared = docs.sparkSession.sparkContext.broadcast(Keepers(repeated.collect()))

        @F.arrow_udf(made)
        def kept(texts: pa.Array, ids: pa.Array) -> pa.Array:
            doc, known = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)

            def gone(at: np.ndarray, halves: np.ndarray) -> np.ndarray:
                found, keeper = shared.value.of(halves)
                return found & known[at] & (keeper != doc[at])

            return _without(texts, gone)

        found = rows.select("row", kept("row.text", "id").alias("made"))
    else:
        lost = held.join(repeated, ["h", "rest"]).where("doc_id <> keeper")
        lost = lost.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("h", "rest")).alias("keys"))

        @F.arrow_udf(made)
        def kept(texts: pa.Array, losses: pa.Array) -> pa.Array:
            own = [{(x["h"], x["rest"]) for x in keys or ()} for keys in losses.to_pylist()]
            return _without(texts, lambda at, halves: np.array([(h, r) in own[k] for k, (h, r) in zip(at.tolist(), halves.tolist(), strict=True)], bool))

        found = rows.join(lost, "id", "left").select("row", kept("row.text", "keys").alias("made"))
    return found.select(*[F.col("made.text").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in names], *[f"made.{c}" for c in added])
