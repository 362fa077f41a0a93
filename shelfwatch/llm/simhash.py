"""SimHash near-duplicates: fingerprints of word shingles, linked by bit-sliced comparison of blocks.

A fingerprint is stored once however many documents share it. Fingerprints within the radius agree on two of
five bit bands (three differing bits leave two bands untouched), so each goes to the ten blocks of its band
pairs and only members of a block are compared: no pair is lost and no cross join is made. Inside a block the
64 bit planes lie vertically (bit j of word w of plane b is bit b of fingerprint 64*w+j), so one XOR and a
carry-save addition move 64 distances at a time. A block is given up once every counter is over the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, sized
from .components import connected_components

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Widths of the bit bands, from the highest bit down. RADIUS + 2 of them: two always stay untouched.
BANDS = (13, 13, 13, 13, 12)
#: Fingerprints compared at once, and the most of one block that a task compares before the block is split.
BLOCK, SPLIT = 1024, 4096
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint_bytes(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> bytes:
    """The 8 bytes of the fingerprint, highest first, of a UTF-8 text."""
    tokens = text.lower().split()
    if not tokens:
        return bytes(8)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = [0, *(ends[: -words] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(octets), 1 << 15):  # bounds the unpacked bits of a very long text
        ones += np.unpackbits(octets[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(octets)).tobytes()


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fp long), a row for each input row.

    A null or empty text, or one of white space only, has fingerprint zero. Other columns are ignored. Words
    are runs without ASCII white space, A-Z lower-cased; shingles count as often as they occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            made = b"".join(fingerprint_bytes(t or b"", words, seed) for t in texts)
            fp = np.frombuffer(made, ">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each fingerprint, highest bit first."""
    return np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _planes(bits: np.ndarray) -> np.ndarray:
    words = -(-len(bits) // 64)
    padded = np.zeros((64, words * 64), np.uint8)
    padded[:, : len(bits)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _count(planes, queries, order, ones, twos, over):
    for b in order:
        differ = planes[b] ^ queries[b]
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry


def near_pairs(fps: np.ndarray, first: int, last: int, bits: np.ndarray, planes: np.ndarray, radius: int = RADIUS):
    """Pairs (i, j), first <= i < last, i < j, of fingerprints that differ in at most ``radius`` = 3 bits."""
    assert radius == 3, "the counters overflow at four"
    n, words = len(fps), planes.shape[1]
    rows = np.arange(first, last)
    masks = (ALL * bits[first:last].astype(np.uint64)).T[:, :, None]  # plane, query, 1
    ones, twos = np.zeros((2, last - first, words), np.uint64)
    over = np.zeros((last - first, words), np.uint64)
    column = np.arange(words * 64)
    barred = (column[None, :] <= rows[:, None]) | (column[None, :] >= n)
    over |= np.packbits(barred, axis=1, bitorder="little").view(np.uint64)
    order = np.argsort(np.abs(bits.mean(axis=0) - 0.5), kind="stable").tolist()  # the planes that part most come first
    _count(planes[:, None, :], masks, order[:24], ones, twos, over)
    at_row, at_word = np.nonzero(over != ALL)
    if not len(at_row):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ones, twos, over = ones[at_row, at_word], twos[at_row, at_word], over[at_row, at_word]
    for step in (order[24:40], order[40:]):
        _count(planes[:, at_word], masks[:, at_row, 0], step, ones, twos, over)
        alive = over != ALL
        if not alive.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at_row, at_word, ones, twos, over = (x[alive] for x in (at_row, at_word, ones, twos, over))
    kept = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, bit = np.nonzero(kept)
    return at_row[which] + first, at_word[which] * 64 + bit


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[k] and b[k]; root[i] is the least member of i's class, before and after."""
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(root, b, a)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def block_links(fps: np.ndarray, stripe: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A link from each fingerprint of the block to the first of its class, if that is another one."""
    bits = _bits(fps)
    planes, root = _planes(bits), np.arange(len(fps))
    for at in range(0, len(fps), stripe):
        _roots(root, *near_pairs(fps, at, min(at + stripe, len(fps)), bits, planes))
    moved = np.nonzero(root != np.arange(len(fps)))[0]
    return fps[moved], fps[root[moved]]


def _band_keys() -> list:
    """Expressions of the block keys: the number of the band pair above the bits of both bands."""
    shift, bands = 64, []
    for width in BANDS:
        shift -= width
        bands.append((F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)), width))
    keys = []
    for number, ((x, _), (y, wide)) in enumerate(combinations(bands, 2)):
        keys.append(F.shiftleft(x, wide).bitwiseOR(y) + F.lit(number << 26))
    return keys


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, lo, hi, fp) rows -> links. Blocks are runs of whole groups; a group is never parted."""
    held = np.empty((0, 4), np.int64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        u, v = block_links(np.ascontiguousarray(rows[:, 3]).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in batches:
        new = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
        held = np.concatenate([held, new])
        starts = np.nonzero(np.r_[True, (held[1:, :3] != held[:-1, :3]).any(axis=1)])[0] if len(held) else []
        at = 0
        for cut in starts:  # a start closes what lies before it, once that fills a block
            if cut - at >= BLOCK:
                yield links(held[at:cut])
                at = cut
        held = held[at:]
    if len(held) > 1:
        yield links(held)


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Distinct (fp) -> links (u, v) whose classes are those of all pairs within the radius.

    Not every pair is listed: inside a compared block each member has one link to the first of its class. A
    block with over SPLIT members is dealt into chunks, and each pair of chunks is a group of its own.
    """
    keyed = fps.select("fp", F.explode(F.array(*_band_keys())).alias("key"))
    hot = keyed.groupBy("key").count().where(F.col("count") > SPLIT)
    hot = hot.select("key", F.ceil(F.col("count") * 2 / SPLIT).cast("int").alias("chunks"))
    dealt = keyed.join(hot, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").cast("long").alias("lo"), F.greatest("own", "other").cast("long").alias("hi"), "fp")
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_blocks, "u long, v long")


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fp long, component_id), a row for each input row.

    Documents are linked where fingerprints differ in at most three bits; component_id is the least doc_id
    reachable, a document's own included. Null, empty and blank texts share fingerprint zero and so one
    component. Repeated rows give repeated rows. An empty table gives an empty table. Rows without a doc_id
    keep their fingerprint and get the least doc_id of the others in their component (null if there is none).
    """
    marked = cut_lineage(fingerprints(docs))
    first = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    roots = connected_components(link_fingerprints(first.select("fp")))
    classes = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    classes = classes.withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return marked.join(classes.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_copies(docs: DataFrame, components: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is null or is its own component's in (doc_id, component_id); texts are not shuffled if few go."""
    gone = cut_lineage(components.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(sized(gone), "doc_id", "left_anti").select(*docs.columns)


def near_dedup(docs: DataFrame) -> DataFrame:
    """Keep the document with the least doc_id of each component, with all its columns.

    Rows that share a doc_id are one document: all stay if any of them is the first of its component.
    Rows without a doc_id can't be named as anyone's copy and all stay.
    """
    found = simhash_components(docs.where("doc_id is not null"))
    return drop_copies(docs, found.groupBy("doc_id").agg(F.max("component_id").alias("component_id")))
