"""Near copies by wording: what SimHash links, and texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

MinHash bands find candidates and the exact similarity of the texts confirms them, so no pair is linked wrongly. A pair
at the threshold shares no band with a probability of 3 in a million, a closer one still more rarely. Buckets of one
member are left out; the others are stored. A member is first compared to the head that it shares most buckets with, which
is the same document for most of a group: members go to the text that they are compared to, which is sent once for each
GROUP of them. Buckets that hold several classes even then are compared whole, whatever their size: members meet in
blocks, one for each pair of chunks, and prefix filtering finds in a block each pair at the threshold without
trying all. So every two texts that share a bucket are in one class or have been compared. Pairs within a class are never
made, so a large group of copies makes one pair for each member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut_lineage, sized
from .components import connected_components
from .simhash import drop_copies, simhash_components

SHINGLE_WORDS = 5
#: MinHash bands and values in each.
BANDS, ROWS = 32, 5
#: Texts that are compared to one other in a task, and the shingles of a block.
GROUP, BLOCK = 512, 1 << 19
_RNG = np.random.default_rng(42)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, one without words has none."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    ends = range(min(SHINGLE_WORDS, len(tokens)), len(tokens) + 1)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(tokens[max(0, e - SHINGLE_WORDS) : e])) for e in ends], np.uint64))


def band_keys(found: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, (found[at : at + 1024, None] * FACTORS + SHIFTS).min(axis=0))
    return [xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, size, digest of the shingles, keys) of texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(at, 512) for batch in batches for at in range(0, batch.num_rows, 512)):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = shingles(text)
                if len(found):
                    rows.append((doc, len(found), xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63), band_keys(found)))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "size", "digest", "keys"])

    return docs.mapInArrow(run, "doc_id long, size long, digest long, keys array<long>")


def buckets(sketched: DataFrame) -> DataFrame:
    """(doc_id, size, digest, keys) -> (key, doc_id, size) of the bands that two texts share at least.

    Texts with the same shingles in any number count once, by their least doc_id.
    """
    one = sketched.groupBy("digest").agg(F.min_by(F.struct("doc_id", "size", "keys"), "doc_id").alias("row")).select("row.*")
    members = one.select("doc_id", "size", F.explode("keys").alias("key"))
    shared = members.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    return cut_lineage(shared.select("key", "doc_id", "size"))


def lead_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Each member with the one head that it shares most buckets with: in a large group of copies that settles nearly all."""
    own = F.struct("doc_id", "size", "root")
    rows = members.join(classes, "doc_id").withColumn("head", F.first(own).over(Window.partitionBy("key").orderBy(F.xxhash64("doc_id"), "doc_id")))
    fit = (F.col("head.root") != F.col("root")) & (5 * F.least("head.size", "size") >= 4 * F.greatest("head.size", "size"))
    shared = rows.where(fit).groupBy("doc_id", "root", F.col("head.doc_id").alias("a"), F.col("head.root").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy(F.col("doc_id").alias("b"), F.col("root").alias("v")).agg(F.max(F.struct("n", "a", "u")).alias("best"))
    return best.select("best.a", "b", "best.u", "v")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, chunk, part, text, u, v) by the first three: links (u, v) of members (part 1) that are like the text before them (part 0)."""
    at, heads = None, []
    for part in (batch.slice(k, 64) for batch in batches for k in range(0, batch.num_rows, 64)):
        links = []
        for a, chunk, is_member, text, u, v in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if (a, chunk) != at:
                at, heads = (a, chunk), []
            found = shingles(text)
            if not is_member:
                heads.append(found)
                continue
            for head in heads:
                if 5 * min(len(found), len(head)) >= 4 * max(len(found), len(head)):
                    common = len(np.intersect1d(found, head, assume_unique=True))
                    if common and 5 * common >= 4 * (len(found) + len(head) - common):
                        links.append((u, v))
                        break
        columns = [pa.array([link[k] for link in links], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["u", "v"])


def _confirmed(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b, u, v) -> (u, v) of those whose texts are alike; known has (doc_id, text)."""
    large = pairs.groupBy("a").count().where(F.col("count") > GROUP).select("a", F.ceil(F.col("count") / GROUP).alias("chunks"))
    chunk = F.coalesce(F.pmod(F.xxhash64("b"), F.col("chunks")), F.lit(0).cast("long"))
    placed = cut_lineage(pairs.join(large, "a", "left").select("a", "b", "u", "v", chunk.alias("chunk")))
    none = F.lit(None).cast("long")
    heads = placed.select(F.col("a").alias("doc_id"), "a", "chunk").distinct().select("*", F.lit(0).alias("part"), none.alias("u"), none.alias("v"))
    members = placed.select(F.col("b").alias("doc_id"), "a", "chunk", F.lit(1).alias("part"), "u", "v")
    texts = known.join(sized(cut_lineage(heads.unionByName(members))), "doc_id").select("a", "chunk", "part", "text", "u", "v")
    return texts.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "part").mapInArrow(_alike, "u long, v long")


def block_links(sets: list[np.ndarray], roots: np.ndarray, sides: np.ndarray) -> list[tuple[int, int]]:
    """Links (root, root) that join the classes of all sets with a similarity of 0.8 or more; of sets on two sides, only those across.

    Sets at the threshold share one of their rarest shingles, as many as each may lack and one more. The largest class asks
    nothing: others ask for its members.
    """
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)]
    owner = np.repeat(np.arange(len(sets)), sizes)
    kinds, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((ids, often[ids], owner))  # each set's shingles, the rarest first
    prefix = order[(np.arange(len(order)) - starts[owner] < (sizes - -(-4 * sizes // 5) + 1)[owner]) & (often[ids[order]] > 1)]
    prefix = prefix[np.argsort(ids[prefix], kind="stable")]
    bearers, first = owner[prefix], np.searchsorted(ids[prefix], np.arange(len(kinds) + 1))
    asked = prefix[np.argsort(owner[prefix], kind="stable")]
    mine = np.searchsorted(owner[asked], np.arange(len(sets) + 1))
    names, root = np.unique(roots, return_inverse=True)
    largest = int(np.bincount(root).argmax())
    across, class_of, links = len(np.unique(sides)) > 1, root.copy(), []
    has, marked = np.zeros(len(kinds), bool), np.zeros(len(sets), bool)
    for x in np.nonzero(root != largest)[0].tolist():
        for k in ids[asked[mine[x] : mine[x + 1]]].tolist():
            marked[bearers[first[k] : first[k + 1]]] = True
        met = np.nonzero(marked)[0]
        marked[met] = False
        fit = (class_of[met] != class_of[x]) & ((met < x) | (root[met] == largest)) & (5 * np.minimum(sizes[met], sizes[x]) >= 4 * np.maximum(sizes[met], sizes[x]))
        met = met[fit & (sides[met] != sides[x])] if across else met[fit]
        if not len(met):
            continue
        own = ids[starts[x] : starts[x + 1]]
        has[own] = True
        common = np.add.reduceat(has[np.concatenate([ids[starts[y] : starts[y + 1]] for y in met.tolist()])].astype(np.int64), np.r_[0, np.cumsum(sizes[met])[:-1]])
        has[own] = False
        for y in met[5 * common >= 4 * (sizes[met] + sizes[x] - common)].tolist():
            if class_of[y] != class_of[x]:
                links.append((int(names[root[x]]), int(names[root[y]])))
                class_of[class_of == class_of[y]] = class_of[x]
    return links


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (head, lo, hi, side, root, text) by the first three -> links (u, v) of the classes of each block."""

    def links(held: list) -> pa.RecordBatch:
        sets, roots, sides = zip(*held, strict=True)
        found = block_links(list(sets), np.array(roots, np.int64), np.array(sides, np.int64))
        return pa.RecordBatch.from_arrays([pa.array([link[k] for link in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    at, held = None, []
    for part in (batch.slice(k, 64) for batch in batches for k in range(0, batch.num_rows, 64)):
        for head, lo, hi, side, root, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if (head, lo, hi) != at:
                if len(held) > 1:
                    yield links(held)
                at, held = (head, lo, hi), []
            found = shingles(text)
            if len(found):
                held.append((found, root, side))
    if len(held) > 1:
        yield links(held)


def unsettled(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(head, lo, hi, side, doc_id, root): the members of buckets that hold several classes, dealt into blocks.

    Buckets with the same head make one group, so that a text travels once for each of them. A group over BLOCK shingles
    is dealt into chunks, and each pair of chunks is a block.
    """
    rows = members.join(classes, "doc_id")
    head = F.min_by("doc_id", F.struct(F.xxhash64("doc_id"), "doc_id")).alias("head")  # chosen alike in all buckets
    several = rows.groupBy("key").agg(head, F.min("root").alias("u"), F.max("root").alias("v")).where("u <> v").select("key", "head")
    met = cut_lineage(rows.join(sized(cut_lineage(several)), "key").select("head", "doc_id", "size", "root").distinct())
    large = met.groupBy("head").agg(F.sum("size").alias("total")).where(F.col("total") > BLOCK)
    large = cut_lineage(large.select("head", F.ceil(2 * F.col("total") / BLOCK).cast("long").alias("chunks")))
    dealt = met.join(sized(large), "head", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("doc_id"), F.col("chunks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return dealt.select("head", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "doc_id", "root")


def _block_links(dealt: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``unsettled`` -> (u, v) of the classes that are alike; known has (doc_id, text)."""
    texts = known.join(sized(cut_lineage(dealt)), "doc_id").select("head", "lo", "hi", "side", "root", "text")
    return texts.repartition("head", "lo", "hi").sortWithinPartitions("head", "lo", "hi").mapInArrow(_in_blocks, "u long, v long")


def near_copy_components(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> distinct (doc_id, component_id); rows without a doc_id are left out.

    Documents are linked as ``simhash_components`` links them, and where their texts have a similarity of 0.8
    or more. component_id is the least doc_id reachable.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    linked = cut_lineage(simhash_components(known).select("doc_id", "component_id").distinct())
    # Rows that share a doc_id may lie in several components, which the doc_id joins.
    joined = connected_components(linked.select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")))
    classes = linked.select("doc_id").distinct().join(joined.toDF("doc_id", "root"), "doc_id", "left")
    classes = cut_lineage(classes.select("doc_id", F.coalesce("root", "doc_id").alias("root")))

    def merged(links: DataFrame) -> DataFrame:
        roots = connected_components(links).toDF("root", "above")
        return cut_lineage(classes.join(roots, "root", "left").select("doc_id", F.coalesce("above", "root").alias("root")))

    sketched = cut_lineage(_sketches(known))
    first = sketched.groupBy("digest").agg(F.min("doc_id").alias("first"))
    same = sketched.join(first, "digest").select("doc_id", "first").where("doc_id <> first")  # the same shingles, each once or more
    same = same.join(classes, "doc_id").join(classes.toDF("first", "other"), "first").where("root <> other")
    classes = merged(same.select(F.col("root").alias("u"), F.col("other").alias("v")).distinct())
    members = buckets(sketched)
    classes = merged(_confirmed(cut_lineage(lead_pairs(members, classes)), known))
    classes = merged(_block_links(unsettled(members, classes), known))
    return classes.select("doc_id", F.col("root").alias("component_id"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """Keep the document with the least doc_id of each component, with all its columns.

    Rows that share a doc_id are one document and stay or go together. Rows without a doc_id can't be named as
    anyone's copy and all stay. Null, empty and blank texts are one component. Ties need no rule: ids are distinct. Any
    further columns are kept; an empty table gives an empty table.
    """
    return drop_copies(docs, near_copy_components(docs))
