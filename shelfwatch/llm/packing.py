"""Best-fit packing of tokenised documents into sequences, by a grouping genetic algorithm on islands.

Pieces are dealt by hash into shards of bounded size and each shard is a packing problem of its own; a shard
loses less than one sequence to the cut. Several islands evolve packings of a shard in separate tasks. A
crossover injects well-filled whole bins of one parent into the other, drops the bins that hold an injected
piece again, and best-fits the displaced pieces. Between rounds each island sends its elite to the next one.
Evolution of an island ends early where a packing meets the lower bound.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .bpe import WordEncoder
from .common import cut_lineage, hashed_bucket

CAPACITY = 2048
#: Pieces of a shard on average, islands of a shard, rounds between migrations, population, generations a round.
SHARD, ISLANDS, ROUNDS, POPULATION, GENERATIONS = 8192, 3, 3, 6, 10
#: Characters of text that are tokenised at once.
SLICE = 2 << 20


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE characters, or one longer text."""
    at = size = 0
    for i, chars in enumerate(pc.utf8_length(texts).to_pylist()):
        if size and size + chars > SLICE:
            yield at, i
            at, size = i, 0
        size += chars
    if len(texts) > at:
        yield at, len(texts)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32), every document's ids in order.

    A document is the ids of its text (null: empty) and the id ``closing``. One with over ``capacity`` ids is cut
    into pieces of ``capacity``, of which the first may be shorter. Repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            if encoder is None:
                pa.default_memory_pool().release_unused()  # of what this worker did before
                encoder = WordEncoder(tokenizer)
            keys, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("")
            for a, b in _slices(texts):
                ids, ends = encoder.encode(texts.slice(a, b - a).to_pylist(), closing)
                rows, begin = [], 0
                for key, end in zip(keys[a:b], ends.tolist(), strict=True):
                    cut, piece = begin, 0
                    while cut < end:
                        to = cut + ((end - cut - 1) % capacity + 1 if cut == begin else capacity)
                        rows.append((key, piece, cut - begin, to - cut, zlib.crc32(ids[cut:to])))
                        cut, piece = to, piece + 1
                    begin = end
                cols = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The least number of bins that large and middle pieces can need (bound L2 of Martello and Toth)."""
    count = np.bincount(lengths, minlength=capacity + 1)
    n, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half = capacity // 2
    small = np.arange(0, half + 1)
    large = n[-1] - n[capacity - small]
    middle = n[capacity - small] - n[half]
    room = middle * capacity - (total[capacity - small] - total[half])
    fine = total[half] - np.where(small > 0, total[small - 1], 0)
    return int((large + middle + np.maximum(0, -(-(fine - room) // capacity))).max())


def best_fit(assigned: np.ndarray, loose: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Put the loose pieces, in the order given, each into the fullest bin that has room; bins renumbered from 0."""
    out = assigned.copy()
    out[loose] = -1
    held = out >= 0
    _, out[held] = np.unique(out[held], return_inverse=True)
    bins = int(out.max()) + 1 if held.any() else 0
    room = capacity - np.bincount(out[held], weights=lengths[held], minlength=bins).astype(int)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    for k, r in enumerate(room.tolist()):
        stacks[r].append(k)
        open_rooms |= 1 << r
    for i, size in zip(loose.tolist(), lengths[loose].tolist(), strict=True):
        fits = open_rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            k = stacks[r].pop()
            if not stacks[r]:
                open_rooms ^= 1 << r
        else:
            k, r, bins = bins, capacity, bins + 1
        out[i] = k
        stacks[r - size].append(k)
        open_rooms |= 1 << (r - size)
    return out


def fitness(assigned: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller full bins; smaller is better."""
    fill = np.bincount(assigned, weights=lengths)
    return len(fill), -float(((fill / capacity) ** 2).sum())


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of a: well-filled whole bins of b go in, a's bins that hold one of their pieces go, displaced pieces are best-fit."""
    fill = np.bincount(b, weights=lengths)
    inject = (fill >= np.quantile(fill, 0.5)) & (rng.random(len(fill)) < 0.5)
    moved = inject[b]
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[moved]] = True
    child = np.where(moved, b + len(hit), a)
    loose = hit[a] & ~moved
    return refill(child, loose, lengths, capacity)


def mutate(a: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A few bins, the poorest first of all, are emptied and their pieces best-fit again."""
    fill = np.bincount(a, weights=lengths)
    out = rng.random(len(fill)) < np.where(fill < np.quantile(fill, 0.1), 0.5, min(0.2, 3 / len(fill)))
    return refill(a, out[a], lengths, capacity)


def refill(assigned: np.ndarray, loose: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit the loose pieces, the longest first; before that a loose piece may take the place of a shorter one that fills its bin worse."""
    assigned, loose = np.where(loose, -1, assigned), loose.copy()
    order = np.argsort(assigned, kind="stable")
    order = order[assigned[order] >= 0]
    free = np.nonzero(loose)[0]
    if len(free) and len(order):
        fill = np.bincount(assigned[order], weights=lengths[order]).astype(np.int64)
        pool = free[np.argsort(lengths[free], kind="stable")]
        sizes = lengths[pool]
        used = np.zeros(len(pool), bool)
        # For each placed piece the longest loose one that still fits in its stead.
        at = np.searchsorted(sizes, capacity - fill[assigned[order]] + lengths[order], side="right") - 1
        gain = np.where(at >= 0, sizes[np.maximum(at, 0)] - lengths[order], 0)
        changed = np.zeros(len(fill), bool)
        for k in np.argsort(-gain, kind="stable"):
            if gain[k] <= 0:
                break
            piece, other, bin_ = order[k], at[k], assigned[order[k]]
            if used[other] or changed[bin_]:
                continue
            used[other] = changed[bin_] = True
            assigned[pool[other]], assigned[piece] = bin_, -1
            loose[pool[other]], loose[piece] = False, True
    free = np.nonzero(loose)[0]
    return best_fit(assigned, free[np.argsort(-lengths[free], kind="stable")], lengths, capacity)


def evolve(lengths: np.ndarray, seeds: list[np.ndarray], capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The best packing that an island finds; ``seeds`` are elites of earlier rounds."""
    nothing = np.full(len(lengths), -1)
    bound = lower_bound(lengths, capacity)
    crowd = list(seeds)
    while len(crowd) < POPULATION and min((fitness(x, lengths, capacity)[0] for x in crowd), default=bound + 1) > bound:
        noise = rng.uniform(0.9, 1.1, len(lengths)) if crowd else 1.0
        crowd.append(best_fit(nothing, np.argsort(-lengths * noise, kind="stable"), lengths, capacity))
    rank = lambda x: fitness(x, lengths, capacity)
    crowd.sort(key=rank)
    for _ in range(GENERATIONS):
        if rank(crowd[0])[0] <= bound or len(crowd) < 2:
            break
        pairs = [rng.choice(len(crowd), 2, replace=False) for _ in range(POPULATION // 2)]
        born = [crossover(crowd[i], crowd[j], lengths, capacity, rng) for i, j in pairs]
        born += [mutate(crowd[int(rng.integers(len(crowd)))], lengths, capacity, rng) for _ in range(2)]
        crowd = sorted(crowd + born, key=rank)[:POPULATION]
    return crowd[0]


def _round(islands: DataFrame, number: int, capacity: int) -> DataFrame:
    """(shard, island, lengths, elite, guest) -> (shard, island, lengths, elite, bins, fill)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                seeds = [np.array(row[k], np.int64) for k in ("elite", "guest") if row[k] is not None]
                rng = np.random.default_rng([row["shard"], row["island"], number])
                best = evolve(lengths, seeds, capacity, rng)
                bins, fill = fitness(best, lengths, capacity)
                rows.append({"shard": row["shard"], "island": row["island"], "lengths": row["lengths"], "elite": best.tolist(), "bins": bins, "fill": fill})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    kind = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("lengths", pa.list_(pa.int32())), ("elite", pa.list_(pa.int32())), ("bins", pa.int32()), ("fill", pa.float64())])
    schema = "shard long, island int, lengths array<int>, elite array<int>, bins int, fill double"
    return islands.select("shard", "island", "lengths", "elite", "guest").mapInArrow(run, schema)


def pack(found: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Pieces with ``length`` 1 to ``capacity`` and any other columns -> the same rows, sequence_id and offset.

    Pieces of one sequence lie behind one another without a gap. Full pieces are sequences of their own.
    Repeated rows are packed each for itself; an empty table gives an empty table. Columns that are named
    sequence_id or offset already are replaced; any other name may be used by the caller.
    """
    names = [c for c in found.columns if c not in ("sequence_id", "offset")]
    found = cut_lineage(found.select(F.col("length").cast("int").alias("size"), F.struct(*names).alias("own")))
    rows = found.withColumn("row", F.monotonically_increasing_id())  # stored rows keep their numbers when a task runs again
    full = rows.where(F.col("size") >= capacity).select("own", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = rows.where(F.col("size") < capacity)
    shards = max(1, ceil(part.count() / shard))
    part = part.withColumn("shard", hashed_bucket("row", n=shards).cast("long"))
    grouped = cut_lineage(part.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("size", "row", "own")), asc=False).alias("items")))
    islands = grouped.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("items.size").alias("lengths"))
    islands = islands.repartition(ceil(shards * ISLANDS / 4), "shard", "island")  # few rows, but much work in each
    none = F.lit(None).cast("array<int>")
    state = cut_lineage(_round(islands.select("*", none.alias("elite"), none.alias("guest")), 0, capacity))
    for number in range(1, ROUNDS):
        sent = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("guest"))
        state = cut_lineage(_round(state.join(sent, ["shard", "island"]), number, capacity))
    best = state.groupBy("shard").agg(F.min_by("elite", F.struct("bins", "fill", "island")).alias("bin"))
    spots = grouped.join(best, "shard").select("shard", F.posexplode(F.arrays_zip("items", "bin")).alias("at", "x"))
    spots = spots.select("shard", "at", "x.bin", "x.items.size", "x.items.own")
    ahead = "sum(size) over (partition by shard, bin order by at rows between unbounded preceding and 1 preceding)"
    spots = spots.withColumn("sequence_id", F.shiftleft("shard", 20) + F.col("bin")).withColumn("offset", F.expr(f"coalesce({ahead}, 0)").cast("long"))
    return full.unionByName(spots.select("own", "sequence_id", "offset")).select("own.*", "sequence_id", "offset")
