"""Exact merge-type sentence-piece encoding by backtracking, and decoding.

A sequence of pieces is what merging gives if and only if each piece merges to itself and each two neighbours, merged
anew on their own, stay the same two pieces: until the first merge across a border, what happens on both sides of it
doesn't depend on the rest. So an Aho-Corasick automaton, which reads texts from their ends, gives the longest piece that
begins at each place; the encoder takes it if it fits the piece before it, shortens it otherwise, and goes one piece back
where no length fits. The pieces of a prefix are unique, so a position that failed once fails for good: a bitfield keeps
these, and no position is left twice. Texts are cut where no piece reaches over; all new chunks of a batch are encoded in
step with one another, a chunk seen before is looked up.
"""

from __future__ import annotations

import re
import struct
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Chunks that a worker remembers before it starts anew, and places for what is known of pairs of pieces: bounds of memory only.
REMEMBERED, PAIRS = 500_000, 1 << 20
#: Octets of chunks that are encoded in step: their positions fit one 64-bit field. Chunks that are encoded at once.
SHORT, TOGETHER = 63, 1 << 15
#: Documents of an output batch at most.
SLICE = 512
SPACE = "▁"
# Fixed values of the model format: kinds of pieces, and the model type of merges.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2


def _fields(octets: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            octet = octets[at]
            at += 1
            value |= (octet & 127) << shift
            if octet < 128:
                return value
            shift += 7

    while at < len(octets):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, octets[at : at + size]
        at += size


def _class(chars: Iterable[str]) -> str:
    """Characters as ranges inside the brackets of a pattern."""
    points = np.array(sorted(map(ord, chars)), np.int64)
    runs = np.split(points, np.nonzero(np.diff(points) > 1)[0] + 1) if len(points) else []
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)


class Model:
    """Pieces of a model file: ids, scores, kinds. Models that do other things than merging are refused."""

    def __init__(self, octets: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        spec: dict[str, dict] = {"train": {}, "norm": {}}
        for number, value in _fields(octets):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number in (2, 3):
                spec["train" if number == 2 else "norm"] = dict(_fields(value))
        train, norm = spec["train"], spec["norm"]
        if train.get(3) != BPE or not train.get(35) or train.get(24) or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge models with byte fallback and without user-defined pieces are known")
        if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
            raise ValueError("only models that keep every character and write spaces as U+2581 are known")
        self.prefix = SPACE if norm.get(3, 1) else ""


class Automaton:
    """Aho-Corasick over reversed octets: read from the end, each place tells the longest piece that begins there."""

    def __init__(self, pieces: dict[str, int]):
        children: list[dict[int, int]] = [{}]
        longest = [-1]
        for piece, number in pieces.items():
            node = 0
            for octet in reversed(piece.encode()):
                if octet not in children[node]:
                    children[node][octet] = len(children)
                    children.append({})
                    longest.append(-1)
                node = children[node][octet]
            longest[node] = number
        fail = [0] * len(children)
        queue = deque(children[0].values())
        while queue:
            node = queue.popleft()
            if longest[node] < 0:
                longest[node] = longest[fail[node]]
            for octet, child in children[node].items():
                back = fail[node]
                while back and octet not in children[back]:
                    back = fail[back]
                fail[child] = children[back].get(octet, 0)
                queue.append(child)
        inner = [k for k, c in enumerate(children) if c]
        self.row = np.zeros(len(children), np.int32)  # row 0 has no transition
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.table = np.full((len(inner) + 1, 256), -1, np.int32)
        for k, node in enumerate(inner, 1):
            self.table[k, list(children[node])] = list(children[node].values())
        self.fail, self.longest = np.array(fail, np.int32), np.array(longest, np.int32)

    def begins(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each octet of texts that lie in ``data`` the longest piece that begins there, -1 for none."""
        found, node = np.full(len(data), -1, np.int32), np.zeros(len(starts), np.int32)
        order = np.argsort(-sizes, kind="stable")  # longest first: those still reading are a prefix
        alive = np.cumsum(np.bincount(sizes)[::-1])[::-1]
        for at in range(1, len(alive)):
            live = order[: alive[at]]
            place = starts[live] + sizes[live] - at
            octet, here = data[place], node[live]
            to = self.table[self.row[here], octet]
            stuck = np.nonzero(to < 0)[0]
            while len(stuck):
                top = here[stuck] == 0
                to[stuck[top]] = 0
                stuck = stuck[~top]
                here[stuck] = self.fail[here[stuck]]
                to[stuck] = self.table[self.row[here[stuck]], octet[stuck]]
                stuck = stuck[to[stuck] < 0]
            node[live] = to
            found[place] = self.longest[to]
        return found


class _Numbers(dict):
    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        return number


class Encoder:
    """Tokens are numbers of pieces or, from ``size`` on, single characters that are no piece."""

    def __init__(self, octets: bytes):
        model = Model(octets)
        self.texts, self.size = model.pieces, len(model.pieces)
        self.ids = {p: i for i, p in reversed([*enumerate(model.pieces)]) if model.kinds[i] == NORMAL}
        self.rank = {p: -model.scores[i] for p, i in self.ids.items()}
        self.octets = {int(p[3:5], 16): i for i, p in enumerate(model.pieces) if model.kinds[i] == BYTE}
        self.prefix = model.prefix
        self.whole = {p: i for p, i in self.ids.items() if self.merge(p) == [p]}
        self.automaton = Automaton(self.whole)
        self.chunks = re.compile(self._cuts(), re.DOTALL)
        self.length = np.array([len(p.encode()) for p in self.texts], np.int64)
        self.shorter = np.full(self.size, -1, np.int64)
        for piece, number in self.whole.items():
            if len(piece) > 1:
                known = next((self.whole[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.whole), None)
                self.shorter[number] = self.size + ord(piece[0]) if known is None else known
        self.pairs, self.fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers()
        self.flat, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _cuts(self) -> str:
        """A pattern of chunks, so that no piece reaches from one chunk into the next: found by what the pieces hold."""
        longer = [p for p in self.ids if len(p) > 1]
        inside = set("".join(longer))
        alone = _class(chr(c) for c in range(128) if chr(c) not in inside)
        letters = {c for c in inside if c.isalpha()}
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            return f"[{alone}]|[^{alone}]+" if alone else ".+"
        if any(len({c in letters for c in p.lstrip(SPACE)}) > 1 for p in longer):
            letters = inside - {SPACE}
        own = _class(letters)
        return f"{SPACE}*[{own}]+|{SPACE}*[^{own}{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")

    def merge(self, text: str) -> list[str]:
        """Join the pair of the best score, the leftmost of equals, until no pair is a piece. For short texts."""
        parts, rank, none = list(text), self.rank, float("inf")
        while len(parts) > 1:
            ranks = [rank.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _text(self, token: int) -> str:
        return self.texts[token] if token < self.size else chr(token - self.size)

    def _lengths(self, tokens: np.ndarray) -> np.ndarray:
        points = tokens - self.size
        return np.where(points < 0, self.length[np.minimum(tokens, self.size - 1)], 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))

    def _next_shorter(self, tokens: np.ndarray) -> np.ndarray:
        """The longest pieces that begin these; a single character has none."""
        return np.where(tokens < self.size, self.shorter[np.minimum(tokens, self.size - 1)], -1)

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two neighbours stay what they are when they are merged anew."""
        keys = left * (self.size + 0x110000) + right
        slots = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % PAIRS
        found, known = self.fits[slots], self.pairs[slots] == keys
        if not known.all():
            rest = np.nonzero(~known)[0]
            new, first, back = np.unique(keys[rest], return_index=True, return_inverse=True)
            first = rest[first]
            fits = np.empty(len(new), bool)
            for k, (a, b) in enumerate(zip(left[first].tolist(), right[first].tolist(), strict=True)):
                a, b = self._text(a), self._text(b)
                fits[k] = self.merge(a + b) == [a, b]
            found[rest] = fits[back]
            for k, slot in enumerate(slots[first].tolist()):
                self.pairs[slot], self.fits[slot] = new[k], fits[k]
        return found

    def _longest(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each octet the token that is tried first: the longest piece, else the character."""
        found = self.automaton.begins(data, starts, sizes).astype(np.int64)
        at = np.nonzero((found < 0) & ((data & 0xC0) != 0x80))[0]
        if len(at):
            lead = data[at].astype(np.int64)
            more = (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
            point = np.where(more > 0, lead & (0x3F >> more), lead)
            for k in (1, 2, 3):
                goes_on = more >= k
                point[goes_on] = point[goes_on] << 6 | (data[at[goes_on] + k] & 0x3F)
            found[at] = self.size + point
        return found

    def tokens(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of chunks of up to 63 octets, one after the other, and how many each has."""
        octets = [c.encode() for c in chunks]
        sizes = np.fromiter(map(len, octets), np.int64, len(octets))
        data, starts = np.frombuffer(b"".join(octets), np.uint8), np.cumsum(sizes) - sizes
        longest = self._longest(data, starts, sizes)
        stack = np.empty((len(chunks), int(sizes.max())), np.int32)
        at, depth, failed = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.uint64)
        tried, active = longest[starts], np.arange(len(chunks))
        while len(active):
            back = active[tried[active] < 0]
            if len(back):  # nothing fits here: the piece before was wrong
                failed[back] |= np.uint64(1) << at[back].astype(np.uint64)
                depth[back] -= 1
                piece = stack[back, depth[back]].astype(np.int64)
                at[back] -= self._lengths(piece)
                tried[back] = self._next_shorter(piece)
            here = active[tried[active] >= 0]
            piece = tried[here]
            end = at[here] + self._lengths(piece)
            fits = failed[here] >> end.astype(np.uint64) & np.uint64(1) == 0
            behind = np.nonzero(fits & (depth[here] > 0))[0]
            fits[behind] = self._fit(stack[here[behind], depth[here[behind]] - 1].astype(np.int64), piece[behind])
            tried[here[~fits]] = self._next_shorter(piece[~fits])
            put = here[fits]
            stack[put, depth[put]] = piece[fits]
            depth[put] += 1
            at[put] = end[fits]
            goes_on = put[at[put] < sizes[put]]
            tried[goes_on] = longest[starts[goes_on] + at[goes_on]]
            active = active[at[active] < sizes[active]]
        return stack[np.arange(stack.shape[1]) < depth[:, None]], depth

    def long_tokens(self, chunk: str) -> list[int]:
        """The same for one chunk of any length."""
        data = np.frombuffer(chunk.encode(), np.uint8)
        longest = self._longest(data, np.zeros(1, np.int64), np.array([len(data)])).tolist()
        failed, found = bytearray(len(data) // 8 + 1), []
        length = lambda t: int(self.length[t]) if t < self.size else len(chr(t - self.size).encode())
        shorter = lambda t: int(self.shorter[t]) if t < self.size else -1
        known: dict[tuple[int, int], bool] = {}
        at, tried = 0, longest[0]
        while True:
            end = at + length(tried)
            fits = not failed[end >> 3] >> (end & 7) & 1
            if fits and found:
                pair = (found[-1], tried)
                if pair not in known:
                    known[pair] = bool(self._fit(np.array([pair[0]]), np.array([pair[1]]))[0])
                fits = known[pair]
            if fits:
                found.append(tried)
                if end == len(data):
                    return found
                at, tried = end, longest[end]
                continue
            tried = shorter(tried)
            while tried < 0:
                failed[at >> 3] |= 1 << (at & 7)
                at -= length(found[-1])
                tried = shorter(found.pop())

    def _learn(self, chunks: list[str]) -> None:
        flat, counts = [self.flat], [np.diff(self.ends)]
        is_short = [len(c) <= SHORT and len(c.encode()) <= SHORT for c in chunks]
        short = [c for c, own in zip(chunks, is_short, strict=True) if own]
        made = [self.tokens(short[k : k + TOGETHER]) for k in range(0, len(short), TOGETHER)]
        tokens, sizes = (np.concatenate([m[k] for m in made] or [np.empty(0, np.int64)]) for k in (0, 1))
        long = [self.long_tokens(c) for c, own in zip(chunks, is_short, strict=True) if not own]
        if long:  # back into the order of the chunks
            ends, parts, own_long = np.cumsum(sizes), [], iter(long)
            own_short = iter(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
            for own in is_short:
                parts.append(tokens[slice(*next(own_short))] if own else np.array(next(own_long)))
            tokens, sizes = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        odd = np.nonzero(tokens >= self.size)[0]
        if len(odd):  # characters that are no piece become their octets
            which = np.repeat(np.arange(len(sizes)), sizes)
            spelt = [[self.octets[o] for o in chr(t - self.size).encode()] for t in tokens[odd].tolist()]
            times = np.ones(len(tokens), np.int64)
            times[odd] = [len(x) for x in spelt]
            sizes = np.bincount(which, weights=times, minlength=len(sizes)).astype(np.int64)
            starts = np.cumsum(times) - times
            tokens = np.repeat(tokens, times)
            for at, ids in zip(starts[odd].tolist(), spelt, strict=True):
                tokens[at : at + len(ids)] = ids
        self.flat = np.concatenate([*flat, tokens.astype(np.int32)])
        self.ends = np.concatenate([[0], np.cumsum(np.concatenate([*counts, sizes]))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and where each text's end."""
        if len(self.known) > REMEMBERED:
            self._forget()
        at: list[int] = []
        ends = []
        for text in texts:
            if text:
                at += map(self.known.__getitem__, self.chunks.findall(self.prefix + text.replace(" ", SPACE)))
            ends.append(len(at))
        new = list(islice(self.known, len(self.ends) - 1, None))
        if new:
            self._learn(new)
        number = np.array(at, np.int64)
        sizes = np.diff(self.ends)[number]
        whole = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.ends[number] - whole[:-1], sizes) + np.arange(whole[-1])]
        return ids, whole[np.array(ends, np.int64)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    with open(path, "rb") as file:
        return Encoder(file.read())


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, ids array<int>), a row for each input row.

    A null or empty text has no ids; every other text has those of the sentencepiece library for the model file at
    ``model``, without begin and end. Texts may be of any length and need not hold spaces. Repeated rows give repeated
    rows, rows without a doc_id stay; other columns are ignored; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            flat, ends = encoder(model).encode([t or "" for t in part.column(1).to_pylist()])
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>, ...) -> (doc_id, ids, text) with the library's text of the ids; null or empty ids give ''.

    An id that the model doesn't have is an error. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        own = None
        for part in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            own = own or SentencePieceProcessor(model_file=model)
            texts = [own.decode(ids) if ids else "" for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    ids = F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), ids).mapInArrow(run, "doc_id long, ids array<int>, text string")
