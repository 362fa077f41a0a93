"""Greedy longest-match word-piece lengths by a linear automaton, without building the pieces.

The vocabulary is a trie of bytes with two roots, for pieces that open a word and pieces that continue one. A
node that can't go on has a failure link to the node of what is left after its longest matches are popped, and
the number popped. Following links while reading gives the count in time linear in the word. All new words of
a batch walk the automaton in step with one another; a word seen before is looked up.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import _bytes_of_chars, _Numbers

#: Distinct words that a worker remembers before it starts anew: bounds its memory, not what it counts.
REMEMBERED = 1_000_000


def byte_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Opening and continuing pieces of a byte-level vocabulary file: the former start with a space."""
    with open(path, encoding="utf-8") as file:
        stated = json.load(file)
    special, chars = {x["content"] for x in stated["added_tokens"]}, _bytes_of_chars()
    tokens = sorted(bytes(chars[c] for c in t) for t in stated["model"]["vocab"] if t not in special)
    return [t for t in tokens if t[:1] == b" "], [t for t in tokens if t[:1] != b" "]


class Automaton:
    def __init__(self, opening: list[bytes], continuing: list[bytes]):
        children: list[dict[int, int]] = [{}, {}]  # node 0: a word begins; node 1: it goes on
        whole = [False, False]
        for root, pieces in enumerate((opening, continuing)):
            for piece in pieces:
                node = root
                for octet in piece:
                    if octet not in children[node]:
                        children[node][octet] = len(children)
                        children.append({})
                        whole.append(False)
                    node = children[node][octet]
                whole[node] = True
        fail, popped = [-1] * len(children), [0] * len(children)
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for octet, child in children[node].items():
                if whole[child]:
                    fail[child], popped[child] = 1, 1
                else:
                    z, count = fail[node], popped[node]
                    while z >= 0 and octet not in children[z]:
                        count += popped[z]
                        z = fail[z]
                    if z >= 0:
                        fail[child], popped[child] = children[z][octet], count
                queue.append(child)
        inner = [k for k, c in enumerate(children) if c]
        self.row = np.zeros(len(children), np.int32)  # row 0 of the table has no transition
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.table = np.full((len(inner) + 1, 256), -1, np.int32)
        for k, node in enumerate(inner, 1):
            self.table[k, list(children[node])] = list(children[node].values())
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """The number of pieces of each word; -1 where the vocabulary can't spell it."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")  # longest first: those still reading are a prefix
        node, count = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        shortest = np.cumsum(np.bincount(sizes, minlength=1)[::-1])[::-1] if len(words) else np.zeros(1, np.int64)
        for at in range(1, len(shortest)):
            live = order[: shortest[at]]
            live = live[node[live] >= 0]
            octet = data[starts[live] + at - 1]
            here, left = node[live], np.arange(len(live))
            to = self.table[self.row[here], octet]
            stuck = left[to < 0]
            while len(stuck):
                count[live[stuck]] += self.popped[here[stuck]]
                here[stuck] = self.fail[here[stuck]]
                lost = here[stuck] < 0
                node[live[stuck[lost]]] = -1
                stuck = stuck[~lost]
                to[stuck] = self.table[self.row[here[stuck]], octet[stuck]]
                stuck = stuck[to[stuck] < 0]
            alive = node[live] >= 0
            node[live[alive]] = to[alive]
        left = np.nonzero(node > 1)[0]
        while len(left):
            count[left] += self.popped[node[left]]
            node[left] = self.fail[node[left]]
            left = left[node[left] > 1]
        return np.where(node < 0, -1, count)


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_words, n_tokens, n_unknown), a row for each input row.

    Words are runs without ASCII white space; each is read with one space before it. A word that the vocabulary
    can't spell counts as one token and as unknown. A null or empty text has zeros. ``vocabulary`` is the path of
    a byte-level vocabulary file. Other columns are ignored; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known, sizes = None, _Numbers(), np.empty(0, np.int64)
        for batch in batches:
            automaton = automaton or Automaton(*byte_pieces(vocabulary))
            at, ends = [], []
            if len(known) > REMEMBERED:
                known, sizes = _Numbers(), np.empty(0, np.int64)
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                at += map(known.__getitem__, (text or b"").split())
                ends.append(len(at))
            new = list(known)[len(sizes) :]
            if new:
                sizes = np.concatenate([sizes, automaton.lengths([b" " + w for w in new])])
            each, ends = sizes[np.array(at, np.int64)], np.array(ends, np.int64)
            words = np.diff(ends, prepend=0)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0) for x in (np.where(each < 0, 1, each), each < 0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, *sums))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    schema = "doc_id long, n_words long, n_tokens long, n_unknown long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
