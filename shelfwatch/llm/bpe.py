"""Byte-level BPE ids of whole texts, each distinct word encoded once.

The tokenizer's pattern always starts a new pre-token at a space that is followed by anything but white
space. So a text may be cut before such spaces and the ids of the parts joined. A worker remembers the parts
it has seen; new ones are encoded many in one string, with the merges of the same tokenizer file.
"""

from __future__ import annotations

import json
import os

import numpy as np

#: Distinct words that a worker remembers before it starts anew: bounds its memory, not what it encodes.
REMEMBERED = 1_000_000
#: The pre-token pattern of byte-level BPE (fixed value of the tokenizer file's kind).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _bytes_of_chars() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        self.special = tuple(x["content"] for x in stated["added_tokens"])
        chars, special = _bytes_of_chars(), set(self.special)
        ranks = {bytes(chars[c] for c in t): i for t, i in stated["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 1, bool)  # ids of tokens that start with a space
        self.opens[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self._forget()

    def _forget(self):
        self.numbers = _Numbers()
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = self.learnt = 0
        self.ends = np.zeros(1 << 12, np.int64)  # ends[k]: where word k - 1 ends
        self.odd = np.zeros(1 << 12, bool)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(len(ids), len(self.flat)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.ends[self.learnt + 1 : self.learnt + len(sizes) + 1] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.learnt += len(sizes)

    def _learn(self, words: list[str]) -> None:
        """Store the ids of new words. A leading space marks the first word of a text, which has none before it."""
        while self.learnt + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.odd = np.concatenate([self.odd, np.zeros_like(self.odd)])
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            plain = [w if w and not w[0].isspace() and not any(s in w for s in self.special) else "" for w in part]
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(w for w in plain if w)) if any(plain) else [], np.int64)
            starts = np.nonzero(self.opens[ids])[0] if len(ids) else ids
            sizes = np.zeros(len(part), np.int64)
            sizes[[k for k, w in enumerate(plain) if w]] = np.diff(starts, append=len(ids))
            if not all(plain):
                bounds, each = np.cumsum(sizes), []
                for k, w in enumerate(part):
                    if plain[k]:
                        each.append(ids[bounds[k] - sizes[k] : bounds[k]])
                    elif w[:1] == " ":
                        each.append(self.whole(w[1:]))
                    else:
                        each.append(self.whole(" " + w))
                        self.odd[self.learnt + k] = not w or w[0].isspace()
                ids, sizes = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
            self._store(ids, sizes)

    def encode(self, texts: list[str], closing: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each followed by ``closing`` if given, and the end of each text."""
        if len(self.numbers) > REMEMBERED:
            self._forget()
        tail, known, at, bounds = closing is not None, self.numbers, [], [0]
        for text in texts:
            parts = text.split(" ")
            parts[0] = " " + parts[0]
            at += map(known.__getitem__, parts)
            bounds.append(len(at))
        if len(known) > self.learnt:
            self._learn(list(known)[self.learnt :])
        at, bounds = np.array(at, np.int64), np.array(bounds)
        start = self.ends[at]
        counts = self.ends[at + 1] - start
        instead = {}
        for i in set((np.searchsorted(bounds, np.nonzero(self.odd[at])[0], side="right") - 1).tolist()):
            instead[i] = self.whole(texts[i])  # other white space follows a space: not cut
            counts[bounds[i] : bounds[i + 1]] = 0
            counts[bounds[i]] = len(instead[i])
        sums = np.cumsum(counts)
        grown = counts.copy()
        grown[bounds[1:] - 1] += tail
        ends = np.cumsum(grown)[bounds[1:] - 1]
        n = int(sums[-1]) if len(sums) else 0
        source = np.arange(n)
        source += np.repeat(start - (sums - counts), counts)
        body = self.flat[np.minimum(source, max(0, self.used - 1))] if n else np.empty(0, np.uint32)
        if tail:
            out = np.full(n + len(texts), closing, np.uint32)
            into = np.ones(len(out), bool)
            into[ends - 1] = False
            out[into] = body
        else:
            out = body
        for i, ids in instead.items():
            stop = int(ends[i]) - tail
            out[stop - len(ids) : stop] = ids
        return out, ends
