"""Byte-pair merging by a contiguous rank array, and the vocabulary files it reads.

A word is held as a list of part ids and a parallel list of adjacent pair ranks. The least rank is
found by scanning, one boundary is deleted, and only the neighbouring ranks are looked up again.
Words beyond LONG parts take a heap over the same ranks, so that one huge word costs n log n.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import regex

#: Parts beyond which the scan for the minimum is replaced by a heap.
LONG = 200
NONE = 1 << 62


@lru_cache(maxsize=1)
def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class Ranks:
    """A vocabulary with its merge ranks: pair of ids -> rank and merged id, packed in one integer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in {**self.ids, **self.special}.items()}
        self.pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            key = self.ids[a] << 20 | self.ids[b]
            # a merge drops no characters: only the last part of a word bears the suffix
            self.pairs.setdefault(key, rank << 20 | self.ids[a + b])
        chars = byte_chars()
        self.unit = [self.ids[c] for c in chars]
        self.last = [self.ids[c + self.suffix] for c in chars]

    def parts(self, word: bytes) -> list[int]:
        unit = self.unit
        out = [unit[b] for b in word]
        if out:
            out[-1] = self.last[word[-1]]
        return out

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word of the pre-tokenizer."""
        return self.merge(self.parts(word))

    def merge(self, parts: list[int]) -> list[int]:
        if len(parts) > LONG:
            return self._merge_long(parts)
        get = self.pairs.get
        ranks = [get(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = new = least & 0xFFFFF
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << 20 | parts[i + 1], NONE)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | new, NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        get, n = self.pairs.get, len(parts)
        left, right = [i - 1 for i in range(n)], [i + 1 for i in range(n)]
        live = [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := get(parts[i] << 20 | parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i] if live[i] else n
            if j >= n or get(parts[i] << 20 | parts[j], NONE) != r:
                continue
            parts[i] = r & 0xFFFFF
            live[j], right[i] = False, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (q := get(parts[i] << 20 | parts[right[i]], NONE)) != NONE:
                    heapq.heappush(heap, (q, i))
            if left[i] >= 0 and (q := get(parts[left[i]] << 20 | parts[i], NONE)) != NONE:
                heapq.heappush(heap, (q, left[i]))
        return [p for p, on in zip(parts, live) if on]


@lru_cache(maxsize=4)
def ranks(path: str) -> Ranks:
    """One per Python worker: workers are reused between tasks."""
    return Ranks(path)


class WordCache(dict):
    """word -> what `make` gives; holds the first `most` words, others are made anew each time."""

    def __init__(self, make, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        got = self.make(word)
        if len(self) < self.most and len(word) <= 64:
            self[word] = got
        return got


class Splitter:
    """findall() of a pattern made for given classes: Unicode's, or for texts within Latin-1 the same classes listed, which is faster.

    `pattern` names the classes inside brackets only, as {L}, {N} and {S} (letters, numbers, white space).
    """

    def __init__(self, pattern: str):
        latin = "".join(map(chr, range(256)))
        wide = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\s"}
        listed = {k: "".join(map(re.escape, regex.findall(v, latin))) for k, v in wide.items()}
        self.full = regex.compile(pattern.format(**wide)).findall
        self.latin = re.compile(pattern.format(**listed)).findall

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.full(text)
        return self.latin(text)
