"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are lower-cased with white space as single spaces. A random walk (CGK) maps a string to one in
which few edits become few differing places: at each step it writes the current character and moves on or
stays, by a random bit for the step and the character. Each of WALKS walks gives SAMPLES hashes of PLACES places
sampled from the embedding; a window and an item that agree in one hash are candidates. Windows are as long as
the item and begin at word starts near WHOLE pieces of an item, and where those pieces themselves put the item's start,
which needs no spaces in the text. An item within its allowed edits keeps WHOLE of its (edits + WHOLE) pieces whole, so
each one within reach has its windows. Candidates are
verified by their exact edit distance. recall() estimates the chance of a candidate by experiment.

Items are taken in blocks of a bounded number of characters, each against all documents.

Items shorter than `shortest` after normalisation would be found by chance within edits or inside words: they are
searched for as they are, between word ends. An item of n characters takes 64 n bytes and some 10 n microseconds to embed.

Edge cases: null and empty texts match nothing; null or empty items are not searched for; equal items each match; a document that holds an item several times gives
one row with the least edits; rows with the same key are taken together; a null key is kept; extra columns are ignored.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.edits import best_within

#: Walks, hashes of each walk, places of each hash.
WALKS, SAMPLES, PLACES = 8, 10, 3
#: Edits allowed for each hundred characters of an item.
PERCENT = 10
MIN_CHARS = 24
#: Pieces of an item that must be there unedited.
WHOLE = 5
#: Steps after which a walk's random bits come again; characters that are embedded at a time, which take 64 bytes each, and of windows that are held for it.
CYCLE, CELLS, HELD = 8192, 400_000, 4_000_000
#: Characters of the items in one block: what one task holds in memory is a few times as much.
BLOCK_CHARS = 4_000_000


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


@lru_cache(maxsize=4)
def _walks(steps: int) -> np.ndarray:
    """Random bits for (walk, step, character modulo 256); from CYCLE steps on they come again."""
    return np.random.default_rng(7).integers(0, 2, (steps, WALKS, 256), dtype=np.uint8).transpose(1, 0, 2)


@lru_cache(maxsize=1)
def _places() -> np.ndarray:
    return np.sort(np.random.default_rng(11).random((WALKS, SAMPLES, PLACES)), axis=2)


def embedded_hashes(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(rows, WALKS * SAMPLES) hashes of strings given as padded rows of characters.

    Walks take two steps to a character on average, so places are sampled from the first 2 * size steps.
    """
    rows, width = codes.shape
    padded = np.concatenate([codes, np.zeros((rows, 1), codes.dtype)], axis=1)
    steps = int(2 * sizes.max())
    bits = _walks(min(CYCLE, 1 << max(10, (steps - 1).bit_length())))
    out = np.zeros((rows, WALKS, SAMPLES), np.uint64)
    at, walk, last = np.arange(rows), np.arange(WALKS)[:, None], np.minimum(sizes, width)
    wanted = (_places()[None] * (2 * sizes)[:, None, None, None]).astype(np.int64)
    i, seen = np.zeros((WALKS, rows), np.int64), np.empty((WALKS, rows, steps), codes.dtype)
    for step in range(steps):
        c = padded[at, i]
        seen[:, :, step] = c
        i = np.minimum(i + bits[:, step % bits.shape[1]][walk, c & 255], last)
    for k in range(WALKS):
        got = np.take_along_axis(seen[k][:, None, :], wanted[:, k].reshape(rows, 1, -1), axis=2).reshape(rows, SAMPLES, PLACES)
        for p in range(PLACES):
            out[:, k] = out[:, k] * np.uint64(1_000_003) + got[:, :, p].astype(np.uint64) + np.uint64(1)
    tables = np.arange(WALKS * SAMPLES, dtype=np.uint64)
    return out.reshape(rows, -1) * np.uint64(WALKS * SAMPLES) + tables


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in strings], np.int64)
    width = int(sizes.max())
    raw = "".join(s.ljust(width, "\0") for s in strings).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32).reshape(len(strings), width), sizes


def hashes_of(strings: list[str]) -> np.ndarray:
    """embedded_hashes() of strings of any lengths: those of like length together, at most CELLS characters with their padding at a time."""
    out = np.zeros((len(strings), WALKS * SAMPLES), np.uint64)
    order = sorted(range(len(strings)), key=lambda k: len(strings[k]))
    first = 0
    for k in range(1, len(order) + 1):
        if k == len(order) or (k + 1 - first) * len(strings[order[k]]) > CELLS:
            out[order[first:k]] = embedded_hashes(*_codes([strings[x] for x in order[first:k]]))
            first = k
    return out


class Index:
    """Pieces and hashes of one block of items."""

    def __init__(self, items: list[tuple[int, str]], percent: int, shortest: int = MIN_CHARS):
        self.items, self.percent, self.shortest = items, percent, shortest
        self.pieces, self.short = ahocorasick.Automaton(), ahocorasick.Automaton()
        for n, (_, text) in enumerate(items):
            if len(text) < shortest:
                self.short.get(text, None) is None and self.short.add_word(text, (len(text), []))
                self.short.get(text)[1].append(n)
                continue
            parts = self.edits(text) + WHOLE
            cuts = [len(text) * k // parts for k in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:]):
                self.pieces.get(text[a:b], None) is None and self.pieces.add_word(text[a:b], [])
                self.pieces.get(text[a:b]).append((n, b))
        self.pieces.make_automaton()
        self.short.make_automaton()
        self.table: dict[tuple[int, int], list[int]] = {}
        for at in range(0, len(items), 256):
            part = [(n, items[n][1]) for n in range(at, min(at + 256, len(items))) if len(items[n][1]) >= shortest]
            for (n, t), hashes in zip(part, hashes_of([t for _, t in part])):
                for h in hashes.tolist():
                    self.table.setdefault((len(t), h), []).append(n)

    def edits(self, text: str) -> int:
        return len(text) * self.percent // 100

    def windows(self, text: str) -> set[tuple[int, int]]:
        """(start, size) of the windows, at word starts and where pieces put the start, from which an item of that size may be reached."""
        hits: dict[int, set[tuple[int, int]]] = {}
        if not len(self.pieces):
            return set()
        for end, found in self.pieces.iter(text):
            for n, b in found:
                hits.setdefault(n, set()).add((end + 1 - b, b))
        out = set()
        for n, found in hits.items():
            if len(found) < WHOLE:
                continue
            size, slack, marks = len(self.items[n][1]), self.edits(self.items[n][1]), sorted(found)
            left, inside = 0, Counter()  # marks within twice the slack, by piece
            for at, piece in marks:
                inside[piece] += 1
                while at - marks[left][0] > 2 * slack:
                    inside[marks[left][1]] -= 1
                    if not inside[marks[left][1]]:
                        del inside[marks[left][1]]
                    left += 1
                if len(inside) >= WHOLE:
                    low, high = max(0, at - slack), at + slack
                    starts = [k + 1 for k in _all(text, " ", max(0, low - 1), high)] + ([0] if low == 0 else [])
                    starts += [max(0, marks[left][0]), max(0, at)]
                    out.update((k, size) for k in starts if k + size <= len(text) + slack)
        return out

    def _parts(self, windows: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
        """Windows in parts of about HELD characters."""
        part, size = [], 0
        for w in windows:
            part.append(w)
            size += w[2]
            if size >= HELD:
                yield part
                part, size = [], 0
        if part:
            yield part

    def matches(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text's place, item's place, least edits) for the items found in normalised texts."""
        windows = sorted((k, *w) for k, t in enumerate(texts) for w in self.windows(t))
        best: dict[tuple[int, int], int] = {}
        for k, t in enumerate(texts) if len(self.short) else ():
            for last, (size, found) in self.short.iter(t):
                first = last - size + 1
                inside = first > 0 and t[first - 1].isalnum() and t[first].isalnum() or t[last].isalnum() and t[last + 1 : last + 2].isalnum()
                if not inside:
                    best.update(((k, n), 0) for n in found)
        for part in self._parts(windows):
            hashes = hashes_of([texts[k][s : s + n].ljust(n, "\0") for k, s, n in part])
            for (k, start, size), row in zip(part, hashes.tolist()):
                for n in {n for h in row for n in self.table.get((size, h), ())}:
                    slack = self.edits(self.items[n][1])
                    if best.get((k, n), slack + 1) == 0:
                        continue
                    edits, _ = best_within(self.items[n][1], texts[k][max(0, start - slack) : start + size + slack])
                    if edits <= slack:
                        best[k, n] = min(edits, best.get((k, n), edits))
        return [(k, n, e) for (k, n), e in best.items()]


def _all(text: str, what: str, low: int, high: int) -> Iterator[int]:
    at = text.find(what, low, high)
    while at >= 0:
        yield at
        at = text.find(what, at + 1, high)


@lru_cache(maxsize=2)
def _index(items: tuple, percent: int, shortest: int) -> Index:
    return Index(list(items), percent, shortest)


def recall(items: list[str], percent: int = PERCENT, trials: int = 5, seed: int = 1) -> float:
    """Share of items, edited up to the allowed share of characters at random places, that their window's hashes bring up."""
    rnd, hit, n = random.Random(seed), 0, 0
    for text in map(normalised, items):
        if len(text) < MIN_CHARS:
            continue
        index = Index([(0, text)], percent)
        for _ in range(trials):
            chars = list(text)
            for _ in range(index.edits(text)):
                k = rnd.randrange(len(chars))
                kind = rnd.randrange(3)
                chars[k : k + (kind != 0)] = [rnd.choice("etaoin")] if kind < 2 else []
            window = "".join(chars)[: len(text)].ljust(len(text), "\0")
            row = embedded_hashes(*_codes([window]))[0].tolist()
            hit += any((len(text), h) in index.table for h in row)
            n += 1
    return hit / max(1, n)


def blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of about BLOCK_CHARS characters; one block at a time comes to the driver."""
    rows = items.select(F.col(key).alias("id"), F.col(text).alias("t")).where("t IS NOT NULL")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = total // BLOCK_CHARS + 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == k) if n > 1 else rows
        found = sorted({(r["id"], s) for r in part.collect() if (s := normalised(r["t"]))}, key=lambda x: (x[0] is None, x))
        if found:
            yield found


def leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", shortest: int = MIN_CHARS) -> DataFrame:
    """(key, item_key, edits, similarity): every item that a document holds within percent edits per hundred characters; items under `shortest` characters between word ends and without edits."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL")
    kinds = dict(rows.dtypes)["k"], dict(items.dtypes)[item_key]
    spark, found = docs.sparkSession, None
    for block in blocks(items, item_key, item_text):
        shared = spark.sparkContext.broadcast(tuple(block))  # at most about BLOCK_CHARS characters

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = _index(shared.value, percent, shortest)
            for batch in batches:
                out = index.matches([normalised(t) for t in batch["t"]])
                at = [o[0] for o in out]
                yield pd.DataFrame({
                    "k": batch["k"].to_numpy()[at],
                    "i": pd.Series([index.items[o[1]][0] for o in out], dtype=object),
                    "edits": pd.Series([o[2] for o in out], dtype="int64"),
                    "similarity": pd.Series([1 - o[2] / len(index.items[o[1]][1]) for o in out], dtype=float),
                })

        part = rows.mapInPandas(run, f"k {kinds[0]}, i {kinds[1]}, edits long, similarity double")
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], f"k {kinds[0]}, i {kinds[1]}, edits long, similarity double")
    return found.groupBy("k", "i").agg(F.min("edits").alias("edits"), F.max("similarity").alias("similarity")).withColumnsRenamed({"k": key, "i": item_key})
