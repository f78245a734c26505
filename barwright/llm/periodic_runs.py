"""Runs of repeated words in a text: maximal stretches with a period, found by suffix trees.

A run [start, start + length) has a smallest period p, at least two periods and at least `shortest` words, and neither
neighbouring word keeps the period. Ukkonen's algorithm builds the suffix trees of a stretch of words and of its reversal;
a sparse table over the Euler tour of each gives the longest common extension of two places in constant time. A run's
repeating unit has a rotation that is a longest Lyndon word at its place, for one of the two orders of the words, so the
two Lyndon words at each place are the only candidates, and each is extended in both directions.

Words of a run of 12 or more are covered by groups of six words that the text holds twice, so trees are built only over
the stretches that such groups cover; that leaves out no run. Memory: about 700 bytes for each word of a stretch.

Edge cases: a null or empty text has no words and no runs; a null key is allowed; rows that repeat give rows that repeat;
columns other than the key and the text are ignored; equal words are equal strings, case and accents included.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are parted by blanks and by the ASCII characters from tab to carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words that a run has at least, and of the groups whose repetition a run of that length needs.
SHORTEST, GROUP = 12, 6


class SuffixTree:
    """Ukkonen's tree of letters above 0; the end is a letter 0 that comes before all others."""

    def __init__(self, letters: list[int]):
        text = [*letters, 0]
        self.size, self.letters = len(text), max(text) + 1
        width, size = self.letters, self.size
        first, stop, link = [0], [0], [0]
        child: dict[int, int] = {}
        node = edge = length = waiting = 0
        for i, c in enumerate(text):
            waiting, last = waiting + 1, 0
            while waiting:
                if not length:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(first)
                    first.append(i)
                    stop.append(size)
                    link.append(0)
                    if last:
                        link[last], last = node, 0
                else:
                    begin, end = first[below], stop[below]
                    own = (end if end <= i else i + 1) - begin
                    if length >= own:
                        edge, length, node = edge + own, length - own, below
                        continue
                    if text[begin + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(first)
                    first += (begin, i)
                    stop += (begin + length, size)
                    link += (0, 0)
                    child[key] = split
                    first[below] = begin + length
                    child[split * width + text[begin + length]] = below
                    child[split * width + c] = split + 1
                    if last:
                        link[last] = split
                    last = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length, edge = length - 1, i - waiting + 1
        n = len(first)
        keys, self.child = np.fromiter(child.keys(), np.int64, n - 1), np.fromiter(child.values(), np.int64, n - 1)
        del child, link
        self.parent, self.letter = np.divmod(keys, width)
        self.length = np.array(stop) - np.array(first)
        self._tour()

    def _walk(self, letter: np.ndarray) -> tuple[list[int], list[int]]:
        """Suffixes in the order of a walk that takes children by letter; between neighbours, the depth of the highest node passed."""
        order = np.lexsort((letter, self.parent))
        kids, n = self.child[order].tolist(), len(self.length)
        bounds = np.searchsorted(self.parent[order], np.arange(n + 1)).tolist()
        length, size = self.length.tolist(), self.size
        leaves, highest, low = [], [], 0
        todo, depths = [0], [0]
        while todo:
            node, depth = todo.pop(), depths.pop()
            if node < 0:  # back at a node after one of its children
                low = min(low, depth)
                continue
            a, b = bounds[node], bounds[node + 1]
            if a == b:
                if leaves:
                    highest.append(low)
                leaves.append(size - depth)
                low = size
            else:
                for kid in reversed(kids[a:b]):
                    todo += (-1, kid)
                    depths += (depth, depth + length[kid])
        return leaves, highest

    def _tour(self) -> None:
        leaves, highest = self._walk(self.letter)
        self.rank = np.empty(self.size, np.int64)
        self.rank[leaves] = np.arange(self.size)
        self.table = [np.array(highest, np.int32)]
        while 2 ** len(self.table) <= len(highest):
            half, last = 2 ** (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Letters that the suffixes at a and b (different places) have in common: the depth of their lowest common ancestor."""
        x, y = self.rank[a], self.rank[b]
        low, n = np.minimum(x, y), np.abs(x - y)
        level = np.frexp(n.astype(np.float64))[1] - 1
        out = np.empty(len(n), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.table[k][low[own]], self.table[k][low[own] + n[own] - 2**k])
        return out

    def ranks(self, falling: bool) -> np.ndarray:
        """Places of the suffixes in order, by rising or falling letters; the end comes first in both."""
        if not falling:
            return self.rank
        out = np.empty(self.size, np.int64)
        out[self._walk(np.where(self.letter > 0, self.letters - self.letter, 0))[0]] = np.arange(self.size)
        return out


def _next_smaller(rank: list[int], n: int) -> np.ndarray:
    """For each suffix the next place with a smaller one, n if there is none: the longest Lyndon word at a place ends before it."""
    out, open_ = [n] * n, []
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while open_ and rank[open_[-1]] > r:
            open_.pop()
        if open_:
            out[i] = open_[-1]
        open_.append(i)
    return np.array(out, np.int64)


def _stretch_runs(letters: list[int], shortest: int) -> np.ndarray:
    """(start, length, period) of the runs of letters above 0."""
    n = len(letters)
    tree, back = SuffixTree(letters), SuffixTree(letters[::-1])
    found = []
    for falling in (False, True):
        i = np.arange(n)
        j = _next_smaller(tree.ranks(falling).tolist(), n)
        right = tree.extension(i, j)  # place n is the end, with nothing in common
        left = back.extension(n - i, n - j)
        period, start = j - i, i - left
        length = left + period + right
        good = length >= np.maximum(2 * period, shortest)
        found.append(np.column_stack([start, length, period])[good])
    return np.unique(np.concatenate(found), axis=0)


def word_runs(words: list[str], shortest: int = SHORTEST) -> np.ndarray:
    """Rows of start, length and period of all runs, sorted by start, then period."""
    none = np.zeros((0, 3), np.int64)
    if len(words) < shortest:
        return none
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    size = min(GROUP, shortest // 2)
    key = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(key)].astype(np.uint64) + np.uint64(1)
    held = np.sort(key)
    twice = held[1:][held[1:] == held[:-1]]
    if not len(twice):
        return none
    steps = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(np.isin(key, twice))
    np.add.at(steps, at, 1)
    np.add.at(steps, at + size, -1)
    covered = np.concatenate([[False], np.cumsum(steps)[:-1] > 0, [False]])
    bounds = np.flatnonzero(covered[1:] != covered[:-1])
    found = [none]
    for a, b in zip(bounds[::2], bounds[1::2]):
        if b - a >= shortest:
            _, letters = np.unique(ids[a:b], return_inverse=True)
            found.append(_stretch_runs((letters + 1).tolist(), shortest) + [a, 0, 0])
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def collapsed(words: list[str], runs: np.ndarray) -> list[str]:
    """The words without those that a run holds after its first period."""
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(steps)[:-1] == 0)]


RUNS = "array<struct<start: long, length: long, period: long>>"


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, change: Callable[[object, list[str]], list[str]] | None = None) -> DataFrame:
    """key, n_words, runs (start, length and period, by start and period) and collapsed, the words outside repeated periods, joined by blanks.

    `change` (key, words) -> words is applied to the words before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part, rows = batch.iloc[at : at + 500], []
                for k, t in zip(part["k"], part["t"]):
                    words = WORD.findall(t)
                    if change is not None:
                        words = change(None if pd.isna(k) else k, words)
                    runs = word_runs(words, shortest)
                    kept = collapsed(words, runs) if len(runs) else words
                    rows.append((len(words), [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()], " ".join(kept)))
                made = pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])
                made.insert(0, "k", part["k"].values)
                yield made

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInPandas(run, f"k {dict(rows.dtypes)['k']}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("k", key)


def longest(runs: Column) -> Column:
    """The run with the most words, null if there is none; ties go to the smallest start, then period."""
    better = lambda a, b: a.isNull() | (b["length"] > a["length"]) | ((b["length"] == a["length"]) & ((b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"]))))
    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda a, b: F.when(better(a, b), b).otherwise(a))


def planted(key: object, words: list[str]) -> list[str]:
    """The query's repetition: from a place on, the words of every tenth key (by checksum) repeat a period made of the key and the length."""
    h, n = zlib.crc32(str(int(key)).encode()) if key is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // len(unit) + 1))[: n - a]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; null without runs) and digests of all runs and of the collapsed text, after planted()."""
    got = find_runs(docs, change=planted).withColumn("best", longest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    return got.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
