"""Exact token counts at every prefix of a text, by prefix dynamic programming.

For a word of the pre-tokenizer, the last token of each prefix is the one vocabulary entry that ends
there and is compatible with the last token of what stands before it; the prefix then counts one more
token than what stands before. Words give their counts as steps from character to character, so a text's
counts are the running sum of its words' steps. Three spots, where the pre-tokenizer cuts a prefix
otherwise than the whole text, are set right: the last of several white-space characters before a word,
contractions of three characters, and the inside of a special token.

Edge cases: a null text counts as empty and has the counts [0]; repeated rows give repeated results;
columns other than the key and the text are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.bpe import Splitter, WordCache, byte_chars, ranks

#: Fixed value: the pre-tokenizer pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
GAP = regex.compile(r"\s\s+(?=\S)")
#: Stands before the first token of a word.
START = 0xFFFFF
THREE = ("'re", "'ve", "'ll")


class PrefixCounter:
    """Counts for one byte-level vocabulary file."""

    def __init__(self, path: str):
        self.ranks = ranks(path)
        chars = {c: b for b, c in enumerate(byte_chars())}
        self.tokens = {bytes(chars[c] for c in t): i for t, i in self.ranks.ids.items()}
        self.bytes = {i: b for b, i in self.tokens.items()}
        #: every tail of a token; its id where the tail is itself a token, else -1
        self.tails = {t[k:]: -1 for t in self.tokens for k in range(len(t))} | self.tokens
        self.fits: dict[int, bool] = {}
        self.split = Splitter(PATTERN)
        specials = sorted(self.ranks.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.steps = WordCache(self._steps, 800_000)

    def _fit(self, key: int) -> bool:
        """Whether the pair stays as it is when its bytes are encoded; for a pair with START, whether the token does."""
        a, b = key >> 20, key & 0xFFFFF
        first = [] if a == START else [a]
        known = self.ranks.encode(b"".join(self.bytes[i] for i in first) + self.bytes[b]) == [*first, b]
        if len(self.fits) < 500_000:
            self.fits[key] = known
        return known

    def word(self, word: bytes) -> list[int]:
        """Token counts of the prefixes of 0, 1, 2, ... bytes of one word."""
        counts, last = [0], [START << 20]
        known, tail, fit = self.fits.get, self.tails.get, self._fit
        for end in range(1, len(word) + 1):
            start = end - 1
            while True:
                got = tail(word[start:end])
                if got >= 0:
                    key = last[start] | got
                    good = known(key)
                    if good or good is None and fit(key):
                        break
                start -= 1
            counts.append(counts[start] + 1)
            last.append(got << 20)
        return counts

    def _counts(self, word: str) -> list[int]:
        """Counts at the characters of one word."""
        raw = word.encode()
        counts = self.word(raw)[1:]
        if len(raw) != len(word):
            ends = [i for i in range(len(raw)) if i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80]
            counts = [counts[i] for i in ends]
        if word in THREE:
            counts[1] = 2  # before its last letter it isn't a contraction yet
        return counts

    def _steps(self, word: str) -> bytes:
        counts = self._counts(word)
        return array("h", [b - a for a, b in zip([0, *counts], counts)]).tobytes()

    def plain(self, text: str) -> np.ndarray:
        """Counts after each character of a text without special tokens."""
        steps = np.frombuffer(b"".join(map(self.steps.__getitem__, self.split(text))), np.int16)
        counts = np.cumsum(steps, dtype=np.int32)
        for gap in GAP.finditer(text) if "  " in text or not text.isprintable() or "\xa0" in text or "　" in text else ():
            start, end = gap.span()
            counts[end - 1] = (counts[start - 1] if start else 0) + self._counts(gap.group())[-1]
        return counts

    def counts(self, text: str | None) -> np.ndarray:
        """counts[i]: tokens of the text's first i characters, for i from 0 to its length."""
        parts, base = [np.zeros(1, np.int32)], 0
        pieces = self.special.split(text or "") if self.special and text and any(s in text for s in self.ranks.special) else [text or ""]
        for k in range(0, len(pieces), 2):
            piece, name = pieces[k], pieces[k + 1] if k + 1 < len(pieces) else ""
            own = self.plain(piece + name[:-1]) if piece or name else np.zeros(0, np.int32)
            parts.append(own + base)
            if name:
                base += int(own[len(piece) - 1]) + 1 if piece else 1
                parts.append(np.array([base], np.int32))
        return np.concatenate(parts)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_table(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and prefix_tokens, an array<int> with the exact token count of every prefix (index 0: the empty prefix)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "prefix_tokens": [own.counts(t) for t in batch["t"]]})

    rows = _rows(docs, key, text)
    return rows.mapInPandas(run, f"k {dict(rows.dtypes)['k']}, prefix_tokens array<int>").withColumnRenamed("k", key)


def tokens_of(prefix: F.Column) -> F.Column:
    """Tokens of the whole text, from its prefix counts."""
    return F.element_at(prefix, -1)


def tokens_at(prefix: F.Column, chars: F.Column) -> F.Column:
    """Tokens of the first `chars` characters, without encoding again; past the end, of the whole text."""
    return F.element_at(prefix, F.least(chars.cast("int"), F.size(prefix) - 1) + 1)


def longest_within(prefix: F.Column, budget: int) -> F.Column:
    """Characters of the longest prefix that has at most `budget` tokens."""
    return F.aggregate(
        prefix,
        F.struct(F.lit(-1).alias("at"), F.lit(0).alias("best")),
        lambda a, n: F.struct((a["at"] + 1).alias("at"), F.when(n <= budget, a["at"] + 1).otherwise(a["best"]).alias("best")),
        lambda a: a["best"],
    )


def budgets(docs: DataFrame, path: str, budget: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit and fits_chars (the longest prefix within the budget), all read off the prefix counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for batch in batches:
            rows = []
            for t in batch["t"]:
                at = own.counts(t)
                n = int(at[-1])
                fits = len(at) - 1 if n <= budget else int(np.flatnonzero(at <= budget)[-1])
                rows.append((len(t.encode()), n, n > budget, fits))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_tokens", "over_limit", "fits_chars"]).assign(k=batch["k"].values)[["k", "n_bytes", "n_tokens", "over_limit", "fits_chars"]]

    rows = _rows(docs, key, text)
    return rows.mapInPandas(run, f"k {dict(rows.dtypes)['k']}, n_bytes long, n_tokens long, over_limit boolean, fits_chars long").withColumnRenamed("k", key)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
