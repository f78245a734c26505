"""BPE encoding and decoding with a word-end vocabulary, by the contiguous rank array of bpe.py.

Edge cases: a null text counts as empty and gives no ids and an empty decoding; repeated rows give
repeated results; a null id column is passed through; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.bpe import Splitter, WordCache, ranks

#: Fixed value: the pre-tokenizer pattern of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"


def normalized(text: str) -> str:
    """NFC, then lower case character by character (a final sigma isn't told apart)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Codec:
    """Encoder and decoder of one vocabulary file, with a bounded cache of words."""

    def __init__(self, path: str):
        self.ranks = ranks(path)
        self.words = Splitter(PATTERN)
        specials = sorted(self.ranks.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.cache = WordCache(self._word)

    def _word(self, word: str) -> tuple[str, str]:
        ids = self.ranks.encode(word.encode())
        return " ".join(map(str, ids)), self.decode(ids)

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of text, and whether each is a special token."""
        if self.special is None or not any(s in text for s in self.ranks.special):
            yield text, False
            return
        for n, part in enumerate(self.special.split(text)):
            if part:
                yield part, n % 2 == 1

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for part, special in self.segments(text or ""):
            if special:
                out.append(self.ranks.special[part])
            else:
                for word in self.words(normalized(part)):
                    out += map(int, self.cache[word][0].split())
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary names no decoder: token names are joined by a space."""
        names = self.ranks.names
        return " ".join([names[i] for i in ids])

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and hashes of the ids and of the text decoded from them, word by word."""
        ids: list[str] = []
        back: list[str] = []
        for part, special in self.segments(text or ""):
            if special:
                ids.append(str(i := self.ranks.special[part]))
                back.append(self.decode([i]))
            elif got := list(map(self.cache.__getitem__, self.words(normalized(part)))):
                ids += [g[0] for g in got]
                back += [g[1] for g in got]
        joined = " ".join(ids)
        sha = hashlib.sha256
        return joined.count(" ") + bool(joined), sha(joined.encode()).hexdigest(), sha(" ".join(back).encode()).hexdigest()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with `out`, the ids of each text as array<int>."""

    @F.pandas_udf("array<int>")
    def ids_of(texts: pd.Series) -> pd.Series:
        own = codec(path)
        # as arrays of numbers: a batch of lists of Python's integers is ten times as large
        return pd.Series([np.array(own.encode(t), np.int32) for t in texts], dtype=object)

    return docs.withColumn(out, ids_of(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with `out`, the text of each array of ids (null: empty)."""

    @F.pandas_udf("string")
    def text_of(rows: pd.Series) -> pd.Series:
        own = codec(path)
        return pd.Series([own.decode([] if r is None else r) for r in rows], dtype=object)

    return docs.withColumn(out, text_of(F.col(ids)))


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 for each row, made without keeping the ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in batches:
            got = [own.digest(t) for t in batch["t"]]
            yield pd.DataFrame({"k": batch["k"], "n_tokens": [g[0] for g in got], "ids_sha256": [g[1] for g in got], "decoded_sha256": [g[2] for g in got]})

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = dict(rows.dtypes)["k"]
    return rows.mapInPandas(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("k", key)
