"""Quality classifier: weak labels whose accuracies EM estimates, and a hashed linear scorer trained on their posteriors.

Overlapping heuristics vote good, bad or abstain on every document. The counts of vote patterns over all
documents (at most 3 ** 9) go to an expectation-maximisation that estimates each labeller's vote chances in
either class, without any given label; it gives every pattern a posterior. A logistic scorer over hashed
word shapes and binned text statistics is trained on the posteriors of at most SAMPLE documents, chosen by a
hash of the id, and scores all documents.

Edge cases: null and empty texts get the labellers' vote against texts without words; without documents there
is nothing to fit and nothing returned; null ids are scored but not sampled; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.bpe import WordCache

#: Documents that the scorer is trained on, at most; features; bins of a statistic.
SAMPLE, DIM, BINS = 4_000, 1024, 8
LABELLERS = ("symbols", "marked", "capitals", "variety", "stutter", "word_length", "repeated_lines", "sentences", "words")
SYMBOLS = b"#$%&*|!~^<>{}=\\"
ENDINGS = (".", "!", "?")
MARKS = tuple(SYMBOLS.decode())


def statistics(text: str | None) -> tuple[list[str], tuple[float, ...]]:
    """Words, and shares: symbols, words that end in one, capitals, distinct words, repeats of the word before, mean word length, repeated lines, sentence ends."""
    text = text or ""
    words, raw = text.split(), text.encode()
    n = len(words)
    if not n:
        return words, (0.0,) * 8
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = text.split("\n")
    stutter = sum(map(str.__eq__, words, words[1:])) / n
    return words, (symbols / len(raw), sum(w.endswith(MARKS) for w in words) / n, capitals / len(raw), len(set(words)) / n, stutter, (len(text) - n) / n, 1 - len(set(lines)) / len(lines), sum(w.endswith(ENDINGS) for w in words) / n)


def votes(n: int, s: tuple[float, ...], lines: int) -> int:
    """The labellers' votes, in base 3: 0 bad, 1 abstaining, 2 good."""
    symbols, marked, capitals, distinct, stutter, length, repeated, ends = s

    def vote(bad: bool, good: bool) -> int:
        return 0 if bad else 2 if good else 1

    cast = (
        vote(symbols > 0.03, symbols < 0.01),
        vote(marked > 0.15, marked < 0.05),
        vote(capitals > 0.3, capitals < 0.1),
        vote(n >= 20 and distinct < 0.4, n < 20 or distinct > 0.55),
        vote(n >= 8 and stutter > 0.2, stutter < 0.08),
        vote(length > 8.5 or length < 2, 3 <= length <= 7),
        vote(lines >= 3 and repeated > 0.4, lines >= 3 and repeated < 0.1),
        vote(n >= 20 and (ends > 0.5 or not ends), 0.01 < ends < 0.4),
        vote(n == 0, n >= 30),
    )
    return sum(v * 3**k for k, v in enumerate(cast)) if n else 0


@lru_cache(maxsize=1)
def _shapes() -> WordCache:
    def shape(word: str) -> int:
        kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
        short = "".join(c for k, c in enumerate(kinds) if k == 0 or c != kinds[k - 1])
        return xxhash.xxh3_64_intdigest(f"{short}|{min(len(word), 12) // 3}") % DIM

    return WordCache(shape)


def features(words: list[str], s: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words' shapes, and of the binned statistics."""
    binned = [xxhash.xxh3_64_intdigest(f"{k}:{min(BINS, int(v * BINS)) if k != 5 else min(20, int(v))}") % DIM for k, v in enumerate(s)]
    binned.append(xxhash.xxh3_64_intdigest(f"n:{len(words).bit_length()}") % DIM)
    return np.fromiter(map(_shapes().__getitem__, words), np.int64, len(words)), np.array(binned)


def posteriors(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Chance of the good class for each vote pattern, by EM over (pattern, count)."""
    codes = sorted(counts)
    cast = np.array([[c // 3**k % 3 for k in range(len(LABELLERS))] for c in codes])
    n = np.array([counts[c] for c in codes], float)
    good = 1 / (1 + np.exp(-1.5 * (cast - 1).sum(1) + 3 * (cast == 0).any(1)))  # one vote against outweighs two in favour, to begin with
    for _ in range(rounds):
        prior = (good @ n + 1) / (n.sum() + 2)
        log = np.zeros((2, len(codes)))
        for side, weight in enumerate(((1 - good) * n, good * n)):
            log[side] = np.log(prior if side else 1 - prior)
            for k in range(len(LABELLERS)):
                chance = np.bincount(cast[:, k], weight, 3) + 0.5
                log[side] += np.log(chance / chance.sum())[cast[:, k]]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(codes, good.tolist()))


def _trained(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 2.0, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        w -= rate * (x.T @ (p - y) / len(y) + ridge * w)
        b -= rate * float((p - y).mean())
    return w, b


def classify(docs: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, votes, posterior (of the vote pattern), score (0 to 1, of the trained scorer) and keep (score >= 0.5)."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["k"]

    @F.pandas_udf("int")
    def voted(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words, s = statistics(t)
            out.append(votes(len(words), s, (t or "").count("\n") + 1))
        return pd.Series(out, dtype="int32")

    counts = {r["v"]: r["count"] for r in rows.select(voted("t").alias("v")).groupBy("v").count().collect()}
    chances = posteriors(counts) if counts else {}
    chosen = rows.where("k IS NOT NULL").select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(sample)

    def learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch["t"]:
                words, s = statistics(t)
                shapes, binned = features(words, s)
                x = np.bincount(shapes, minlength=DIM) / max(1, len(shapes)) + np.bincount(binned, minlength=DIM)
                out.append((x.astype(np.float32), chances[votes(len(words), s, (t or "").count("\n") + 1)]))
            yield pd.DataFrame(out, columns=["x", "y"])

    one = rows.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("t").alias("t"))  # of an id's several texts the least
    seen = one.select("t").mapInPandas(learned, "x array<float>, y double").toPandas()  # at most `sample` rows
    if len(seen):
        x, y = np.stack(seen["x"]), seen["y"].to_numpy()
        order = np.lexsort((x @ np.arange(DIM), y))
        w, b = _trained(x[order], y[order])
    else:
        w, b = np.zeros(DIM), 0.0

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch["t"]:
                words, s = statistics(t)
                code = votes(len(words), s, (t or "").count("\n") + 1)
                shapes, binned = features(words, s)
                z = b + w[binned].sum() + (w[shapes].mean() if len(shapes) else 0.0)
                out.append((code, chances.get(code, 0.5), 1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            found = pd.DataFrame(out, columns=["votes", "posterior", "score"])
            yield found.assign(k=batch["k"].values, keep=found["score"] >= 0.5)[["k", "votes", "posterior", "score", "keep"]]

    return rows.mapInPandas(scored, f"k {kind}, votes int, posterior double, score double, keep boolean").withColumnRenamed("k", key)
