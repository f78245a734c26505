"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles. Sets of one size band are cut, by hash, into blocks, and
every block holds the XOR of its shingles' hashes: a shingle in one set but not in the other changes one
block only, so the number of differing blocks is at most the symmetric difference. A band has more blocks
than the largest symmetric difference that its threshold allows; hence linked sets agree in at least one
block (pigeonhole), and joining on block values finds every link. A second sketch toggles one bit for each
shingle; its Hamming distance bounds the symmetric difference from below and discards most false
candidates before the sets themselves are compared. That bound says little of sets of many more shingles than bits, so sets from LARGE
shingles on have a wide sketch too, of two to four bits a shingle: the same bound, so no linked pair is lost. Sketches are
powers of two long, and the longer of two is folded to the shorter.

Equal sets become one class. Within a block value's group, members are first compared with three leaders
only; a second join compares what is still in different components, and only that, so a huge group of near
copies is not expanded into all its pairs. The result loses no link between components.

Edge cases: a null or empty text, or one without words, has the empty set and links with nothing; with fewer
words than n the whole sequence is one shingle; copies and repeated rows share a class; a null id is kept,
never named as a component, and its own component is null unless it links to others; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import Scratch, cut
from barwright.llm.graph import linked_components, maybe_in

#: Ratio of a size band's ends.
BAND = 1.6
#: Times that a set with many empty blocks is dealt into blocks anew.
LEVELS = 4
#: Words of 64 bits in the parity sketch, and shingles from which a set has a wide one too.
SKETCH, LARGE = 8, 400
#: Rows whose keys a task holds at a time.
ROWS = 500
U64 = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles: A-Z lower-cased, words cut at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, U64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    if len(ids) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], U64)
    total = np.zeros(len(ids) - n + 1, U64)
    for k in range(n):
        total = mix(total + ids[k : len(ids) - n + 1 + k], k)
    return np.unique(total)


@lru_cache(maxsize=4)
def bands(percent: int) -> list[tuple[int, int, int, int]]:
    """(low, high, differing blocks at most, spare blocks) of each size band: low <= smaller set < high."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low + 1, int(low * BAND))
        union = (high - 1) * 100 // percent
        most = union - -(-union * percent // 100)
        out.append((low, high, most, (most + 16) // 32))
        low = high
    return out


def bands_of(size: int, percent: int) -> list[int]:
    """Bands in which a set of this size may meet a set of no greater or no smaller size."""
    return [i for i, (low, high, _, _) in enumerate(bands(percent)) if low <= size and (high - 1) * 100 >= percent * size]


@lru_cache(maxsize=4096)
def _bounds(k: int) -> np.ndarray:
    return np.array([(i << 64) // k for i in range(k)], U64)


def block_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Join keys of a set: its non-empty blocks in each band; sets with too many empty blocks are dealt anew too."""
    out = []
    for band in bands_of(len(tokens), percent):
        _, _, most, spare = bands(percent)[band]
        k = most + 1 + spare
        for level in range(LEVELS):
            own = tokens if not level else np.sort(mix(tokens, 100 + level))
            starts = np.searchsorted(own, _bounds(k))
            full = np.diff(np.append(starts, len(own))) > 0
            label = mix(np.arange(k, dtype=U64) + U64((band * LEVELS + level) << 40), 7)
            out.append(mix(np.bitwise_xor.reduceat(mix(own, 3), starts[full]) ^ label[full]))
            if (~full).sum() <= spare:
                break
        else:
            out.append(mix(label[~full], 11))
    return np.concatenate(out).view(np.int64)


def class_of(tokens: np.ndarray) -> int:
    """Signed 64-bit hash of a set: equal sets are one class."""
    return int.from_bytes(xxhash.xxh3_64_digest(tokens.tobytes()), "big", signed=True)


def parity(tokens: np.ndarray) -> np.ndarray:
    """One bit toggled for each token."""
    odd = np.bincount((mix(tokens, 5) >> U64(40)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_parity(tokens: np.ndarray) -> np.ndarray:
    """parity() of a large set in two to four bits for each token, as a power of two of 64-bit words; empty for other sets."""
    if len(tokens) < LARGE:
        return np.zeros(0, np.int64)
    bits = 1 << (2 * len(tokens) - 1).bit_length()
    odd = np.bincount((mix(tokens, 9) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


@lru_cache(maxsize=64)
def _remembered(text: str, n: int) -> np.ndarray:
    return shingles(text, n)


def sketches(docs: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    """id, n_shingles, cls (hash of the set; null if empty), sketch, wide, keys (the last two empty where the task has given the class's before)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        # a few rows at a time: their keys are held until they are sent
        for batch in (whole.iloc[at : at + ROWS] for whole in batches for at in range(0, len(whole), ROWS)):
            rows = []
            for i, t in zip(batch["id"], batch["t"]):
                tokens = shingles(t, n)
                if not len(tokens):
                    rows.append((i, 0, None, [], [], []))
                    continue
                cls = class_of(tokens)
                known = cls in seen
                if len(seen) < 500_000:
                    seen.add(cls)
                rows.append((i, len(tokens), cls, parity(tokens), [] if known else wide_parity(tokens), [] if known else block_keys(tokens, percent)))
            _, sizes, names, odd, wide, keys = zip(*rows) if rows else ((),) * 6
            # nullable integers: a null beside them must not turn hashes into floats
            yield pd.DataFrame({"id": batch["id"].values, "n_shingles": sizes, "cls": pd.array(names, dtype="Int64"), "sketch": list(odd), "wide": list(wide), "keys": list(keys)})

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, n_shingles long, cls long, sketch array<long>, wide array<long>, keys array<long>")


def _within(apart: F.Column, na: F.Column, nb: F.Column, percent: int) -> F.Column:
    """Whether sets of these sizes that differ in at least `apart` shingles can be linked."""
    return apart * (100 + percent) <= (na + nb) * (100 - percent)


def _plausible(percent: int, a: str, b: str) -> F.Column:
    """Whether sizes and parity sketches allow a link: the distance bounds the symmetric difference from below."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH)), F.lit(0))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & _within(apart, na, nb, percent)


def _wide_apart(x: F.Column, y: F.Column) -> F.Column:
    """Hamming distance of two wide sketches, the longer folded to the shorter."""
    n = F.least(F.size(x), F.size(y))
    # places are taken modulo the bits, so a fold adds up the words that are a power of two apart
    folded = lambda s: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.sequence(i, F.size(s) - 1, n), F.lit(0).cast("long"), lambda a, j: a.bitwiseXOR(F.get(s, j))))
    same = lambda s: F.when(F.size(s) == n, s).otherwise(folded(s))
    return F.aggregate(F.zip_with(same(x), same(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, b: a + b)


def _likely(pairs: DataFrame, classes: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) but those of large sets whose wide sketches are too far apart for a link."""
    sized = pairs.join(classes.select(F.col("cls").alias("a"), F.col("n").alias("na")), "a").join(classes.select(F.col("cls").alias("b"), F.col("n").alias("nb")), "b")
    sized = cut(sized.select("a", "b", "na", "nb"))
    large = sized.where(F.least("na", "nb") >= LARGE)
    ends = large.select(F.col("a").alias("cls")).union(large.select("b"))
    wide = maybe_in(heads.where("size(wide) > 0").select("cls", "wide"), "cls", ends).groupBy("cls").agg(F.any_value("wide").alias("wide"))
    both = large.join(wide.toDF("b", "wb"), "b").join(wide.toDF("a", "wa"), "a")
    near = both.where(_within(_wide_apart(F.col("wa"), F.col("wb")), F.col("na"), F.col("nb"), percent))
    return sized.where(F.least("na", "nb") < LARGE).select("a", "b").union(near.select("a", "b"))


def _links(pairs: DataFrame, classes: DataFrame, heads: DataFrame, docs: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold; each set is made from the text of a row of its class."""
    pairs = _likely(pairs, classes, heads, percent)
    reps = classes.select("cls", "rep")
    named = cut(pairs.join(reps.toDF("a", "ra"), "a").join(reps.toDF("b", "rb"), "b"))
    ends = named.select(F.col("ra").alias(key)).union(named.select("rb"))
    # an id may have several texts: the class tells which of them is meant
    texts = maybe_in(docs.select(key, text).where(F.col(key).isNotNull()), key, ends).repartition(F.col(key)).dropDuplicates()

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for i, j, x, y in zip(a, b, left, right):
            u, v = _remembered(x, n), _remembered(y, n)
            both = len(np.intersect1d(u, v, assume_unique=True))
            out.append(100 * both >= percent * (len(u) + len(v) - both) and class_of(u) == i and class_of(v) == j)
        return pd.Series(out, dtype=bool)

    ta, tb = texts.toDF("ra", "ta"), texts.toDF("rb", "tb")
    return cut(named.join(tb, "rb").join(ta, "ra").where(linked("a", "b", "ta", "tb")).select("a", "b"))


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, component_id (least key that links reach, itself included).

    Two documents link when 100 * intersection >= percent * union of their sets.
    """
    with Scratch(docs.sparkSession) as keep:
        heads = keep(sketches(docs, n, percent, key, text))
        members = heads.select("id", "n_shingles", "cls")
        classes = cut(
            heads.where("cls IS NOT NULL")
            .groupBy("cls")
            .agg(F.min("id").alias("rep"), F.min("n_shingles").alias("n"), F.any_value("sketch").alias("sketch"))
            .select("cls", "rep", "n", *(F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)))
            .where("rep IS NOT NULL")
        )
        joined = linked_components(
            heads.select(F.explode("keys").alias("key"), "cls"),
            classes,
            lambda a, b: _plausible(percent, a, b),
            lambda pairs: _links(pairs, classes, heads, docs, n, percent, key, text),
        )
        named = joined.join(classes.select("cls", "rep"), "cls")
        least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
        ids = classes.select("cls", "rep").join(joined, "cls", "left").join(least, "component", "left").select("cls", F.coalesce("component_id", "rep").alias("component_id"))
        empty = members.where("cls IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
        full = members.where("cls IS NOT NULL").join(ids, "cls", "left").select("id", "n_shingles", "component_id")
        return cut(full.union(empty)).withColumnRenamed("id", key)
