"""Phrase collocations from a weighted de Bruijn graph of word groups.

Texts are cut into pieces and words. The graph's edges are a piece's groups of five words, its nodes the four words that two
neighbouring edges share; equal edges are added up to weights. A node's count is the flow that leaves it, plus the
pieces that end with it, and the counts of three and two words follow from those of four and three in the same way.
Phrases through which all flow goes on in one extension lie inside a unary path: they are compacted into it. paths() joins
the edges of a unary path, so a passage that repeats is one path however long it is.

Before edges are made, pieces are cut where no phrase that is frequent enough can go on: at words whose exact count, and at two or three
neighbours whose count's upper bound, is below the threshold. The bounds come from saturating counters of hashed pairs and triples, two tables of
fixed size (`slots`, a power of two: a byte each in a task, a bit each when broadcast), so all counts from the threshold on stay exact. When a corpus has so many
pairs that all counters are full nothing is cut between neighbours, and the edges of all pieces are shuffled. A task adds up its
own phrases (HELD at a time) before they leave, so a word gives at most one row, and a phrase one for each task that holds it.

Edge cases: a null text is empty; a null language is `und`; empty pieces and pieces of one word have no edges but count as
words; rows that repeat count each time; occurrences that overlap count each; extra columns are ignored; without words the result is empty.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.common import Scratch, cut

#: Words of an edge.
LONGEST = 5
#: Hashed pair counters; bits of the table of frequent words; characters looked at at once; phrases that a task holds before it gives them on.
SLOTS, WORD_BITS, PART, HELD = 1 << 23, 1 << 23, 1_000_000, 300_000
#: Parts in which a language's phrases are ranked first.
PARTS = 64
#: The characters that end a piece, and the language of rows without one.
ENDS, NO_LANG = ".,;:!?\n\x0b\x0c\r", "und"

#: Ends become line feeds and tabs blanks; both are ASCII, so bytes will do.
_TABLE = bytes.maketrans(ENDS.encode() + b"\t", b"\n" * len(ENDS) + b" ")
_BREAK, _NOTHING = b"\n", b""


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, words) of some texts of a language each; a piece's end is the word \\n, and some words are empty."""
    for batch in batches:
        for lang, texts in batch.groupby("lang")["t"]:
            held, size = [], 0
            for t in texts:
                raw = t.encode().lower().translate(_TABLE)  # of bytes, only A-Z are lowered
                held.append(raw)
                size += len(raw)
                if size >= PART:
                    yield lang, b"\n".join(held).replace(b"\n", b" \n ").split(b" ")
                    held, size = [], 0
            if held:
                yield lang, b"\n".join(held).replace(b"\n", b" \n ").split(b" ")


def _counted(counts: dict[str, Counter]) -> Iterator[pd.DataFrame]:
    for lang, own in counts.items():
        if own:
            yield pd.DataFrame({"lang": lang, "phrase": [k.decode() for k in own], "n": list(own.values())})
    counts.clear()


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, phrase, n) of single words."""
    counts: dict[str, Counter] = {}
    for lang, words in _parts(batches):
        own = counts.setdefault(lang, Counter())
        own.update(words)
        del own[_BREAK], own[_NOTHING]
        if sum(map(len, counts.values())) > HELD:
            yield from _counted(counts)
    yield from _counted(counts)


class _Codes(dict):
    """Words of a language to 64-bit codes; 0 for a piece's end and for words that can't be frequent, 1 for no word."""

    def __init__(self, lang: str, table: np.ndarray):
        self.lang, self.table = zlib.crc32(lang.encode()), table
        self[_BREAK], self[_NOTHING] = 0, 1

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
            self[_BREAK], self[_NOTHING] = 0, 1
            if word in self:
                return self[word]
        h = zlib.crc32(word, self.lang)
        at = h % WORD_BITS
        good = self.table[at >> 3] >> (at & 7) & 1
        self[word] = code = int(h << 32 | zlib.crc32(word[::-1], ~self.lang & 0xFFFFFFFF) | 2) & 0x7FFFFFFFFFFFFFFF if good else 0
        return code


def _slots(codes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the counters of the two and of the three words that begin there, -1 if a piece ends within them."""
    x = codes.astype(np.uint64)
    shift, good = np.uint64(65 - slots.bit_length()), x > 0
    mix = lambda a, b: (a * np.uint64(0x9E3779B97F4A7C15) ^ b) * np.uint64(0xBF58476D1CE4E5B9)
    spread = lambda h: ((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> shift).astype(np.int64)
    two, pair = mix(x[:-1], x[1:]), good[:-1] & good[1:]
    return np.where(pair, spread(two), -1), np.where(pair[:-1] & pair[1:], spread(mix(two[:-1], x[2:])), -1)


def _coded(batches: Iterator[pd.DataFrame], table: np.ndarray) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    known: dict[str, _Codes] = {}
    for lang, words in _parts(batches):
        own = known.setdefault(lang, _Codes(lang, table))
        codes = np.fromiter(map(own.__getitem__, words), np.int64, len(words))
        full = codes != 1
        yield lang, [w for w in words if w], codes[full]


def _bits(rows: DataFrame, size: int) -> np.ndarray:
    """A table of `size` bits, in which those of column `at` are set; rows are folded to bytes by Spark first."""
    got = rows.groupBy(F.expr("at div 8").alias("byte")).agg(F.expr("bit_or(shiftleft(1, CAST(at % 8 AS INT)))").alias("bits"))
    packed = got.groupBy(F.expr("byte div 4096").alias("block")).agg(F.collect_list(F.struct("byte", "bits")).alias("of"))  # at most 4,096 bytes a block
    out = np.zeros(size // 8, np.uint8)
    for r in packed.toLocalIterator():  # size bits in all
        for byte, bits in r["of"]:
            out[byte] = bits
    return out


def word_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, phrase, n): exact counts of all words."""
    return _texts(docs, lang, text).mapInPandas(_words, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"))


def _word_table(frequent: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"at": [zlib.crc32(w.encode(), zlib.crc32(x.encode())) % WORD_BITS for x, w in zip(b["lang"], b["phrase"])]}, dtype="int64")

    return _bits(frequent.select("lang", "phrase").mapInPandas(run, "at long"), WORD_BITS)


def _tables(texts: DataFrame, words: np.ndarray, least: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the counters of two and of three words that reach `least`. Counters stop at the greatest number of their kind, which is at least `least`."""
    kind = np.uint8 if least <= 255 else np.uint32
    most, block = np.iinfo(kind).max, 1 << 13
    shared = texts.sparkSession.sparkContext.broadcast(words)  # WORD_BITS bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting, size = np.zeros(2 * slots, kind), [], 0

        def add() -> None:
            at, n = np.unique(np.concatenate(waiting), return_counts=True)
            held[at] = np.minimum(held[at].astype(np.int64) + n, most).astype(kind)

        for _, _, codes in _coded(batches, shared.value):
            two, three = _slots(codes, slots)
            waiting += [two[two >= 0], three[three >= 0] + slots]
            size += len(waiting[-2]) + len(waiting[-1])
            if size >= 2_000_000:
                add()
                waiting, size = [], 0
        if waiting:
            add()
        for k in range(2 * slots // block):
            own = held[k * block : (k + 1) * block]
            if own.any():
                yield pd.DataFrame({"block": [k], "counts": [own.tobytes()]})

    def total(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Adds up a task's blocks, for any number of rows a block."""
        held: dict[int, np.ndarray] = {}
        for part in rows:
            for k, raw in zip(part["block"], part["counts"]):
                own = held.setdefault(k, np.zeros(block, np.int64))
                np.minimum(own + np.frombuffer(raw, kind), most, out=own)
        if held:
            yield pd.DataFrame({"block": list(held), "bits": [np.packbits(own >= least, bitorder="little").tobytes() for own in held.values()]})

    blocks = texts.mapInPandas(count, "block int, counts binary").repartition(F.col("block"))
    out = np.zeros(2 * slots // 8, np.uint8)
    for r in blocks.mapInPandas(total, "block int, bits binary").toLocalIterator():  # two bits for each slot
        out[r["block"] * block // 8 : (r["block"] + 1) * block // 8] = np.frombuffer(r["bits"], np.uint8)
    return out[: slots // 8], out[slots // 8 :]


def own_edges(texts: DataFrame, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> DataFrame:
    """(lang, phrases, counts) of each task: its five-word edges, and what the last four words of each cut piece are, or all of a shorter one.

    Cut pieces go on from pair to pair of words; where three words can't be frequent the next piece begins with the middle one, so no pair is in two.
    """
    shared = texts.sparkSession.sparkContext.broadcast((words, pairs, triples))  # WORD_BITS bits, and two for each slot
    held_in = lambda bits, at: (at >= 0) & (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def given(counts: dict[str, Counter]) -> Iterator[pd.DataFrame]:
        for lang, own in counts.items():
            if own:
                yield pd.DataFrame({"lang": [lang], "phrases": [[k.decode() for k in own]], "counts": [list(own.values())]})
        counts.clear()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, two, three = shared.value
        counts: dict[str, Counter] = {}
        for lang, own, codes in _coded(batches, table):
            pair, triple = (held_in(bits, at) for bits, at in zip((two, three), _slots(codes, 8 * len(two))))
            on = np.concatenate([[False], pair[:-1] & pair[1:] & triple, [False]])[: len(pair) + 1]  # the pair goes on from the one before
            first, last = np.flatnonzero(pair & ~on[: len(pair)]), np.flatnonzero(pair & ~on[1:])
            held = counts.setdefault(lang, Counter())
            held.update([own[i] + b" " + own[i + 1] for i in first[first == last].tolist()])
            for a, b in zip(first[first < last].tolist(), (last[first < last] + 2).tolist()):  # words a to b - 1
                held.update([b" ".join(own[i : i + LONGEST]) for i in range(a, b - LONGEST + 1)])
                held[b" ".join(own[max(a, b - LONGEST + 1) : b])] += 1
            if sum(map(len, counts.values())) > HELD:
                yield from given(counts)
        yield from given(counts)

    return texts.mapInPandas(run, "lang string, phrases array<string>, counts array<long>")  # a row for each language of a task, or for about HELD phrases


def edges(texts: DataFrame, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> DataFrame:
    """(lang, phrase, n) of the tasks' edges and ends of pieces, added up."""
    each = own_edges(texts, words, pairs, triples).select("lang", F.explode(F.arrays_zip("phrases", "counts")).alias("x"))
    return each.groupBy("lang", F.col("x.phrases").alias("phrase")).agg(F.sum("x.counts").alias("n"))


def length(phrase: Column) -> Column:
    return F.size(F.split(phrase, " "))


def _nodes(longer: DataFrame, tails: DataFrame, k: int) -> DataFrame:
    """Counts of k words: the flow that leaves them, and the pieces that end with them."""
    flow = longer.select("lang", F.substring_index("phrase", " ", k).alias("phrase"), "n")
    ends = tails.where(length(F.col("phrase")) >= k).select("lang", F.substring_index("phrase", " ", -k).alias("phrase"), "n")
    return flow.union(ends).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, least: int, keep: Scratch, slots: int = SLOTS, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(phrases of 2 to 5 words and words: lang, phrase, k, n, for all with n >= least; lang and total: its words)."""
    texts = _texts(docs, lang, text)
    words = keep(word_counts(docs, lang, text))
    frequent = words.where(F.col("n") >= least)
    table = _word_table(frequent)
    held = keep(edges(texts, table, *_tables(texts, table, least, slots)))
    longest, tails = held.where(length(F.col("phrase")) == LONGEST), held.where(length(F.col("phrase")) < LONGEST)
    levels, longer = [longest.select("*", F.lit(LONGEST).alias("k"))], longest
    for k in range(LONGEST - 1, 1, -1):
        longer = keep(_nodes(longer, tails, k))
        levels.append(longer.select("*", F.lit(k).alias("k")))
    out = frequent.select("*", F.lit(1).alias("k"))
    for level in levels:
        out = out.unionByName(level.where(F.col("n") >= least))
    return out, words.groupBy("lang").agg(F.sum("n").alias("total"))


def inside_paths(counts: DataFrame) -> DataFrame:
    """(lang, phrase, most) of phrases that one word more continues: the most of the counts of their extensions."""
    longer = counts.where("k > 2")
    shorter = [longer.select("lang", F.expr(f"substring_index(phrase, ' ', {way}(k - 1))").alias("phrase"), "n") for way in ("", "-")]
    return shorter[0].union(shorter[1]).groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def paths(counts: DataFrame, k: int = LONGEST) -> DataFrame:
    """(lang, phrase, path, words, n): unary paths of edges of k words. The path is the phrase that begins it (null in a cycle).

    An edge is followed by another where the node between them passes on what it gets: both have the node's count. Each edge
    points to the one before it, and pointers are doubled until all have reached a beginning; edges in a cycle never do.
    """
    own = counts.where(F.col("k") == k).select("lang", "phrase", "n")
    node = counts.where(F.col("k") == k - 1).select("lang", F.col("phrase").alias("node"), "n")
    ends = own.select("lang", F.substring_index("phrase", " ", 1 - k).alias("node"), "n", F.col("phrase").alias("before"))
    begins = own.select("lang", F.substring_index("phrase", " ", k - 1).alias("node"), "n", "phrase")
    links = begins.join(node, ["lang", "node", "n"], "left_semi").join(ends, ["lang", "node", "n"]).select("lang", "phrase", "before")
    held = cut(own.join(links, ["lang", "phrase"], "left").select("lang", "phrase", "n", F.coalesce("before", "phrase").alias("to"), F.when(F.col("before").isNotNull(), 1).otherwise(0).cast("long").alias("steps"), F.col("before").isNull().alias("done")))
    open_ = held.where("NOT done").count()
    while open_:
        back = held.select("lang", F.col("phrase").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"), F.col("done").alias("there"))
        rest = held.where("NOT done").join(back, ["lang", "to"]).select("lang", "phrase", "n", F.col("further").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("done"))
        held = cut(held.where("done").unionByName(rest))
        left = held.where("NOT done").count()
        if left == open_:
            break  # only cycles are left
        open_ = left
    sized = held.where("done").groupBy("lang", "to").agg(F.max("steps").alias("last"))
    return held.join(sized, ["lang", "to"], "left").select("lang", "phrase", F.when(F.col("done"), F.col("to")).alias("path"), F.when(F.col("done"), F.col("last") + k).alias("words"), "n")


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of 2 words and more; the cut with the least score counts, then the earliest.

    Scores are divisions of whole numbers of up to 38 digits.
    """
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    whole = counts.where("k > 1").select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    parts = whole.select("*", F.expr("substring_index(phrase, ' ', cut)").alias("head"), F.expr("substring(phrase, length(substring_index(phrase, ' ', cut)) + 2)").alias("rest"))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = parts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"])
    both = both.join(F.broadcast(totals.select("lang", F.col("total").alias("n"))), "lang")  # a row for each language
    over, under = (F.lit(1000).cast("decimal(4,0)") * wide("a")).cast("decimal(23,0)") * F.col("n").cast("decimal(15,0)"), wide("l") * wide("r")
    cuts = both.select("lang", "phrase", "a", "n", "l", "r", "cut", over.alias("over"), under.alias("under")).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "cut")).alias("best"))
    return best.select("lang", "phrase", "best.*")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, slots: int = SLOTS, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first phrases of each language by score, count and bytes.

    A phrase inside a unary path is compacted into it, that is left out: one that contains it is as frequent.
    """
    with Scratch(docs.sparkSession) as keep:
        counts, totals = phrase_counts(docs, least, keep, slots, lang, text)
        counts, totals = cut(counts), cut(totals)
    inner = inside_paths(counts).where("most IS NOT NULL")
    found = scored(counts, totals).join(inner, ["lang", "phrase"], "left").where("most IS NULL OR most < a").drop("most")
    order = (F.desc("score"), F.desc("a"), "phrase")
    # the first of each part of a language are enough to rank the language
    part = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = part.withColumn("_in", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_in") <= top).drop("_part", "_in")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
