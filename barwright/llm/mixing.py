"""Mixing overlapping sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern, the set of sources that they belong to. Words flow from the patterns to the
quotas of their sources; a pattern offers its words once for each epoch, and each repetition costs more than the one
before, so nothing is repeated while another pattern of the same source has words left. Then each pattern's
words are taken from its documents in a seeded order: whole epochs of all documents first, the rest from the order's beginning; the document
where the words run out is taken in part. That place is found by digits of the order, from aggregates of at most
1,024 rows for each pattern, so no pattern is sorted or gathered.

Only aggregates by pattern reach the driver, which solves the flow; there may be MOST_PATTERNS patterns (ValueError beyond).

Edge cases: a null text has size 0; a document of size 0 is given with 0 words taken; an empty or null set of sources belongs to nothing
and nothing is taken of it (source_size 0 and target 0); null is a source of its own. Rows that repeat are documents of their own; rows
that are the same in id and text have the same place in the order, and share what falls there equally, rounded down. Extra columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.common import cut

#: Patterns that the driver solves at most; bits of the order that are settled by one aggregate; rows of a pattern that are told apart one by one.
MOST_PATTERNS, DIGIT, FEW = 50_000, 10, 10_000
#: The query's weights, which repeat over the sources, and the share of all words.
WEIGHTS, PERCENT = (5, 2, 1), 150

Source = str | None


def in_order(names: set[Source]) -> list[Source]:
    """By code point, null last."""
    return sorted((n for n in names if n is not None)) + [None] * (None in names)


def targets(sizes: dict[Source, int], weights: dict[Source, int], total: Fraction | int, most: int = 2) -> dict[Source, Fraction]:
    """Shares of the total by weight, at most `most` times a source's size; the excess is shared anew among the others until none is above."""
    out, open_, left = {}, set(sizes), Fraction(total)
    while open_:
        whole = sum(weights[s] for s in open_)
        over = {s for s in open_ if not whole or left * weights[s] / whole > most * sizes[s]}
        for s in over if whole else open_:
            out[s] = Fraction(most * sizes[s] if whole else 0)
            left -= out[s]
        if not over:
            out |= {s: left * weights[s] / whole for s in open_}
        if not over or not whole:
            break
        open_ -= over
    return out


def route(patterns: Sequence[tuple[Sequence[Source], int]], quotas: dict[Source, int], most: int = 2) -> list[dict[Source, int]]:
    """Words that each pattern (sources, size) sends to each of its sources: as many as quotas and `most` epochs let, at the least cost.

    The k-th epoch of a word costs k. Successive cheapest paths: an epoch is opened once no path through cheaper ones is left.
    A path may take words back from a pattern that has another source to serve, or that gives its dearer epoch to another.
    """
    sent: list[dict[Source, int]] = [dict.fromkeys(own, 0) for own, _ in patterns]
    taken, left = [0] * len(patterns), dict(quotas)
    members: dict[Source, list[int]] = {}
    for i, (own, _) in enumerate(patterns):
        for s in own:
            members.setdefault(s, []).append(i)
    for epoch in range(1, most + 1):
        free = [epoch * size - t for (_, size), t in zip(patterns, taken)]
        while True:
            # paths from patterns with free words to sources with open quotas, by breadth; a source leads on to the patterns that send to it
            came: dict[tuple[int, object], tuple | None] = {(0, i): None for i, f in enumerate(free) if f > 0}
            todo, end = deque(came), None
            while todo and end is None:
                at = kind, name = todo.popleft()
                near = ((1, s) for s in patterns[name][0]) if not kind else ((0, i) for i in members[name] if sent[i][name] > 0)
                for x in near:
                    if x not in came:
                        came[x] = at
                        todo.append(x)
                        if x[0] and left.get(x[1], 0) > 0:
                            end = x
                            break
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            words = min(free[path[0][1]], left[end[1]], *(sent[b[1]][a[1]] for a, b in zip(path[1::2], path[2::2])))
            free[path[0][1]] -= words
            taken[path[0][1]] += words
            left[end[1]] -= words
            for (_, i), (_, s) in zip(path[::2], path[1::2]):
                sent[i][s] += words
            for (_, s), (_, i) in zip(path[1::2], path[2::2]):
                sent[i][s] -= words
    return sent


def _boundaries(rows: DataFrame, rest: dict[str, int]) -> dict[str, tuple[int, int, int]]:
    """For each pattern with rest words to take: the place in the order where they run out, the words still to take there, and the rows that share them."""
    rows, bits = rows.where("size > 0"), 0
    state = {p: (0, n) for p, n in rest.items()}  # pattern -> (digits so far, words left among the rows with these digits)
    out: dict[str, tuple[int, int, int]] = {}

    def crossed(step: Column, now: dict[str, tuple[int, int]]) -> list:
        """One row for each pattern: the step in which its words run out, the words left there, and the rows in it."""
        known = F.broadcast(rows.sparkSession.createDataFrame([(p, d, n) for p, (d, n) in now.items()], "pattern string, digits long, left long"))
        held = rows.join(known, "pattern")
        if bits:
            held = held.where(F.shiftright("place", 64 - bits) == F.col("digits"))
        sums = held.groupBy("pattern", "left", step.alias("step")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("pattern").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return sums.withColumn("before", before).where("before < left AND left <= before + words").select("pattern", "step", (F.col("left") - F.col("before")).alias("more"), "n").collect()

    while state:
        few: dict[str, tuple[int, int]] = {}
        digits = crossed(F.shiftright("place", 64 - bits - DIGIT), state)  # at most 2 ** DIGIT steps a pattern
        bits, state = bits + DIGIT, {}
        for r in digits:
            last = r["n"] <= FEW or bits + DIGIT > 64
            (few if last else state)[r["pattern"]] = r["step"], r["more"]
        if few:  # at most FEW places a pattern, or 2 ** (64 - bits)
            out |= {r["pattern"]: (r["step"], r["more"], r["n"]) for r in crossed(F.col("place"), few)}
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, sources: Column, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, most: int = 2, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, sources, source_size and target (sums over the document's sources), and taken: the words that the mix takes, repeats counted.

    `sources` is an array<string>; the sources in order have the weights, repeating, of `percent` of all words.
    """
    named = F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    place = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    rows = cut(docs.select(F.col(key).alias("id"), word_count(F.col(text)).alias("size"), named.alias("sources"), place.alias("place")).withColumn("pattern", F.to_json("sources")))
    found = rows.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size")).orderBy("pattern").limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    sizes: dict[Source, int] = {}
    for r in found:
        for s in r["sources"]:
            sizes[s] = sizes.get(s, 0) + r["size"]
    weighed = {s: weights[k % len(weights)] for k, s in enumerate(in_order(set(sizes)))}
    aims = targets(sizes, weighed, Fraction(percent * sum(r["size"] for r in found), 100), most)
    flow = route([(r["sources"], r["size"]) for r in found], {s: int(t) for s, t in aims.items()}, most)
    whole, rest, plan = {}, {}, []
    for r, sent in zip(found, flow):
        words = sum(sent.values())
        whole[r["pattern"]], more = divmod(words, r["size"]) if r["size"] else (0, 0)
        if more:
            rest[r["pattern"]] = more
    ends = _boundaries(rows, rest)
    for r in found:
        p, own = r["pattern"], r["sources"]
        at, left, sharers = ends.get(p, (None, 0, 1))
        plan.append((p, whole[p], at, left // sharers, sum(sizes[s] for s in own), float(sum((aims[s] for s in own), Fraction(0)))))
    spread = rows.sparkSession.createDataFrame(plan, "pattern string, whole long, at long, part long, source_size long, target double")
    # a row for each pattern, MOST_PATTERNS at most
    extra = F.when(F.col("place") < F.col("at"), F.col("size")).when(F.col("place") == F.col("at"), F.least("part", "size")).otherwise(0)
    out = rows.join(F.broadcast(spread), "pattern")
    return out.select(F.col("id").alias(key), "size", "sources", "source_size", "target", (F.col("whole") * F.col("size") + extra).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of documents that belong to their source alone."""
    return mix(docs, F.array("source")).select("doc_id", "size", "source_size", "target", "taken")
