"""Connected components and membership filters as DataFrame jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.common import Scratch, cut, release

#: Words of 64 bits in a membership bitmap: it has at most so many rows, however many ids it stands for.
WORDS = 1 << 16
#: Edges that a task is given on average, and those that it contracts at a time; what it holds in memory is a few times as much.
SHARE, TASK_EDGES = 200_000, 1_000_000


def _order(nodes: np.ndarray, turn: int) -> np.ndarray:
    """A hash of each node, another one each turn."""
    x = nodes.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)).view(np.int64)


def stars(a: np.ndarray, b: np.ndarray, turn: int) -> pd.DataFrame:
    """(node, root, place) of the components of some edges: root is the first in the turn's order, place its hash."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    place = _order(nodes, turn)
    order = np.argsort(place, kind="stable")
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    x, y = np.split(rank[at], 2)
    up = np.arange(len(nodes))
    while True:
        low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        if (low == high).all():
            break
        np.minimum.at(up, high, low)
        while not np.array_equal(further := up[up], up):
            up = further
    root = order[up[rank]]
    return pd.DataFrame({"node": nodes, "root": nodes[root], "place": place[root]})


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node that links reach. Nodes are 64-bit integers.

    Each round every task contracts the edges that it holds, about SHARE of them, to stars; each node then points to
    the first of its roots in a hashed order, which is another one each round, and its other roots are the next round's edges.
    A node has one row for each task at most, so no group of a hub is gathered; chains shrink by a constant
    factor at least, and whatever meets in one task is contracted at once. Null ends and self-loops are ignored;
    edges may repeat and come in either direction.
    """
    edges = edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).where("a < b").distinct()
    levels: list[DataFrame] = []
    while True:
        edges = cut(edges)
        count = edges.count()
        if levels and not count:
            break
        turn, tasks = len(levels), -(-count // SHARE)

        def run(batches: Iterator[pd.DataFrame], turn=turn) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for batch in batches:
                held.append(batch)
                if sum(map(len, held)) >= TASK_EDGES:
                    part, held = pd.concat(held), []
                    yield stars(part["a"].to_numpy(), part["b"].to_numpy(), turn)
            if held:
                part = pd.concat(held)
                yield stars(part["a"].to_numpy(), part["b"].to_numpy(), turn)

        # as many tasks as the edges need: partitions of a few edges would contract little
        near = edges.coalesce(max(1, tasks)).mapInPandas(run, "node long, root long, place long")
        step = cut(near.select("node", "root", F.min(F.struct("place", "root")).over(Window.partitionBy("node"))["root"].alias("to")))
        levels.append(step.select("node", "to").distinct())
        edges = step.where("root <> to").select(F.least("root", "to").alias("a"), F.greatest("root", "to").alias("b")).distinct()
    members = levels[0].select("node", F.col("to").alias("component"))
    for level in levels[1:]:
        moved = level.select(F.col("node").alias("component"), "to")
        members = members.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    if len(levels) > 1:
        members = cut(members)
    least = members.groupBy("component").agg(F.min("node").alias("least"))
    return cut(members.join(least, "component").select("node", F.col("least").alias("component")))


def _marked(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, Column]:
    """df with columns of other names than its own, and whether the key may be among the ids."""
    slot, word, bit, bits = (f"__{name}{'_' * max(map(len, df.columns))}" for name in ("slot", "word", "bit", "bits"))
    held = F.pmod(F.xxhash64(key), F.lit(WORDS * 64)).alias(slot)
    at, one = F.expr(f"{slot} div 64").alias(word), F.expr(f"shiftleft(1L, CAST({slot} % 64 AS INT))")
    bitmap = ids.select(F.pmod(F.xxhash64(ids.columns[0] if key not in ids.columns else key), F.lit(WORDS * 64)).alias(slot)).groupBy(at).agg(F.bit_or(one).alias(bits))
    # at most WORDS rows of two numbers are broadcast
    return df.select("*", held).select("*", at, one.alias(bit)).join(F.broadcast(bitmap), word, "left"), F.coalesce(F.col(bits).bitwiseAND(F.col(bit)), F.lit(0)) != 0


def split_by(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in ids, rows whose key is not); null keys are in the second. ids has one column, or one of that name.

    The ids are folded into a bitmap of WORDS words, which is small enough to broadcast at any size of
    ids. With a great many ids it settles little, and the exact join after it does the work.
    """
    marked, maybe = _marked(df, key, ids)
    held = F.col(key).isNotNull() & maybe
    return marked.where(held).select(*df.columns), marked.where(~held).select(*df.columns)


def maybe_in(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """df without most of the rows whose key isn't in ids (and those with a null key); never drops one that is."""
    return split_by(df, key, ids)[0]


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """df without the rows whose key is in ids; rows that the bitmap settles aren't shuffled. Null keys stay."""
    some, rest = split_by(df, key, ids)
    return rest.union(some.join(ids.select(key), key, "left_anti").select(*df.columns))


def linked_components(blocks: DataFrame, classes: DataFrame, plausible: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], read: Callable[[], None] = lambda: None) -> DataFrame:
    """Components (cls, component) of the classes that candidate groups and a verification link.

    blocks has (key, cls), which may repeat: classes with a common key are candidates. plausible(x, y) is a cheap
    condition on two rows of classes (a table with a column cls), verify keeps the pairs (a, b) that are linked. In each
    group, members first meet two leaders only, its least and its greatest class, which are partial aggregates.
    In groups that are still apart, rows outside the largest component meet two leaders of that component; last, what is
    still outside meets all rows of other components. Pairs within a component need no look, so no linked pair between
    components is lost. read() is called when blocks won't be read any more.
    """
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    with Scratch(blocks.sparkSession) as keep:
        ends = keep(blocks.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high"))
        shared = keep(maybe_in(blocks, "key", ends).join(ends, "key"))
        read()
        spark = blocks.sparkSession
        leads = shared.select("cls", F.explode(F.array("low", "high")).alias("lead")).where("cls <> lead")

        def likely(pairs: DataFrame) -> DataFrame:
            x, y = classes.alias("x"), classes.alias("y")
            return keep(pairs.join(x, F.col("a") == F.col("x.cls")).join(y, F.col("b") == F.col("y.cls")).where(plausible("x", "y")).select("a", "b"))

        def outside(links: DataFrame, keep: Scratch) -> DataFrame:
            """(key, cls, component, out): rows of the groups that are still apart; out if not in the group's largest component."""
            joined = components(links).withColumnRenamed("node", "cls")
            placed = shared.select("key", "cls").join(joined, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
            sizes = placed.groupBy("key", "component").agg(F.count("*").alias("rows"))
            most = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("rows", "component")).alias("most")).where("parts > 1").select("key", "most")
            return keep(placed.join(most, "key").select("key", "cls", "component", (F.col("component") != F.col("most")).alias("out")).distinct())

        seen = likely(leads.select(*ordered("cls", "lead")).distinct())
        links = verify(seen)
        release(spark)

        with Scratch(spark) as briefly:
            rest = outside(links, briefly)
            tops = rest.where("NOT out").groupBy("key").agg(*(F.min_by("cls", F.xxhash64("cls", F.lit(k))).alias(f"t{k}") for k in (1, 2)))
            more = rest.where("out").join(tops, "key").select("cls", F.explode(F.array("t1", "t2")).alias("lead")).select(*ordered("cls", "lead")).distinct()
            more = likely(more.join(seen, ["a", "b"], "left_anti"))
        seen, links = seen.union(more), links.union(verify(more))
        release(spark)

        with Scratch(spark) as briefly:
            rest = briefly(outside(links, briefly).join(classes, "cls"))
            # of two rows outside, one order is enough
            apart = (F.col("x.component") != F.col("y.component")) & (~F.col("y.out") | (F.col("x.cls") < F.col("y.cls")))
            more = rest.where("out").alias("x").join(rest.alias("y"), (F.col("x.key") == F.col("y.key")) & apart & plausible("x", "y"))
            more = more.select(*ordered("x.cls", "y.cls")).distinct()
            more = keep(more.join(seen, ["a", "b"], "left_anti"))
        return components(links.union(verify(more))).withColumnRenamed("node", "cls")
