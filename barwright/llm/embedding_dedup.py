"""Near-duplicate embeddings by collision counting over one-dimensional projections.

Unit vectors are projected on random directions. On each, two vectors collide if the one lies in the
window centred on the other. A pair at the threshold's distance d differs by a normal number of deviation d
on a direction, so its collisions among M directions are binomial; the count that a pair must reach is the
highest that pairs at the threshold pass with probability RECALL. Pairs that pass are verified by cosine.

Vectors of one label are sorted along the first direction into cells and cut into blocks of about BLOCK
vectors; blocks meet where their cells are so near that a linked pair can lie across them. In a pair of blocks, one
is sorted along every direction and each vector of the other opens its windows there. A block pair is one task's unit whatever a
label's size; equal vectors are one class, and linked vectors leave the task as counts and stars, so no group of
copies is written out as pairs. On directions alone unrelated vectors collide often (a window holds about a quarter of a label);
block pairs therefore grow with the square of a label's size divided by BLOCK, and each is counted in full.

Edge cases: null labels, null or zero vectors, and vectors with null or non-finite components link with
nothing; vectors of different lengths never link; copies and repeated ids share a class (a repeated id counts
itself once for each further row); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import cut
from barwright.llm.graph import components, stars

#: Directions, half-width of a window in units of d, vectors in a block, width of a cell in units of d.
M, WINDOW, BLOCK, CELL = 32, 1.35, 1024, 0.75
#: Probability that a pair at the threshold reaches the required count.
RECALL = 0.9999
#: Deviations on the first direction beyond which no linked pair is looked for: one in 60,000 pairs at the threshold.
REACH = 4.3


@lru_cache(maxsize=8)
def directions(size: int) -> np.ndarray:
    return np.random.default_rng(size).standard_normal((size, M))


def required(recall: float = RECALL) -> int:
    """The highest count that a pair at the threshold reaches with at least this probability."""
    p = math.erf(WINDOW / math.sqrt(2))
    tail = 0.0
    for count in range(M, -1, -1):
        tail += math.comb(M, count) * p**count * (1 - p) ** (M - count)
        if tail >= recall:
            return count
    return 0


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _collisions(left: np.ndarray, right: np.ndarray, width: float) -> np.ndarray:
    """For each vector on the left, in how many directions each on the right lies in the window around it; right is sorted along each direction."""
    count = np.zeros((len(left), len(right)), np.uint8)
    for k in range(M):
        order = np.argsort(right[:, k], kind="stable")
        line = right[order, k]
        first, last = np.searchsorted(line, left[:, k] - width, "left"), np.searchsorted(line, left[:, k] + width, "right")
        place = np.empty(len(right), np.int64)
        place[order] = np.arange(len(right))
        count += (place >= first[:, None]) & (place < last[:, None])
    return count


def _links_within(left: pd.DataFrame, right: pd.DataFrame, same: bool, threshold: float) -> pd.DataFrame:
    """(cls, others, root) of the linked vectors of two blocks: copies that each is linked with, and the star that it is in.

    Collisions are counted first, the cosine is taken where they suffice. Pairs stay in the task: its result has a row
    for each vector, however large a group of near copies is.
    """
    out = [pd.DataFrame({"cls": pd.Series(dtype="int64"), "others": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})]
    sizes = sorted({len(v) for v in left["v"]} & {len(v) for v in right["v"]})
    width, need = WINDOW * math.sqrt(2 - 2 * threshold), required()
    for size in sizes:
        x, y = left[left["v"].map(len) == size], right[right["v"].map(len) == size]
        u, w = _unit(np.stack(x["v"]).astype(float)), _unit(np.stack(y["v"]).astype(float))
        i, j = np.nonzero(_collisions(u @ directions(size), w @ directions(size), width) >= need)
        a, b = x["cls"].to_numpy(), y["cls"].to_numpy()
        keep = a[i] < b[j] if same else a[i] != b[j]
        i, j = i[keep], j[keep]
        good = np.concatenate([np.einsum("ij,ij->i", u[i[at : at + 65536]], w[j[at : at + 65536]]) >= threshold for at in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        i, j = i[good], j[good]
        if len(i):
            one = np.bincount(i, y["copies"].to_numpy()[j], len(x)), np.bincount(j, x["copies"].to_numpy()[i], len(y))
            others = pd.DataFrame({"cls": np.concatenate([a, b]), "others": np.concatenate(one).astype(np.int64)}).groupby("cls", as_index=False).sum()
            out.append(stars(a[i], b[j], 0).rename(columns={"node": "cls"})[["cls", "root"]].merge(others, "left", "cls")[["cls", "others", "root"]])
    return pd.concat(out)


def links(classes: DataFrame, threshold: float) -> DataFrame:
    """(cls, others, root) for each linked class of classes (cls, label, v, copies) and each pair of blocks that links it."""
    distance = math.sqrt(2 - 2 * threshold)
    step = CELL * distance

    @F.pandas_udf("long")
    def cell_of(vectors: pd.Series) -> pd.Series:
        return pd.Series([int(np.floor(float(np.dot(v / np.linalg.norm(v), directions(len(v))[:, 0])) / step)) for v in map(lambda v: np.asarray(v, float), vectors)], dtype="int64")

    celled = cut(classes.withColumn("cell", cell_of("v")))
    blocks = celled.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = celled.join(blocks, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    each = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("label", "cell", "block")
    x, y = each.alias("x"), each.alias("y")
    reach = math.ceil(REACH / CELL)
    ahead = F.struct("x.cell", "x.block") <= F.struct("y.cell", "y.block")
    # pairs of blocks, not of vectors
    meet = x.join(y, (F.col("x.label") == F.col("y.label")) & ahead & (F.col("y.cell") - F.col("x.cell") <= reach))
    meet = meet.select("x.label", *(F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "xy" for c in ("cell", "block")), F.xxhash64("x.label", "x.cell", "x.block", "y.cell", "y.block").alias("pair"))
    meet = cut(meet)
    side = lambda s, left: dealt.join(meet.select("label", F.col(f"{s}cell").alias("cell"), F.col(f"{s}block").alias("block"), "pair"), ["label", "cell", "block"]).select("pair", "cls", "v", "copies", F.lit(left).alias("left"))
    twice = meet.where("xcell = ycell AND xblock = yblock").select("pair").withColumn("same", F.lit(True))
    rows = side("x", True).union(side("y", False)).join(twice, "pair", "left").withColumn("same", F.coalesce("same", F.lit(False)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _links_within(group[group["left"]], group[~group["left"]], bool(group["same"].iloc[0]), threshold)

    return cut(rows.groupBy("pair").applyInPandas(run, "cls long, others long, root long"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, n_links (other rows linked directly), component_id (least key that links reach), kept (key = component_id)."""
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = cut(rows.withColumn("cls", F.when(sound, F.xxhash64("label", "v"))))
    classes = cut(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")))
    found = links(classes.select("cls", "label", "v", "copies"), threshold)
    small = classes.select("cls", "rep", "copies")
    others = found.groupBy("cls").agg(F.sum("others").alias("others"))
    joined = components(found, "cls", "root").withColumnRenamed("node", "cls")
    least = joined.join(small, "cls").groupBy("component").agg(F.min("rep").alias("least"))
    told = (
        small.join(others, "cls", "left")
        .join(joined.join(least, "component").select("cls", "least"), "cls", "left")
        .select("cls", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    )
    told = told.where("n_links > 0 OR component_id IS NULL")
    # vectors that link with nothing aren't joined: they say all there is to say of themselves
    out = rows.where("cls IS NOT NULL").select("id", "cls").join(told, "cls", "left").select("id", "n_links", "component_id").union(rows.where("cls IS NULL").select("id", F.lit(0).cast("long"), "id"))
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).withColumnRenamed("id", key)
