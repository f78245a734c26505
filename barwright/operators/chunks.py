"""Series cut into chunks with a halo, so that windows over a few bars need no task that holds a series.

Days are counted for each series; from the running counts each day gets its chunk, and the chunks that begin so soon after it that
they look back on it. A day's bars are copied to those as their halo, windows run by series and chunk, and halo bars are
dropped again. What meets by series is one row for each day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barwright.sources.candles import DAY_MS, KEYS

#: Bars of a chunk, without its halo; days are whole, so a chunk may be a day longer.
ROWS = 16_384


def in_chunk() -> WindowSpec:
    """A chunk's bars in time's order; only inside along()."""
    return Window.partitionBy(*KEYS, "_chunk").orderBy("timestamp")


def same(left: list[str], right: list[str]) -> Column:
    """Equality of columns in which null equals null."""
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def named(df: DataFrame) -> list[Column]:
    """df's columns, whose names may hold dots."""
    return [F.col(f"`{c}`") for c in df.columns]


def day_number(order: str = "timestamp") -> Column:
    return F.floor(F.col(order) / DAY_MS)


def along(df: DataFrame, lookback: int, add: Callable[[DataFrame], DataFrame], rows: int = ROWS, bars: DataFrame | None = None) -> DataFrame:
    """add(df), where its windows over in_chunk() may look at a bar and at the `lookback` bars before it.

    add() keeps the columns and the bars. Bars without a time are the first of their series. `bars` is a table of the same bars
    in which the days are counted; where df's columns cost work, the table before them spares it.
    """
    if lookback < 1:
        return add(df.withColumn("_chunk", F.lit(0))).drop("_chunk")
    names = [f"_c_{k}" for k in (*KEYS, "day")]
    counted = df if bars is None else bars
    days = counted.select(*(F.col(k).alias(n) for k, n in zip(KEYS, names)), day_number().alias(names[-1])).groupBy(*names).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*names[:-1]).orderBy(names[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own, end = F.floor(F.col("_before") / rows), F.col("_before") + F.col("_n")
    placed = days.withColumn("_before", before).withColumns({"_own": own, "_next": F.greatest(own + 1, F.floor(end / rows)), "_last": F.floor((end + lookback - 1) / rows)})
    copies = F.when(F.col("_last") >= F.col("_next"), F.concat(F.array("_own"), F.sequence("_next", F.greatest("_next", "_last")))).otherwise(F.array("_own"))
    placed = placed.select(*names, "_own", copies.alias("_copies"))
    cut = df.withColumn("_day", day_number()).join(placed, same([*KEYS, "_day"], names)).select(*named(df), "_own", F.explode("_copies").alias("_chunk"))
    return add(cut).where("_chunk = _own").drop("_chunk", "_own")


def last_rows(df: DataFrame, n: int | str, keys: list[str] = KEYS, order: str = "timestamp") -> DataFrame:
    """The last rows of each series by a time in milliseconds; n is a number or the name of a column that is the same in a series (null: all).

    Days are counted backwards until they hold n rows; only those days' rows are joined and shuffled, by series and day, and only in
    the first of these days rows are numbered. Rows without a time come before all others; of equal times, any.
    """
    most = F.lit(n) if isinstance(n, int) else F.col(n)
    names = [f"_l_{i}" for i in range(len(keys) + 1)]
    days = df.select(*(F.col(k).alias(x) for k, x in zip(keys, names)), day_number(order).alias(names[-1]), most.cast("long").alias("_most")).groupBy(*names).agg(F.count("*").alias("_n"), F.max("_most").alias("_most"))
    after = F.coalesce(F.sum("_n").over(Window.partitionBy(*names[:-1]).orderBy(F.desc(names[-1])).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = days.withColumn("_after", after).where("_most IS NULL OR _after < _most").select(*names, (F.col("_most") - F.col("_after")).alias("_quota"))
    held = df.withColumn("_day", day_number(order)).join(needed, same([*keys, "_day"], names))
    back = Window.partitionBy(*names).orderBy(F.desc(order))
    return held.withColumn("_back", F.row_number().over(back)).where("_quota IS NULL OR _back <= _quota").select(*named(df))
