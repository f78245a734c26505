"""SMA, EMA and RSI for all series at once.

SMA looks back on a few bars: series are cut into chunks with a halo (chunks.py).
EMA and RSI are linear recurrences y[t] = a * y[t-1] + b[t]. They are solved in chunks of a day's bars, in parallel
within a series: each chunk sums its own part, one small row for each chunk carries the value over, and the
carried value is added back. No task holds a series.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barwright.functions.logic import nan_to_null
from barwright.operators.chunks import ROWS, along, in_chunk
from barwright.sources.candles import DAY_MS, KEYS


def in_series() -> WindowSpec:
    """The bars of a series, in time's order."""
    return Window.partitionBy(*KEYS).orderBy("timestamp")


def check_period(period: int) -> int:
    if not isinstance(period, int) or isinstance(period, bool) or period < 1:
        raise ValueError(f"period must be a whole number above 0: {period!r}")
    return period


def sma(value: Column, period: int, w: WindowSpec | None = None) -> Column:
    """Mean of the last `period` bars; null before there are as many, and while one of them has no value (null or NaN).

    The window is by series, or by chunk (in_chunk) where series are cut into chunks with a halo of period - 1 bars.
    """
    value = nan_to_null(value)
    frame = (w or in_series()).rowsBetween(1 - check_period(period), 0)
    return F.when(F.count(value).over(frame) == period, F.avg(value).over(frame))


def with_sma(df: DataFrame, value: str, period: int, out: str, rows: int = ROWS) -> DataFrame:
    """df with sma(), by chunks: no task holds a series."""
    return along(df, check_period(period) - 1, lambda cut: cut.withColumn(out, sma(F.col(f"`{value}`"), period, in_chunk())), rows)


def placed(df: DataFrame, at: str) -> DataFrame:
    """df with `at`, the place of each bar in its series from 0."""
    day = F.floor(F.col("timestamp") / DAY_MS)
    daily = df.groupBy(*KEYS, day.alias("_day")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*KEYS).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*KEYS, "_day").orderBy("timestamp"))
    return df.withColumn("_day", day).join(daily.select(*KEYS, "_day", before.alias("_before")), [*KEYS, "_day"]).withColumn(at, F.col("_before") + inside - 1).drop("_day", "_before")


def smoothed(df: DataFrame, value: str, out: str, a: float, scale: float, seed: tuple[int, int], terms: dict[str, Column], result: Column, changes: bool) -> DataFrame:
    """df with `out`, of y[t] = a * y[t-1] + scale * term[t] over the bars that have a value; other bars get null.

    `terms` are columns over _x, the value, and _before, the value before it (null at a day's first bar); with `changes` a
    day's first terms are made of the last value of the day before. y starts at place seed[1] with the mean of the terms
    from place seed[0] on. Since y is linear, it is solved from zero in chunks of a day, and what a chunk gets from the bars before
    it and from the start decays by powers of a. Bars are shuffled once, by series and day; a row for each chunk meets by series.
    """
    length, names = max(1, min(512, int(230 / max(1e-9, -math.log10(a))))), list(terms)
    x = F.col(f"`{value}`")
    day = Window.partitionBy(*KEYS, "_day").orderBy("timestamp")
    sofar = day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = df.withColumns({"_day": F.floor(F.col("timestamp") / DAY_MS), "_x": F.when(x.isNotNull() & ~F.isnan(x), x)})
    held = held.withColumns({"_in": F.count("_x").over(sofar) - 1, "_before": F.last("_x", True).over(day.rowsBetween(Window.unboundedPreceding, -1))})
    held = held.withColumns({"_sub": F.floor(F.col("_in") / length), "_o": F.col("_in") % length, **{f"_b_{k}": F.when(F.col("_x").isNotNull(), F.coalesce(c, F.lit(0.0))) for k, c in terms.items()}})
    chunk = Window.partitionBy(*KEYS, "_day", "_sub").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up, down = F.pow(F.lit(a), F.col("_o")), F.pow(F.lit(a), -F.col("_o"))
    held = held.withColumns({f"_z_{k}": scale * up * F.sum(F.col(f"_b_{k}") * down).over(chunk) for k in names})
    early = F.array_sort(F.collect_list(F.when(F.col("_in") <= seed[1], F.struct("_in", *(f"_b_{k}" for k in names)))))
    chunks = (
        held.where("_x IS NOT NULL")
        .groupBy(*KEYS, "_day", "_sub")
        .agg(F.count("*").alias("n"), F.min_by("_x", "_o").alias("first"), F.max_by("_x", "_o").alias("last"), early.alias("early"), *(F.max_by(f"_z_{k}", "_o").alias(f"end_{k}") for k in names))
    )

    def carried(group: pd.DataFrame) -> pd.DataFrame:
        """For each day: bars before it, what each of its chunks gets, and what the start adds."""
        total, last, carry, opening = 0, None, dict.fromkeys(names, 0.0), {k: [] for k in names}
        days: dict[int, dict] = {}
        for row in group.sort_values(["_day", "_sub"]).to_dict("records"):
            jump = row["first"] - last if changes and row["_sub"] == 0 and last is not None else 0.0
            first = dict(zip(names, (max(jump, 0.0), max(-jump, 0.0)))) if changes else dict.fromkeys(names, 0.0)
            own = days.setdefault(row["_day"], {"place": total, **{f"carry_{k}": [] for k in names}})
            for k in names:
                got = carry[k] + (scale * first[k] / a if row["_sub"] == 0 else 0.0)
                own[f"carry_{k}"].append(got)
                carry[k] = row[f"end_{k}"] + a ** row["n"] * got
                opening[k] += [e[f"_b_{k}"] + (first[k] if e["_in"] == 0 else 0.0) for e in row["early"] if own["place"] + e["_in"] <= seed[1]]
            total, last = total + row["n"], row["last"]
        made = pd.DataFrame([{"_day": d, **own} for d, own in days.items()])
        for k in names:
            start = sum(opening[k][seed[0] :]) / (seed[1] - seed[0] + 1)
            made[f"start_{k}"] = start - sum(scale * b * a ** (seed[1] - t) for t, b in enumerate(opening[k]))
        for k in KEYS:
            made[k] = group[k].iloc[0]
        return made[[*KEYS, "_day", "place", *(f"{p}_{k}" for k in names for p in ("carry", "start"))]]

    kinds = ", ".join([*(f"{k} string" for k in KEYS), "_day long, place long", *(f"carry_{k} array<double>, start_{k} double" for k in names)])
    days = chunks.groupBy(*KEYS).applyInPandas(carried, kinds)
    both = held.join(days, [*KEYS, "_day"], "left").withColumn("_at", F.col("place") + F.col("_in"))
    own = {f"_y_{k}": F.col(f"_z_{k}") + F.pow(F.lit(a), F.col("_o") + 1) * F.get(f"carry_{k}", F.col("_sub").cast("int")) + F.pow(F.lit(a), F.col("_at") - seed[1]) * F.col(f"start_{k}") for k in names}
    good = F.col("_x").isNotNull() & (F.col("_at") >= seed[1])
    # before the start the powers would grow
    return both.withColumns({k: F.when(good, c) for k, c in own.items()}).withColumn(out, F.when(good, result)).select(*(F.col(f"`{c}`") for c in [*df.columns, out]))


def ema(df: DataFrame, value: str, period: int, out: str) -> DataFrame:
    """Exponential mean with k = 2 / (period + 1), seeded with the mean of the first `period` values; bars without a value (null or NaN) are passed over."""
    p, k = check_period(period), 2 / (period + 1)
    if p == 1:
        return df.withColumn(out, nan_to_null(F.col(f"`{value}`").cast("double")))
    return smoothed(df, value, out, 1 - k, k, (0, p - 1), {"v": F.col("_x")}, F.col("_y_v"), False)


def rsi(df: DataFrame, value: str, period: int, out: str, tiny: float = 0.0) -> DataFrame:
    """Wilder's RSI over the bars that have a value: the first `period` of them are null; 0 where the mean gain and loss together don't exceed `tiny`."""
    p = check_period(period)
    ratio = lambda g, l: F.when(g + l > tiny, 100 * g / (g + l)).otherwise(0.0)
    if p == 1:
        x = nan_to_null(F.col(f"`{value}`").cast("double"))
        d = x - F.last(x, True).over(in_series().rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn(out, F.when(d.isNotNull(), ratio(F.greatest(d, F.lit(0.0)), F.greatest(-d, F.lit(0.0)))))
    d = F.col("_x") - F.col("_before")
    terms = {"g": F.greatest(d, F.lit(0.0)), "l": F.greatest(-d, F.lit(0.0))}
    return smoothed(df, value, out, (p - 1) / p, 1 / p, (1, p), terms, ratio(F.col("_y_g"), F.col("_y_l")), True)
