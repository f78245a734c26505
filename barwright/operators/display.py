"""Shaping of results for charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.operators.chunks import last_rows
from barwright.operators.dedup import keep_one
from barwright.sources.candles import KEYS, PRICES


def seconds(ts: Column) -> Column:
    return F.floor(ts / 1000)


def complete(bars: DataFrame, with_volume: bool = True) -> DataFrame:
    """Bars without a null price; volume counts only when asked for, else it is 0."""
    if not with_volume:
        return bars.na.drop(subset=["timestamp", *PRICES[:4]]).withColumn("volume", F.lit(0.0))
    return bars.na.drop(subset=["timestamp", *PRICES])


def markers(bars: DataFrame, signal: str, shape: str = "arrowUp") -> DataFrame:
    """A marker for each bar whose signal is true."""
    below = shape in ("arrowUp", "circle")
    return bars.where(F.coalesce(F.col(signal), F.lit(False))).select(*KEYS, seconds(F.col("timestamp")).alias("time"), F.lit(shape).alias("shape"), F.lit("belowBar" if below else "aboveBar").alias("position"))


def valued(points: DataFrame, value: str) -> DataFrame:
    return points.where(F.col(value).isNotNull() & ~F.isnan(value))


def has_values(points: DataFrame, value: str) -> DataFrame:
    return points.groupBy(*KEYS).agg(F.bool_or(F.col(value).isNotNull() & ~F.isnan(value)).alias("has_values"))


def timed(points: DataFrame) -> DataFrame:
    """Points that have a time; their values may be null."""
    return points.where(F.col("timestamp").isNotNull())


def align(bars: DataFrame, points: DataFrame, value: str) -> DataFrame:
    """Each bar's point on the same second, the last of several; null where there is none."""
    timed_points = points.where(F.col("timestamp").isNotNull()).select(*KEYS, seconds(F.col("timestamp")).alias("time"), "timestamp", value)
    one = keep_one(timed_points, [*KEYS, "time"], "timestamp").drop("timestamp")
    return bars.select(*KEYS, seconds(F.col("timestamp")).alias("time")).join(one, [*KEYS, "time"], "left")


def volume_bars(bars: DataFrame) -> DataFrame:
    return bars.select(*KEYS, seconds(F.col("timestamp")).alias("time"), "volume", (F.col("close") >= F.col("open")).alias("is_up"))


def trim_warmup(bars: DataFrame, shown: int) -> DataFrame:
    """The newest bars, taken after indicators have used the older ones."""
    return last_rows(bars, shown)
