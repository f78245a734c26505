"""Resampling of candles to any interval, all series in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.functions.interval import Interval
from barwright.sources.candles import KEYS, PRICES


def resample(candles: DataFrame, interval: str | Interval, ties: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """Left-closed, left-labelled buckets: first open, highest high, lowest low, last close, summed volume. Empty buckets aren't made. Rows that differ in `also` stay apart."""
    target = interval if isinstance(interval, Interval) else Interval.parse(interval)
    order = F.struct("timestamp", *ties)
    keys = [*also, *(k for k in KEYS if k != "interval")]
    return (
        candles.groupBy(*keys, target.bucket(F.col("timestamp")).cast("long").alias("bucket"))
        .agg(F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"))
        .select(*keys, F.lit(str(target)).alias("interval"), F.col("bucket").alias("timestamp"), *PRICES)
    )
