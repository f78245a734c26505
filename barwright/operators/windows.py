"""Candle windows: resolving partial requests, the last rows of a series, paging."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.functions.interval import Interval
from barwright.operators.chunks import last_rows
from barwright.operators.resample import resample
from barwright.sources.candles import KEYS, PRICES, day_of, opened, stored_days
from barwright.sources.folders import settled

# Bars without a limit, and bars by which a derived window is longer.
DEFAULT_LIMIT, BUFFER = 1000, 50


def resolve(requests: DataFrame, interval: str, start: str = "start", end: str = "end", limit: str = "limit", low: str = "from", high: str = "to") -> DataFrame:
    """requests with start_ms, end_ms, row_limit and error (null if the window is good); low and high are the series' bounds, null if unknown."""
    ivl = Interval.parse(interval)
    s, e, n, a, b = (F.col(c).cast("long") for c in (start, end, limit, low, high))
    both = s.isNotNull() & e.isNotNull()
    most = F.when(n.isNotNull(), n).when(~both, F.lit(DEFAULT_LIMIT).cast("long"))
    last = F.when(e.isNotNull(), e).when(s.isNotNull(), ivl.shift(s, most + BUFFER)).otherwise(b)
    first = F.when(s.isNotNull(), s).otherwise(ivl.shift(last, -(most + BUFFER)))
    first_ms, last_ms = F.when(a.isNull(), first).otherwise(F.greatest(first, a)), F.when(b.isNull(), last).otherwise(F.least(last, b))
    error = (
        F.when(both & (s > e), "start must not be after end")
        .when(s.isNull() & e.isNull() & b.isNull(), "the latest candles need the bounds of the series")
        .when(first_ms > last_ms, "the window is empty within the bounds of the series")
    )
    good = error.isNull()
    return requests.withColumns({"start_ms": F.when(good, first_ms), "end_ms": F.when(good, last_ms), "row_limit": F.when(good, most), "error": error})


def load(candles: DataFrame, requests: DataFrame, interval: str = "1min", request: str | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """Bars of every request (keys, start, end, limit): windows resolved by the series' bounds, then range, resampling and limit, in that order.

    Every request is answered on its own. `request` names a column of the requests that the bars carry, so that
    several for one series can be told apart; rows that are equal in it, the series and the window are one request.
    Bounds (keys, from, to) are made of the candles if the catalog's aren't given.
    """
    if bounds is None:
        bounds = candles.groupBy(*KEYS).agg(F.min("timestamp").alias("from"), F.max("timestamp").alias("to"))
    own = [] if request is None else [request]
    windows = resolve(requests.join(bounds.select(*KEYS, "from", "to"), KEYS, "left"), interval).where("error IS NULL").select(*own, *KEYS, "start_ms", "end_ms", "row_limit").distinct()
    each = [*own, "start_ms", "end_ms", "row_limit"]
    return _answered(candles.join(windows, KEYS).where("timestamp BETWEEN start_ms AND end_ms").select(*each, *candles.columns), each, interval)


def _answered(bars: DataFrame, each: list[str], interval: str, limited: bool = True) -> DataFrame:
    """Resampled and limited bars of requests."""
    if Interval.parse(interval) != Interval(1, "m"):
        bars = resample(bars, interval, also=tuple(each)).select(*each, *KEYS, "timestamp", *PRICES)
    return (last_rows(bars, "row_limit", [*each, *KEYS]) if limited else bars).drop("start_ms", "end_ms", "row_limit")


#: Rows of (series, day) that are broadcast at most; with more, the join shuffles.
FEW_DAYS = 200_000
NO_DAY = datetime.date(1970, 1, 1)


def load_stored(spark: SparkSession, path: str, requests: DataFrame, bounds: DataFrame, interval: str = "1min", request: str | None = None) -> DataFrame:
    """load() of a store whose catalog has the bounds: an interval join on days.

    Windows are cut into their days, which meet the store's folders by series and day: requests of ranges that lie far apart
    read only their own days, each of its own series.
    """
    own = [] if request is None else [request]
    each = [*own, "start_ms", "end_ms", "row_limit"]
    # a series without bounds has nothing stored
    windows = resolve(requests.join(bounds.select(*KEYS, "from", "to"), KEYS), interval).where("error IS NULL AND start_ms <= end_ms").select(*each, *KEYS).distinct()
    days = F.explode(F.sequence(day_of(F.col("start_ms")), day_of(F.col("end_ms")))).alias("day")
    wanted = settled(windows.select("*", days))
    low, high, n, limits = wanted.agg(F.min("day"), F.max("day"), F.count("*"), F.count("row_limit")).first()  # one row
    inside = F.col("day").between(F.lit(low or NO_DAY), F.lit(high or NO_DAY))
    wanted = wanted.where(inside)
    held = opened(spark, path).where(inside)
    bars = held.join(F.broadcast(wanted) if n <= FEW_DAYS else wanted, [*KEYS, "day"]).where("timestamp BETWEEN start_ms AND end_ms")  # FEW_DAYS rows at most
    return _answered(bars.select(*each, *KEYS, "timestamp", *PRICES), each, interval, limits > 0)


def latest_stored(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last n candles of each stored series: days are counted backwards by the footers of their files, and only those needed are read."""
    back = Window.partitionBy(*KEYS).orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.sum("record_count").over(back), F.lit(0))
    quota = (F.lit(n) - after).alias("_quota")
    needed = settled(stored_days(spark, path).select(*KEYS, "day", quota).where("_quota > 0"))
    low, high, days = needed.agg(F.min("day"), F.max("day"), F.count("*")).first()  # one row
    inside = F.col("day").between(F.lit(low or NO_DAY), F.lit(high or NO_DAY))
    needed = needed.where(inside)
    held = opened(spark, path).where(inside).join(F.broadcast(needed) if days <= FEW_DAYS else needed, [*KEYS, "day"])  # FEW_DAYS rows at most
    place = F.row_number().over(Window.partitionBy(*KEYS, "day").orderBy(F.desc("timestamp")))
    return held.withColumn("_place", place).where("_place <= _quota").select(*KEYS, "timestamp", *PRICES)


def page(bars: DataFrame, before: int | None, count: int, warmup: int = 0) -> DataFrame:
    """The newest count + warmup bars of each series before a time, and has_more: whether older ones are left."""
    older = bars if before is None else bars.where(F.col("timestamp") < before)
    first = older.groupBy(*KEYS).agg(F.min("timestamp").alias("_first"))
    taken = last_rows(older, count + warmup)
    oldest = taken.groupBy(*KEYS).agg(F.min("timestamp").alias("_oldest")).join(first, KEYS).select(*KEYS, (F.col("_oldest") > F.col("_first")).alias("has_more"))
    return taken.join(oldest, KEYS)
