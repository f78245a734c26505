"""Candles: schema, ticks to candles, the day-partitioned warehouse, upsert, and decoding of landed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.operators.dedup import keep_one
from barwright.sources import folders
from barwright.sources.folders import new_scratch as scratch

KEYS = ["exchange", "category", "symbol", "interval"]
PRICES = ["open", "high", "low", "close", "volume"]
SCHEMA = ", ".join([*(f"{k} string" for k in KEYS), "timestamp long", *(f"{p} double" for p in PRICES)])
DAY_MS = 86_400_000


def day_of(ts: Column) -> Column:
    return F.to_date(F.timestamp_millis(ts))


def candles_from_ticks(ticks: DataFrame, symbol: str, time: str, price: str, tie: str, exchange: str = "x", category: str = "spot") -> DataFrame:
    """1-minute candles of ticks; equal times are ordered by tie, volume counts ticks."""
    ms = F.unix_millis(F.col(time).cast("timestamp"))
    order = F.struct(time, tie)
    return (
        ticks.groupBy(F.col(symbol).alias("symbol"), (ms - F.pmod(ms, F.lit(60_000))).alias("timestamp"))
        .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").cast("double").alias("volume"))
        .select(F.lit(exchange).alias("exchange"), F.lit(category).alias("category"), "symbol", F.lit("1min").alias("interval"), "timestamp", *PRICES)
    )


def in_memory(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


class NoStore(LookupError):
    """There is no store, or no such series in it."""


def opened(spark: SparkSession, path: str, keys: dict[str, str] | None = None) -> DataFrame:
    """Stored candles with their day, of the series given by keys; NoStore if there is no folder, or none of the series named by all keys."""
    series = "/".join(f"{k}={(keys or {})[k]}" for k in KEYS) if keys and all(keys.get(k) is not None for k in KEYS) else ""
    for place in (path, f"{path.rstrip('/')}/{series}"):
        if not folders.exists(spark, place):
            raise NoStore(f"nothing is stored at {place}")
    df = spark.read.schema(f"{SCHEMA}, day date").parquet(path)
    for k, v in (keys or {}).items():
        df = df.where(F.col(k) == v)
    return df


def time_filter(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Both ends inclusive, either may be open."""
    if start is not None:
        df = df.where(F.col("timestamp") >= start)
    return df if end is None else df.where(F.col("timestamp") <= end)


def write(candles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder for each series and UTC day, sorted by time inside; overwriting replaces only the days written."""
    (
        candles.withColumn("day", day_of(F.col("timestamp")))
        .repartition(*KEYS, "day")
        .sortWithinPartitions(*KEYS, "timestamp")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*KEYS, "day")
        .parquet(path)
    )


def scan(spark: SparkSession, path: str, keys: dict[str, str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Stored candles of the series given by keys (all if none), with day folders pruned to the range and a day around it.

    A range without candles gives none; without a store, or the series that all keys name, NoStore is raised.
    """
    df = opened(spark, path, keys)
    low, high = (start, end) if start is None or end is None or start <= end else (end, start)
    if low is not None:
        df = df.where(F.col("day") >= F.date_sub(day_of(F.lit(low)), 1))
    if high is not None:
        df = df.where(F.col("day") <= F.date_add(day_of(F.lit(high)), 1))
    return time_filter(df, start, end).select(*KEYS, "timestamp", *PRICES)


def dataset_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of data files of each series, and when one was last written."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length", "modificationTime")
    keys = [F.regexp_extract("path", f"/{k}=([^/]*)/", 1).alias(k) for k in KEYS]
    return files.select(*keys, "length", "modificationTime").groupBy(*KEYS).agg(F.sum("length").alias("approx_size_bytes"), F.max("modificationTime").alias("last_updated"))


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    """(keys, day, from, to, record_count) of every stored day, from the footers of its files: no row group is read.

    Aggregates are pushed to Parquet when they group by all partition columns, in a session of its own that reads files by the second source interface.
    """
    own = spark.newSession()
    for name, value in (("spark.sql.sources.useV1SourceList", ""), ("spark.sql.parquet.aggregatePushdown", "true"), ("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))):
        own.conf.set(name, value)
    opened(spark, path)
    held = own.read.schema(f"{SCHEMA}, day date").parquet(path)
    return held.groupBy(*KEYS, "day").agg(F.min("timestamp").alias("from"), F.max("timestamp").alias("to"), F.count("*").alias("record_count"))


def partitions(spark: SparkSession, path: str, days: DataFrame, low: object, high: object) -> DataFrame:
    """Stored candles, with their day, of the (keys, day) in days, between two dates; other folders aren't read where days are few enough to be broadcast."""
    held = opened(spark, path)
    inside = F.col("day").between(F.lit(low), F.lit(high))
    return held.where(inside).join(days.where(inside), [*KEYS, "day"], "left_semi")


def upsert(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Adds candles to the store: of rows with the same series and time the fresh one stays, all other rows are kept.

    Only the series' days that fresh rows touch are read. They are staged beside the store and then swapped in, folder by folder; an upsert
    that is cut short before the swap leaves the old days, and one cut short in it is finished by the next (folders.recover). One
    writer at a time. Rows without a key or a time are refused.
    """
    depth = len(KEYS) + 1
    folders.recover(spark, path, depth)
    staged = folders.staging(path)
    with folders.scratch(spark) as once:
        fresh.select(*KEYS, "timestamp", *PRICES).withColumn("day", day_of(F.col("timestamp"))).write.parquet(once)
        fresh = spark.read.schema(f"{SCHEMA}, day date").parquet(once)
        low, high, empty = fresh.agg(F.min("day"), F.max("day"), F.count_if(F.expr(" OR ".join(f"`{c}` IS NULL" for c in (*KEYS, "timestamp"))))).first()  # one row
        if empty:
            raise ValueError(f"{empty} rows have no key or no time")
        if low is None:
            return
        held = partitions(spark, path, fresh.select(*KEYS, "day").distinct(), low, high)
        both = held.withColumn("arrival", F.lit(0)).unionByName(fresh.withColumn("arrival", F.lit(1)))
        try:
            write(keep_one(both, [*KEYS, "timestamp"], "arrival", "last").drop("arrival", "day"), staged)
            folders.swap(spark, path, staged, depth)
        except Exception:
            folders.recover(spark, path, depth)
            raise


def incremental(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Upserts what is not older than each series' last stored time, which the footers of its files give."""
    last = stored_days(spark, path).groupBy(*KEYS).agg(F.max("to").alias("last_ts"))
    newer = fresh.join(last, KEYS, "left").where("last_ts IS NULL OR timestamp >= last_ts").drop("last_ts")
    upsert(spark, path, newer)


PAGE = "retCode int, retMsg string, result struct<symbol: string, category: string, list: array<array<string>>>"


def decode_pages(pages: DataFrame, body: str = "body", also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(candles with symbol, product class and the pages' columns `also`, bad items): pages are JSON with lists of time, open, high, low, close, volume, turnover."""
    page = pages.withColumn("page", F.from_json(body, PAGE))
    good = page.where("page.retCode = 0").select(*also, "page.result.symbol", F.col("page.result.category").alias("product_class"), F.explode("page.result.list").alias("item"))
    item = lambda i, kind: F.get("item", F.lit(i)).try_cast(kind)
    cast = good.select(*also, "symbol", "product_class", "item", item(0, "long").alias("timestamp"), *(item(i + 1, "double").alias(p) for i, p in enumerate(PRICES)))
    whole = F.col("timestamp").isNotNull()
    for p in PRICES:
        whole = whole & F.col(p).isNotNull()
    failed = page.where("page.retCode IS NULL OR page.retCode <> 0").select(F.col(body).alias("bad"))
    return cast.where(whole).drop("item"), cast.where(~whole).select(F.to_json("item").alias("bad")).union(failed)


def history(pages: DataFrame, exchange: str, category: str, arrival: str = "arrival", body: str = "body") -> DataFrame:
    """1-minute candles of all pages of a market's symbols, which may overlap: of the same time, the first arrival stays."""
    good, _ = decode_pages(pages, body, (arrival,))
    named = good.select(F.lit(exchange).alias("exchange"), F.lit(category).alias("category"), "symbol", F.lit("1min").alias("interval"), "timestamp", *PRICES, arrival)
    return keep_one(named, [*KEYS, "timestamp"], arrival, "first").drop(arrival)


def fetch_plan(spans: DataFrame, most: int = 1000) -> DataFrame:
    """spans (start, end) cut into pages of at most `most` one-minute bars: (.., low, high), both ends inclusive."""
    floor = lambda c: F.col(c) - F.col(c) % 60_000
    whole = spans.withColumns({"_a": floor("start"), "_b": floor("end")}).where("_a < _b")
    pages = whole.withColumn("low", F.explode(F.sequence("_a", F.col("_b") - 1, F.lit(most * 60_000).cast("long"))))
    return pages.withColumn("high", F.least(F.col("_b"), F.col("low") + (most - 1) * 60_000)).drop("_a", "_b")
