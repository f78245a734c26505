"""Streaming bars and streaming upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from barwright.functions.interval import Interval
from barwright.sources.candles import PRICES, upsert

LENGTHS = {"s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week"}


def stream_bars(ticks: DataFrame, symbol: str, time: str, price: str, tie: str, interval: str, delay: str, exchange: str = "x", category: str = "spot") -> DataFrame:
    """Bars of a stream of ticks, each given once the watermark has passed its end. Months and years have no fixed length and are refused."""
    ivl = Interval.parse(interval)
    if ivl.unit not in LENGTHS:
        raise ValueError("streams take seconds to weeks")
    length = f"{ivl.n} {LENGTHS[ivl.unit]}"
    window = F.window("_ts", length, length, "4 days") if ivl.unit == "w" else F.window("_ts", length)
    order = F.struct("_ts", tie)
    timed = ticks.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", delay)
    bars = timed.groupBy(F.col(symbol).alias("symbol"), window.alias("w")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select(F.lit(exchange).alias("exchange"), F.lit(category).alias("category"), "symbol", F.lit(str(ivl)).alias("interval"), F.unix_millis("w.start").alias("timestamp"), *PRICES)


def state_parts(spark: SparkSession) -> int:
    """Two for each core, but not more than a shuffle has."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _started(spark: SparkSession, writer: DataStreamWriter, parts: int | None) -> StreamingQuery:
    """Starts a stream that keeps its state in so many partitions, state_parts() if None; a checkpoint keeps the number that it began with.

    Each partition of each stateful step writes its files in every micro-batch, however few rows it has, and nothing merges small ones in a stream.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(parts or state_parts(spark)))
    try:
        return writer.trigger(availableNow=True).start()  # which copies the session
    finally:
        spark.conf.set(name, before)


def write_bars(bars: DataFrame, path: str, checkpoint: str, parts: int | None = None) -> StreamingQuery:
    return _started(bars.sparkSession, bars.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append"), parts)


def candle_updates(ticks: DataFrame, symbol: str, time: str, price: str, tie: str, delay: str, exchange: str = "x", category: str = "spot") -> DataFrame:
    """1-minute candles of a stream of ticks, for update mode: each batch gives the minutes that it changes, made of all their ticks so far.

    The state holds minutes and tick identities (symbol and tie) until the watermark, the greatest time less the delay, has passed them.
    Ticks that are sent again within the delay count once; ticks older than the watermark are dropped.
    """
    timed = ticks.select(F.col(symbol).alias("symbol"), F.col(time).cast("timestamp").alias("_ts"), F.col(price).alias("_price"), F.col(tie).alias("_tie")).withWatermark("_ts", delay)
    order = F.struct("_ts", "_tie")
    bars = timed.dropDuplicatesWithinWatermark(["symbol", "_tie"]).groupBy("symbol", F.window("_ts", "1 minute").alias("w")).agg(
        F.min_by("_price", order).alias("open"), F.max("_price").alias("high"), F.min("_price").alias("low"), F.max_by("_price", order).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select(F.lit(exchange).alias("exchange"), F.lit(category).alias("category"), "symbol", F.lit("1min").alias("interval"), F.unix_millis("w.start").alias("timestamp"), *PRICES)


def upsert_stream(ticks: DataFrame, store: str, checkpoint: str, symbol: str, time: str, price: str, tie: str, delay: str, exchange: str = "x", category: str = "spot", parts: int | None = None) -> StreamingQuery:
    """Upserts the 1-minute candles that each micro-batch changes.

    A candle is whole in every batch that changes it, so a batch that is run again gives the same store, and nothing
    but the stream's own state is kept between batches. The upsert's jobs run in the session of the ticks, with that one's shuffle partitions.
    """
    spark = ticks.sparkSession
    updates = candle_updates(ticks, symbol, time, price, tie, delay, exchange, category)
    batch = lambda rows, number: upsert(spark, store, rows)
    return _started(spark, updates.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint), parts)
