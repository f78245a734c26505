"""The catalog of stored series, its lookups and set questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.sources.candles import KEYS, PRICES, stored_days
from barwright.sources.folders import exists

SCHEMA = "exchange string, category string, symbol string, interval string, from long, to long, record_count long, approx_size_bytes long, last_updated timestamp, version int, generated_at timestamp"
#: Fixed value: the version of a saved snapshot.
VERSION = 1


def time_bounds(candles: DataFrame) -> DataFrame:
    return candles.groupBy(*KEYS).agg(F.min("timestamp").alias("from"), F.max("timestamp").alias("to"))


def last_timestamp(candles: DataFrame) -> DataFrame:
    return candles.groupBy(*KEYS).agg(F.max("timestamp").alias("last_ts"))


def of_store(spark: SparkSession, path: str, sizes: DataFrame | None = None) -> DataFrame:
    """snapshot() of a store by its files' footers."""
    out = stored_days(spark, path).groupBy(*KEYS).agg(F.min("from").alias("from"), F.max("to").alias("to"), F.sum("record_count").alias("record_count"))
    return out if sizes is None else out.join(sizes, KEYS, "left")


def snapshot(candles: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Coverage of every series that has rows; bytes and the time of the last write are joined on where sizes (dataset_bytes) are given."""
    out = candles.groupBy(*KEYS).agg(F.min("timestamp").alias("from"), F.max("timestamp").alias("to"), F.count("*").alias("record_count"))
    return out if sizes is None else out.join(sizes, KEYS, "left")


def save(catalog: DataFrame, path: str) -> None:
    """Each row carries the snapshot's version and the time it was made."""
    missing = {c: F.lit(None).cast(t) for c, t in (("approx_size_bytes", "long"), ("last_updated", "timestamp")) if c not in catalog.columns}
    catalog = catalog.withColumns({**missing, "version": F.lit(VERSION), "generated_at": F.current_timestamp()})
    catalog.write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """None if there is no such path; other faults are raised."""
    return spark.read.schema(SCHEMA).json(path) if exists(spark, path) else None


def totals(catalog: DataFrame) -> DataFrame:
    """Series, candles and the latest time; bytes too where the catalog has them."""
    own = [F.coalesce(F.sum("approx_size_bytes"), F.lit(0)).alias("bytes")] if "approx_size_bytes" in catalog.columns else []
    return catalog.agg(F.count("*").alias("datasets"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("candles"), F.max("to").alias("latest"), *own)


def search(catalog: DataFrame, term: str) -> DataFrame:
    """Series whose exchange, category, symbol or interval contains the trimmed term, in any case."""
    needle, hit = term.strip().lower(), F.lit(False)
    for k in KEYS:
        hit = hit | F.lower(k).contains(needle)
    return catalog.where(hit)


def lookup(requests: DataFrame, catalog: DataFrame, candles: DataFrame) -> DataFrame:
    """Bounds of the requested series from the catalog, else from the candles."""
    known = catalog.select(*KEYS, "from", "to")
    left = requests.select(*KEYS).distinct().join(known, KEYS, "left_anti")
    scanned = time_bounds(candles.join(left, KEYS, "left_semi"))  # only the series that the catalog hasn't
    return requests.join(known.unionByName(scanned), KEYS, "left")


def market_symbols(catalog: DataFrame, exchange: str, category: str) -> DataFrame:
    return catalog.where((F.col("exchange") == exchange) & (F.col("category") == category)).select("symbol").distinct()


def missing_symbols(offered: DataFrame, catalog: DataFrame) -> DataFrame:
    return offered.join(catalog.select("symbol").distinct(), "symbol", "left_anti")


def selected_symbols(chosen: DataFrame, offered: DataFrame) -> DataFrame:
    return chosen.join(offered.select("symbol").distinct(), "symbol", "left_semi")


def null_counts(candles: DataFrame) -> DataFrame:
    """For each column, its nulls and NaNs."""
    cols = ["timestamp", *PRICES]
    bad = lambda c: F.count_if(F.col(c).isNull() | (F.isnan(c) if c in PRICES else F.lit(False)))
    wide = candles.agg(*(bad(c).alias(c) for c in cols))
    return wide.unpivot([], cols, "column_name", "nulls")


def require_complete(candles: DataFrame) -> None:
    """Raises with column and count if a column holds nulls."""
    for row in null_counts(candles).where("nulls > 0").collect():  # at most six rows
        raise ValueError(f"{row['column_name']} holds {row['nulls']} nulls")


def bar_duration(candles: DataFrame) -> DataFrame:
    """Mean distance of neighbouring bars, at least 1; a minute where there are fewer than two."""
    n, span = F.count("*"), F.max("timestamp") - F.min("timestamp")
    return candles.groupBy(*KEYS).agg(F.when(n <= 1, F.lit(60_000).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(span / (n - 1)))).alias("bar_ms"))
