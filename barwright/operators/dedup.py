"""Keeping one row of a key, merging candle sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str], arrival: str, keep: str = "last") -> DataFrame:
    """The first or last arrival of each key, as a partial aggregate; no group is sorted."""
    if keep not in ("first", "last"):
        raise ValueError(f"keep: {keep!r}")
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(arrival)).alias("_row"))
    return kept.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*df.columns)


def merge(held: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which an incoming row takes the place of a held one."""
    both = held.withColumn("_arrival", F.lit(0)).unionByName(incoming.withColumn("_arrival", F.lit(1)))
    return keep_one(both, keys, "_arrival").drop("_arrival")
