"""Questions to a table of past runs: run_id, kind, exchange, category, symbol, status, created_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Runs shown without a limit and at most, and the statuses of runs that aren't over.
DEFAULT, MOST = 100, 500
ACTIVE = ("pending", "running")


def signature() -> Column:
    return F.concat_ws(":", "kind", "exchange", "category", F.upper("symbol"))


def recent(runs: DataFrame, kind: str | None = None, statuses: str | None = None, active: bool = False, limit: int | None = None) -> DataFrame:
    """Newest runs first, of a kind and of the statuses in a comma-separated list."""
    if kind is not None:
        runs = runs.where(F.col("kind") == kind)
    if statuses:
        runs = runs.where(F.lower("status").isin([s.strip().lower() for s in statuses.split(",")]))
    if active:
        runs = runs.where(F.col("status").isin(*ACTIVE))
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(min(limit or DEFAULT, MOST))


def summary(runs: DataFrame) -> DataFrame:
    return runs.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ACTIVE), F.count_if(F.col("status").isin(*ACTIVE)).alias("active"))


def duplicates(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests for which a run of the same signature is active."""
    active = runs.where(F.col("status").isin(*ACTIVE)).select(signature().alias("signature")).distinct()
    return requests.withColumn("signature", signature()).join(active, "signature", "left_semi")
