"""Signals over nullable columns: any operand that is null or no number gives null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def _strict(value: Column, *operands: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, (o.isNotNull() for o in operands)), value)


def gt(left: Column, right: Column) -> Column:
    return nan_to_null(left) > nan_to_null(right)


def lt(left: Column, right: Column) -> Column:
    return nan_to_null(left) < nan_to_null(right)


def and_(left: Column, right: Column) -> Column:
    return _strict(left & right, left, right)


def or_(left: Column, right: Column) -> Column:
    return _strict(left | right, left, right)


def crossover(fast: Column, slow: Column, w: WindowSpec) -> Column:
    """True where fast rises above slow: at or under it on the bar before, above it now. The first row is null."""
    fast, slow = nan_to_null(fast), nan_to_null(slow)
    was_fast, was_slow = F.lag(fast).over(w), F.lag(slow).over(w)
    return _strict((was_fast <= was_slow) & (fast > slow), was_fast, was_slow, fast, slow)


def crossunder(fast: Column, slow: Column, w: WindowSpec) -> Column:
    fast, slow = nan_to_null(fast), nan_to_null(slow)
    was_fast, was_slow = F.lag(fast).over(w), F.lag(slow).over(w)
    return _strict((was_fast >= was_slow) & (fast < slow), was_fast, was_slow, fast, slow)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def null_to_nan(value: Column) -> Column:
    return F.coalesce(value, F.lit(float("nan")))
