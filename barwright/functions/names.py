"""Exchange, category and interval codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barwright.functions.interval import parsed

# Markets, the exchange's product class of each, and the interval codes it takes.
EXCHANGES = ("bybit",)
CLASSES = {"spot": "spot", "perpetual_linear": "linear", "futures_linear": "linear", "perpetual_inverse": "inverse", "futures_inverse": "inverse", "option": "option"}
MINUTES, HOURS, LONGER = (1, 3, 5, 15, 30), (1, 2, 4, 6, 12), {"d": "D", "w": "W", "mo": "M"}


def exchange(text: Column) -> Column:
    """Trimmed and lower-cased; null if unknown."""
    name = F.lower(F.trim(text))
    return F.when(name.isin(*EXCHANGES), name)


def category(text: Column) -> Column:
    """Exact; null if unknown."""
    return F.when(text.isin(*CLASSES), text)


def _mapped(text: Column, names: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[text]


def product_class(text: Column) -> Column:
    return _mapped(text, CLASSES)


def interval_code(text: Column) -> Column:
    """Null for an interval that the exchange doesn't offer; any number of days, weeks or months has the code of one."""
    n, unit = parsed(text)
    minutes = F.when((unit == "m") & n.isin(*MINUTES), n).when((unit == "h") & n.isin(*HOURS), n * 60)
    return F.coalesce(minutes.cast("string"), _mapped(unit, LONGER))
