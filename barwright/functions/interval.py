"""Candle intervals: parsing, printing, buckets and calendar-aware shifts on millisecond times (UTC)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names, after lower-casing, so that "1M" is one minute and months need "mo".
UNITS = {
    "s": ("s", "sec", "second", "seconds"),
    "m": ("m", "min", "minute", "minutes"),
    "h": ("h", "hr", "hour", "hours"),
    "d": ("d", "day", "days"),
    "w": ("w", "wk", "week", "weeks"),
    "mo": ("mo", "month", "months"),
    "y": ("y", "yr", "year", "years"),
}
NAMES = {name: unit for unit, names in UNITS.items() for name in names}
UNIT_MS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
PRINTED = {"s": "s", "m": "min", "h": "h", "d": "d", "w": "w", "mo": "mo", "y": "y"}
#: 1970-01-05, the first Monday.
MONDAY = 345_600_000
#: White space may stand around an interval, not inside; the number is one of 32 bits without a sign.
FORM, MOST = r"^\s*(\d+)([A-Za-z]+)\s*$", (1 << 32) - 1


@dataclass(frozen=True)
class Interval:
    n: int
    unit: str

    @classmethod
    def parse(cls, text: str) -> Interval:
        found = re.match(FORM, text)
        unit = NAMES.get(found[2].lower()) if found else None
        if unit is None or not 1 <= int(found[1]) <= MOST:
            raise ValueError(f"not an interval: {text!r}")
        return cls(int(found[1]), unit)

    def __str__(self) -> str:
        return f"{self.n}{PRINTED[self.unit]}"

    @property
    def ms(self) -> int | None:
        """Length; None for months and years."""
        return self.n * UNIT_MS[self.unit] if self.unit in UNIT_MS else None

    def bucket(self, ts: Column) -> Column:
        """Left end of the bucket that holds ts: aligned to the epoch, weeks to Monday, months to January 1970."""
        if self.unit == "w":
            return ts - F.pmod(ts - MONDAY, F.lit(self.ms))
        if self.ms:
            return ts - F.pmod(ts, F.lit(self.ms))
        day = F.to_date(F.timestamp_millis(ts))
        months = (F.year(day) - 1970) * 12 + F.month(day) - 1
        first = months - F.pmod(months, F.lit(self.n * (12 if self.unit == "y" else 1)))
        start = F.make_date(F.lit(1970) + F.floor(first / 12).cast("int"), F.pmod(first, F.lit(12)) + 1, F.lit(1))
        return F.datediff(start, F.lit("1970-01-01").cast("date")).cast("long") * UNIT_MS["d"]

    def shift(self, ts: Column, bars: Column | int) -> Column:
        """ts moved by so many bars; months and years keep the time of day and clamp to the month's end."""
        count = F.lit(bars) if isinstance(bars, int) else bars
        if self.ms:
            return ts + count * self.ms
        day = F.to_date(F.timestamp_millis(ts))
        moved = F.add_months(day, (count * self.n * (12 if self.unit == "y" else 1)).cast("int"))
        return F.datediff(moved, F.lit("1970-01-01").cast("date")).cast("long") * UNIT_MS["d"] + F.pmod(ts, F.lit(UNIT_MS["d"]))


def parsed(text: Column) -> tuple[Column, Column]:
    """(n, unit) of each row's interval text; both null if it isn't one."""
    number = F.regexp_extract(text, FORM, 1)
    name = F.lower(F.regexp_extract(text, FORM, 2))
    unit = F.lit(None).cast("string")
    for code, names in UNITS.items():
        unit = F.when(name.isin(*names), code).otherwise(unit)
    n = F.when(number != "", number.try_cast("long"))
    good = unit.isNotNull() & n.between(1, MOST)
    return F.when(good, n), F.when(good, unit)


def printed(n: Column, unit: Column) -> Column:
    form = unit
    for code, name in PRINTED.items():
        form = F.when(unit == code, name).otherwise(form)
    return F.concat(n.cast("string"), form)


def floor_minute(ts: Column) -> Column:
    """Truncates toward zero."""
    return ts - ts % 60_000
