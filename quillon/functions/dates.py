"""Dates: parsing, keys, parts, intervals, window starts."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats that text dates are tried with, in this order.
FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "dd.MM.yyyy", "yyyy/MM/dd", "dd-MMM-yyyy", "yyyyMMdd"]
# Units of durations in microseconds.
UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}


def microseconds(text: str | timedelta) -> int:
    """A duration with its unit, like 500ms or 2w; a number without a unit is refused."""
    if isinstance(text, timedelta):
        return round(text.total_seconds() * 1_000_000)
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(us|ms|s|min|h|d|w)\s*", text)
    if not m:
        raise ValueError(f"not a duration with a unit: {text!r}")
    return round(float(m[1]) * UNITS[m[2]])


def interval(text: str | timedelta) -> str:
    """The same as Spark reads it."""
    return f"{microseconds(text)} microseconds"


def parse(c: Column, formats: list[str] = FORMATS) -> Column:
    """A timestamp by the first format that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def date_key(c: Column) -> Column:
    """yyyymmdd as an integer; ISO text works too."""
    d = F.to_date(c)
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def window_start(c: Column, size: str) -> Column:
    """The start of the window of that size, from the epoch, that holds the time; as microseconds."""
    us = F.unix_micros(c.cast("timestamp"))
    n = microseconds(size)
    return us - F.pmod(us, F.lit(n))


def add_days(c: Column, days: Column | int) -> Column:
    """The type of c stays."""
    return c + F.make_dt_interval(days=F.lit(days) if isinstance(days, int) else days)
