"""Local times that a zone's clock changes skip or repeat."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transitions(zone: str, first: int, last: int) -> list[tuple[datetime, datetime, str]]:
    """(start, end, kind) of the local hours that don't exist or come twice, over years."""
    tz, out = ZoneInfo(zone), []
    hour = datetime(first, 1, 1, tzinfo=UTC)
    while hour.year <= last:
        a, b = hour.astimezone(tz), (hour + timedelta(hours=1)).astimezone(tz)
        shift = b.utcoffset() - a.utcoffset()
        if shift:
            at = b.replace(tzinfo=None)
            out.append((at - shift, at, "nonexistent") if shift > timedelta(0) else (at, at - shift, "repeated"))
        hour += timedelta(hours=1)
    return out


def clock_changes(df: DataFrame, time: str, zone: str, first: int, last: int) -> DataFrame:
    """Rows whose local time is skipped or repeated, with kind: a join with the few changes of those years."""
    spark = df.sparkSession
    known = spark.createDataFrame(transitions(zone, first, last), "_start timestamp_ntz, _end timestamp_ntz, kind string")
    c = F.col(time).cast("timestamp_ntz")
    return df.join(F.broadcast(known), (c >= F.col("_start")) & (c < F.col("_end"))).drop("_start", "_end")
