"""When events are sent: curves, ramps, days, replay clocks; and readers of what was sent."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.numbers import interpolate


def daily_curve(time: Column, points: list[tuple[float, float]]) -> Column:
    """The factor of a time of day, piecewise linear through (hour, factor) points; constant outside them."""
    t = time.cast("timestamp_ntz")
    hour = F.hour(t) + F.minute(t) / 60 + F.floor(F.second(t)) / 3600
    hours, factors = zip(*sorted(points), strict=True)
    return interpolate(hour, [float(h) for h in hours], [float(f) for f in factors])


def ramp(at: Column, start: float, duration: float, low: float, high: float) -> Column:
    """low until start, high from start + duration on, linear between."""
    return interpolate(at, [float(start), float(start + duration)], [float(low), float(high)])


def day_schedule(df: DataFrame, order: str, day_events: int, day_seconds: float) -> DataFrame:
    """df with day and due_seconds: so many events in each day of so many seconds, evenly, in the order of a column from 0."""
    n = F.col(order)
    return df.withColumn("day", F.floor(n / day_events).cast("long")).withColumn("due_seconds", (n % day_events + F.floor(n / day_events) * day_events) * (day_seconds / day_events))


def replay_times(df: DataFrame, time: str, speed: float) -> DataFrame:
    """df with due_seconds: its own times from the first on, so many times faster."""
    first = df.agg(F.min(F.unix_micros(F.col(time).cast("timestamp"))).alias("_first"))
    return df.crossJoin(F.broadcast(first)).withColumn("due_seconds", (F.unix_micros(F.col(time).cast("timestamp")) - F.col("_first")) / (1e6 * speed)).drop("_first")


def metadata(df: DataFrame, key: str, headers: dict[str, Column], time: str, partition_key: str | None = None) -> DataFrame:
    """key, headers, timestamp, partition_key of each message, as Kafka's sink takes them."""
    made = [F.struct(F.lit(k).alias("key"), v.cast("string").cast("binary").alias("value")) for k, v in headers.items()]
    return df.select(F.col(key).cast("string").alias("key"), F.array(*made).alias("headers"), F.col(time).cast("timestamp").alias("timestamp"), F.col(partition_key or key).cast("string").alias("partition_key"), F.to_json(F.struct(*df.columns)).alias("value"))


def by_partition(df: DataFrame, partition: str, offset: str) -> DataFrame:
    """Per partition of a poll: messages, and the first and last offset."""
    return df.groupBy(partition).agg(F.count("*").alias("messages"), F.min(offset).alias("first"), F.max(offset).alias("last"))


def read_once(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each key's first event by the order; what was sent again is left out."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("_e")).select("_e.*")


def read_events(spark, path: str, schema: str, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Events from JSON lines, without repeats of the keys if those are named; a torn last line is left out."""
    df = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    df = df.where(F.col("_corrupt").isNull()).drop("_corrupt")
    return read_once(df, keys, order or keys[0]) if keys else df


def read_answer_key(spark, path: str) -> DataFrame:
    """kind, table, seq of planted faults, each once."""
    return spark.read.schema("kind string, table string, seq long").json(path).dropDuplicates(["kind", "table", "seq"])


def read_dead_letters(spark, path: str) -> DataFrame:
    """Dead letters (body, error, attempts) with ok: whether the line could be read and says why it failed."""
    df = spark.read.schema("body string, error string, attempts int, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.select("body", "error", "attempts", (F.col("_corrupt").isNull() & F.col("error").isNotNull()).alias("ok"))


def replay_with_failures(run, fail_after: list[int]) -> int:
    """Calls run(n) for each n (it must raise after n batches), then run(None) to the end; how often it was started.

    With a checkpoint, what the sink holds afterwards is what an undisturbed run would have written.
    """
    starts = 0
    for n in [*fail_after, None]:
        starts += 1
        try:
            run(n)
        except Exception:
            if n is None:
                raise
    return starts


class LateRows(StatefulProcessor):
    """Rows with the greatest event time of their key so far, and whether they came later than allowed after it."""

    SCHEMA = "key string, time timestamp, value double, lag_seconds double, late boolean"

    def __init__(self, allowed_seconds: float):
        self.allowed = allowed_seconds

    def init(self, handle) -> None:
        self.state = handle.getValueState("latest", "micros long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        for batch in rows:
            out = []
            for time, value in zip(batch["time"], batch["value"], strict=True):
                now = int(time.value // 1000)
                latest = max(now, self.state.get()[0]) if self.state.exists() else now
                self.state.update((latest,))
                lag = (latest - now) / 1e6
                out.append((str(key[0]), time, float(value), lag, lag > self.allowed))
            yield pd.DataFrame(out, columns=["key", "time", "value", "lag_seconds", "late"])

    def close(self) -> None:
        pass


def late_side_output(df: DataFrame, partition: str, time: str, value: str, allowed_seconds: float) -> DataFrame:
    """A stream of all rows with their lag behind their own partition's latest time, marked late beyond what is allowed.

    Each partition has its own watermark, so a slow one loses nothing to a fast one; route by the mark with `side_output`.
    Needs the RocksDB state store.
    """
    rows = df.select(F.col(partition).cast("string").alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(LateRows(allowed_seconds), LateRows.SCHEMA, "Append", "None")


def progress(query) -> str:
    """The last progress of a running query as JSON text: batch, rows, and rows that the watermark dropped."""
    p = query.lastProgress or {}
    return json.dumps({"batch": p.get("batchId"), "rows": p.get("numInputRows"), "dropped": sum(s.get("numRowsDroppedByWatermark", 0) for s in p.get("stateOperators", []))})
