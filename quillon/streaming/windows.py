"""Event-time windows, deduplication, keyed state and monitoring; the same functions work on batch and streaming frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.dates import interval, microseconds


def timed(df: DataFrame, time: str, lateness: str | None = None) -> DataFrame:
    """df with its time as a zoned timestamp, which watermarks need, and a watermark if it streams."""
    out = df.withColumn(time, F.col(time).cast("timestamp"))
    return out.withWatermark(time, interval(lateness)) if lateness and df.isStreaming else out


def statistics(value: str) -> list[Column]:
    v = F.col(value)
    return [F.count("*").alias("rows"), F.count(v).alias("n"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")]


def bounds(df: DataFrame) -> DataFrame:
    """The window's ends as plain columns."""
    ends = [F.col(f"window.{e}").cast("timestamp_ntz").alias(f"window_{e}") for e in ("start", "end")]
    return df.select(*ends, *[c for c in df.columns if c != "window"])


def tumbling(df: DataFrame, time: str, size: str, value: str, by: list[str] = (), lateness: str | None = None, offset: str = "0s") -> DataFrame:
    """Statistics of half-open windows [k size + offset, ...)."""
    w = F.window(time, interval(size), startTime=interval(offset))
    return bounds(timed(df, time, lateness).groupBy(w, *by).agg(*statistics(value)))


def sliding(df: DataFrame, time: str, size: str, slide: str, value: str, by: list[str] = (), lateness: str | None = None) -> DataFrame:
    return bounds(timed(df, time, lateness).groupBy(F.window(time, interval(size), interval(slide)), *by).agg(*statistics(value)))


def session(df: DataFrame, time: str, gap: str, value: str, by: list[str], lateness: str | None = None) -> DataFrame:
    """Sessions of events strictly less than the gap apart; a session ends a gap after its last event.

    Spark joins events exactly a gap apart as well, so its gap is a microsecond less, and its ends a microsecond more.
    """
    w = F.session_window(time, f"{microseconds(gap) - 1} microseconds").alias("window")
    out = bounds(timed(df, time, lateness).groupBy(w, *by).agg(*statistics(value)))
    return out.withColumn("window_end", F.col("window_end") + F.expr("INTERVAL '0.000001' SECOND"))


def whole(df: DataFrame, value: str) -> DataFrame:
    """One window over all, as at the end of a stream."""
    return df.agg(*statistics(value))


def deduplicate(df: DataFrame, keys: list[str], time: str | None = None, ttl: str | None = None) -> DataFrame:
    """The first row of each key; streaming, within the watermark of the ttl. Rows with a null key all stay."""
    known = None
    for k in keys:
        known = F.col(k).isNotNull() if known is None else known & F.col(k).isNotNull()
    if df.isStreaming:
        marked = timed(df, time, ttl or "0s")
        return marked.where(known).dropDuplicatesWithinWatermark(list(keys)).unionByName(marked.where(~known)) if ttl else marked.where(known).dropDuplicates(list(keys))
    if time:
        firsts = df.where(known).groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(time, *[c for c in df.columns if c != time])).alias("r")).select("r.*")
        return firsts.unionByName(df.where(~known))
    return df.where(known).dropDuplicates(list(keys)).unionByName(df.where(~known))


def keyed(df: DataFrame, key: str, value: str, time: str) -> DataFrame:
    """Per key: count, mean, variance, min, max, first, last, distinct (approximate)."""
    v = F.col(value)
    return df.groupBy(key).agg(F.count("*").alias("count"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.min(v).alias("min"), F.max(v).alias("max"), F.min_by(v, time).alias("first"), F.max_by(v, time).alias("last"), F.approx_count_distinct(v).alias("distinct"))


class LastValue(StatefulProcessor):
    """One value for each key that lives for a time after it was set; emits the value a newer one replaces."""

    SCHEMA = "key string, value double, previous double"

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("last", "value double", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for batch in rows:
            for value in batch["value"]:
                before = self.state.get()[0] if self.state.exists() else None
                out.append((str(key[0]), float(value), before))
                self.state.update((float(value),))
        yield pd.DataFrame(out, columns=["key", "value", "previous"])

    def close(self) -> None:
        pass


def last_values(df: DataFrame, key: str, value: str, ttl_ms: int = 3_600_000) -> DataFrame:
    """A stream of each key's new and previous values; needs the RocksDB state store."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(LastValue(ttl_ms), LastValue.SCHEMA, "Append", "ProcessingTime")


def decode(df: DataFrame, schema: str, body: str = "value") -> DataFrame:
    """JSON bodies as columns, with status: ok, or undecodable where the body is no JSON of that schema."""
    parsed = F.from_json(F.col(body).cast("string"), f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = df.withColumn("_p", parsed)
    bad = F.col("_p").isNull() | F.col("_p._corrupt").isNotNull()
    names = [part.split()[0] for part in schema.split(",")]
    return out.select(*df.columns, F.when(bad, "undecodable").otherwise("ok").alias("status"), *[F.when(~bad, F.col(f"_p.{n}")).alias(n) for n in names])


def events(tables: dict[str, DataFrame], order: dict[str, str]) -> DataFrame:
    """Rows of several tables as one sequence: table, seq (from 0 in each), key, body (JSON)."""
    from ..operators.relational import dense_numbers

    out = None
    for name, df in tables.items():
        one = dense_numbers(df, [order[name]], "_n").select(F.lit(name).alias("table"), (F.col("_n") - 1).alias("seq"), F.to_json(F.struct(*df.columns)).alias("body"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("key", F.concat_ws("-", "table", F.col("seq").cast("string")))


def cloud_events(df: DataFrame, source: str) -> DataFrame:
    """The same in the envelope of the CloudEvents format."""
    return df.select(F.to_json(F.struct(F.lit("1.0").alias("specversion"), F.col("key").alias("id"), F.lit(source).alias("source"), F.col("table").alias("type"), F.from_json("body", "map<string,string>").alias("data"))).alias("value"))


def faults(df: DataFrame, key: str, body: str, duplicate: float, poison: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Events with duplicates and cut bodies planted by the hash of their key, and the answer key: key, kind."""
    from ..operators.generate import Stream

    twice, cut = Stream(seed, "fault", "duplicate").uniform(F.col(key)) < duplicate, Stream(seed, "fault", "poison").uniform(F.col(key)) < poison
    spoiled = df.withColumn(body, F.when(cut, F.substring(F.col(body), F.lit(1), (F.length(body) / 2).cast("int"))).otherwise(F.col(body)))
    answers = df.where(twice).select(key, F.lit("duplicate").alias("kind")).unionByName(df.where(cut).select(key, F.lit("poison").alias("kind")))
    return spoiled.unionByName(spoiled.where(twice)), answers


def due_times(df: DataFrame, seq: str, rate: float, bursts: list[tuple[float, float, float]] = ()) -> DataFrame:
    """df with due_seconds: when an event is to be sent at a base rate and (start, end, factor) bursts, in the order of seq."""
    knots, t, sent = [(0.0, 0.0, rate)], 0.0, 0.0
    for start, end, factor in sorted(bursts):
        sent += (start - t) * rate
        knots.append((sent, start, rate * factor))
        sent += (end - start) * rate * factor
        t = end
        knots.append((sent, end, rate))
    out = None
    for n, at, r in reversed(knots):
        due = at + (F.col(seq) - n) / r
        out = F.when(F.col(seq) >= n, due) if out is None else out.when(F.col(seq) >= n, due)
    return df.withColumn("due_seconds", out)


def file_stream(df_or_spark, path: str, schema: str, kind: str = "json", files: int = 1) -> DataFrame:
    """Files of a folder as a stream, so many in a batch."""
    return df_or_spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def kafka_stream(spark, servers: str, topic: str) -> DataFrame:
    """A topic as a stream of key, value, partition, offset, timestamp; the connector's jar has to be there."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()


def run(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Processes what is there, batch by batch, and stops; a batch that ran is not run again after a restart."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def monitor(df: DataFrame, reference: DataFrame, numeric: list[str], categorical: list[str], checkpoint: str, found: Callable[[int, list[dict]], None]) -> None:
    """Compares each batch of a stream to a reference, and hands over what drifted."""
    from ..operators.compare import drift_monitor

    run(df, lambda batch, n: found(n, [r for r in drift_monitor(reference, batch, numeric, categorical) if r["flagged"]]), checkpoint)


def side_output(df: DataFrame, good: Column, main: Callable[[DataFrame], None], rest: Callable[[DataFrame], None], checkpoint: str) -> None:
    """Rows of each batch that pass go to one sink, the others to another."""

    def each(batch: DataFrame, n: int) -> None:
        kept = batch.persist()
        main(kept.where(F.coalesce(good, F.lit(False))))
        rest(kept.where(~F.coalesce(good, F.lit(False))))
        kept.unpersist()

    run(df, each, checkpoint)
