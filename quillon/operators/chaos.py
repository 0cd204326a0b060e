"""Planted damage with an answer key: what was changed, where, and what it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .generate import Stream

KINDS = ["null", "out_of_range", "negative", "wrong_type", "encoding", "future", "blank", "case"]


def damaged(c: Column, kind: str, dtype: str) -> Column:
    """The damaged form of a value, of the same type."""
    text = dtype == "string"
    if kind == "null":
        return F.lit(None).cast(dtype)
    if kind == "out_of_range":
        return (c * 1000 + 1_000_000).cast(dtype) if not text else F.repeat(c, 50)
    if kind == "negative":
        return (-F.abs(c) - 1).cast(dtype)
    if kind == "wrong_type":
        return F.lit("not a value").try_cast(dtype) if not text else F.lit("12.5")
    if kind == "encoding":
        return F.concat(c, F.lit("�"))
    if kind == "future":
        return (c + F.make_dt_interval(days=F.lit(36500))).cast(dtype)
    if kind == "blank":
        return F.lit("  ")
    if kind == "case":
        return F.when(F.upper(c) == c, F.lower(c)).otherwise(F.upper(c))
    raise ValueError(f"no such kind: {kind}")


def inject(df: DataFrame, key: str, column: str, kind: str, rate: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """df with a share of a column's values damaged, and the answer key: id, column, kind, before. Chosen by the key's hash."""
    chosen = Stream(seed, kind, column).uniform(F.col(key)) < rate
    dtype = dict(df.dtypes)[column]
    out = df.withColumn(column, F.when(chosen, damaged(F.col(column), kind, dtype)).otherwise(F.col(column)))
    answers = df.where(chosen).select(F.col(key).alias("id"), F.lit(column).alias("column"), F.lit(kind).alias("kind"), F.col(column).cast("string").alias("before"))
    return out, answers


def orphaned(df: DataFrame, key: str, fk: str, rate: float, seed: int = 42) -> DataFrame:
    """A share of foreign keys point nowhere: to the negative of what they were."""
    return df.withColumn(fk, F.when(Stream(seed, "orphan", fk).uniform(F.col(key)) < rate, -F.abs(F.col(fk)) - 1).otherwise(F.col(fk)))


def repeated(df: DataFrame, key: str, rate: float, seed: int = 42) -> DataFrame:
    """A share of rows comes twice."""
    return df.unionByName(df.where(Stream(seed, "repeat", key).uniform(F.col(key)) < rate))


def late(df: DataFrame, key: str, time: str, rate: float, seconds: int, seed: int = 42) -> DataFrame:
    """A share of times is moved back."""
    return df.withColumn(time, F.when(Stream(seed, "late", time).uniform(F.col(key)) < rate, F.col(time) - F.make_dt_interval(secs=F.lit(seconds))).otherwise(F.col(time)))


def schema_damage(df: DataFrame, drop: list[str] = (), rename: dict[str, str] | None = None, retype: dict[str, str] | None = None, reverse: bool = False) -> DataFrame:
    """Columns dropped, renamed, cast (what doesn't fit becomes null), or in reverse order."""
    out = df.drop(*drop)
    for c, t in (retype or {}).items():
        out = out.withColumn(c, F.col(c).try_cast(t))
    for a, b in (rename or {}).items():
        out = out.withColumnRenamed(a, b)
    return out.select(*out.columns[::-1]) if reverse else out


def volume(df: DataFrame, times: int) -> DataFrame:
    """Every row so many times; 0 empties the table."""
    return df.where(F.lit(False)) if times == 0 else df.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_n")).drop("_n")


def damaged_bytes(data: bytes, kind: str, seed: int = 42) -> bytes:
    """A file's bytes with one fault: truncate, bom, garbage, encoding."""
    at = (seed * 2654435761) % max(1, len(data))
    return {"truncate": data[:at], "bom": b"\xef\xbb\xbf" + data, "garbage": data[:at] + bytes(range(128, 160)) + data[at:], "encoding": data.decode("utf-8", "replace").encode("utf-16")}[kind]


def anomalies(df: DataFrame, key: str, time: str, column: str, kind: str, rate: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Spikes, drops, a level shift, a freeze or gaps in a series, over a share of rows, with the answer key."""
    chosen = Stream(seed, "anomaly", column).uniform(F.col(key)) < rate
    c = F.col(column)
    if kind == "gap":
        return df.where(~chosen), df.where(chosen).select(F.col(key).alias("id"), F.lit(kind).alias("kind"))
    if kind == "shift":
        start = df.agg(F.percentile_approx(F.unix_micros(F.col(time).cast("timestamp")), 1 - rate).alias("s"), F.stddev_samp(column).alias("d")).first()
        chosen = F.unix_micros(F.col(time).cast("timestamp")) > (start["s"] or 0)
        value = c + 5 * (start["d"] or 1.0)
    else:
        value = {"spike": c * 10, "drop": c * 0.0, "freeze": F.lit(0.0) + df.agg(F.avg(column)).first()[0]}[kind]
    out = df.withColumn(column, F.when(chosen, value).otherwise(c))
    return out, df.where(chosen).select(F.col(key).alias("id"), F.lit(kind).alias("kind"))
