"""Samples that depend on keys and seeds alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .generate import Stream
from .relational import dense_numbers


def rows(df: DataFrame, key: str, n: int, how: str = "random", seed: int = 42) -> DataFrame:
    """n rows: random (the least hashes of the key), systematic (evenly spaced in the key's order), or head (the first keys)."""
    if how == "head":
        return df.orderBy(key).limit(n)
    if how == "random":
        return df.withColumn("_h", Stream(seed, "sample", key).word(F.col(key))).orderBy("_h", key).limit(n).drop("_h")
    if how == "systematic":
        total = df.count()
        step = max(1, total // max(1, n))
        return dense_numbers(df, [key], "_i").where(((F.col("_i") - 1) % step == 0) & (F.col("_i") <= step * n)).drop("_i")
    raise ValueError(f"no such sample: {how}")


def share(df: DataFrame, key: str, rate: float, seed: int = 42) -> DataFrame:
    """About that share of keys; rows of one key stay together."""
    return df.where(Stream(seed, "share", key).uniform(F.col(key)) < rate)


def stratified(df: DataFrame, by: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """Up to n rows of each stratum, by the hash of the key."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(Stream(seed, "strata", key).word(F.col(key)), key))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def spread(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """One row of each of n runs of consecutive keys, by the hash of the key."""
    total = max(1, df.count())
    numbered = dense_numbers(df, [key], "_i").withColumn("_t", F.floor((F.col("_i") - 1) * n / total))
    return numbered.groupBy("_t").agg(F.min_by(F.struct(*df.columns), Stream(seed, "spread", key).word(F.col(key))).alias("r")).select("r.*")
