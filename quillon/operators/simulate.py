"""Sequences of events per entity: each entity is simulated by itself, from its own stream of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .generate import Stream, pick


def walks(spark: SparkSession, entities: int, states: dict[str, dict[str, float]], start: str, dwell: dict[str, float], most: int = 50, seed: int = 42) -> DataFrame:
    """A state machine: entity, step, state, seconds. A state without successors ends a walk; dwell times are exponential.

    Entities are rows of a range, so they are simulated wherever their partition runs, with the same result.
    """

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for entity in batch["id"]:
                rng, state, at = np.random.default_rng([seed, entity]), start, 0.0
                for step in range(most):
                    rows.append((entity, step, state, round(at, 3)))
                    after = states.get(state)
                    if not after:
                        break
                    at += rng.exponential(dwell.get(state, 1.0))
                    state = str(rng.choice(list(after), p=np.array(list(after.values())) / sum(after.values())))
            yield pd.DataFrame(rows, columns=["entity", "step", "state", "seconds"])

    return spark.range(entities).mapInPandas(simulate, "entity long, step int, state string, seconds double")


def clickstream(spark: SparkSession, users: int, seed: int = 42) -> DataFrame:
    """Visits from the home page to a purchase or an exit."""
    pages = {"home": {"search": 0.5, "product": 0.3, "exit": 0.2}, "search": {"product": 0.7, "exit": 0.3}, "product": {"cart": 0.3, "search": 0.3, "exit": 0.4}, "cart": {"purchase": 0.5, "exit": 0.5}}
    return walks(spark, users, pages, "home", {"home": 10.0, "search": 20.0, "product": 40.0, "cart": 30.0}, seed=seed)


def readings(spark: SparkSession, sensors: int, steps: int, seconds: int = 60, fault_rate: float = 0.01, seed: int = 42) -> DataFrame:
    """Sensors with a daily wave, noise and rare faults: sensor, step, seconds, value, fault. Every value by its address."""
    s = Stream(seed, "readings", "value")
    grid = spark.range(sensors * steps).select(F.floor(F.col("id") / steps).cast("long").alias("sensor"), (F.col("id") % steps).alias("step"), F.col("id").alias("_row"))
    at = F.col("step") * seconds
    fault = s.uniform(F.col("_row"), "fault") < fault_rate
    wave = 20 + 5 * F.sin(2 * np.pi * at / 86400 + F.col("sensor"))
    return grid.select("sensor", "step", at.alias("seconds"), F.when(fault, F.lit(-999.0)).otherwise(wave + 0.5 * s.normal(F.col("_row"))).alias("value"), fault.alias("fault"))


def payments(spark: SparkSession, n: int, accounts: int, fraud_rate: float = 0.005, seed: int = 42) -> DataFrame:
    """Payments with planted fraud: id, account, amount, channel, seconds, fraud."""
    s, row = Stream(seed, "payments", "x"), F.col("id")
    fraud = s.uniform(row, "fraud") < fraud_rate
    return spark.range(n).select("id", F.floor(s.uniform(row, "account") * accounts).cast("long").alias("account"), F.rint(F.exp(3 + 1.1 * s.normal(row, "amount") + F.when(fraud, 2.0).otherwise(0.0)) * 100).alias("cents"), pick(s.uniform(row, "channel"), ["card", "transfer", "cash"], [6, 3, 1]).alias("channel"), F.floor(s.uniform(row, "time") * 86400 * 30).cast("long").alias("seconds"), fraud.alias("fraud"))


def versions(spark: SparkSession, keys: int, most: int = 5, seed: int = 42) -> DataFrame:
    """Full load and later changes: key, version, day, value; each key has one to `most` versions on increasing days."""
    s = Stream(seed, "versions", "x")
    n = (F.floor(s.uniform(F.col("id")) * most) + 1).cast("int")
    rows = spark.range(keys).select(F.col("id").alias("key"), F.explode(F.sequence(F.lit(1), n)).alias("version"))
    gap = F.floor(s.uniform(F.xxhash64("key", "version"), "gap") * 30).cast("int") + 1
    day = (F.col("version") - 1) * 31 + F.when(F.col("version") > 1, gap).otherwise(0)
    return rows.select("key", "version", day.alias("day"), F.round(s.uniform(F.xxhash64("key", "version"), "value") * 100, 2).alias("value"))
