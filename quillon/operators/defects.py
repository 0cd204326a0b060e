"""Defects planted in tables with an answer key, canary batches that carry them, and invariants of rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .generate import Stream
from .relational import dense_numbers


@dataclass(frozen=True)
class Defect:
    """What to plant: its kind, the column, the rows (a SQL predicate, or a share chosen by the key's hash), and details."""

    kind: str
    column: str = ""
    where: str | None = None
    rate: float = 0.05
    details: dict = field(default_factory=dict)


def chosen(defect: Defect, key: str, seed: int) -> Column:
    if defect.where is not None:
        return F.coalesce(F.expr(defect.where), F.lit(False))
    return Stream(seed, defect.kind, defect.column).uniform(F.col(key)) < defect.rate


def values(defect: Defect, dtype: str) -> Column:
    """The planted value of a row, of the same type, for the kinds that change values in their place."""
    c, d = F.col(f"`{defect.column}`"), defect.details
    made = {
        "inject_nulls": lambda: F.lit(None),
        "orphan_keys": lambda: F.lit(d["base"]) + c if "base" in d else -F.abs(c) - 1,
        "late_arrivals": lambda: c - F.make_dt_interval(secs=F.lit(float(d.get("seconds", 86400)))),
        "scale_values": lambda: c * F.lit(d.get("factor", 100)),
        "shift_hours": lambda: c + F.make_dt_interval(hours=F.lit(d.get("hours", 1))),
        "truncate_strings": lambda: F.substring(c, 1, d.get("length", 3)),
        "placeholder_values": lambda: F.lit(d.get("value", "N/A" if dtype == "string" else -999)),
        "corrupt_encoding": lambda: F.concat(c, F.lit(d.get("mark", "�"))),
    }
    return made[defect.kind]().cast(dtype)


IN_PLACE = ["inject_nulls", "orphan_keys", "late_arrivals", "scale_values", "shift_hours", "truncate_strings", "placeholder_values", "corrupt_encoding"]
OF_SCHEMA = ["rename_column", "drop_column", "retype_column"]
KINDS = [*IN_PLACE, "duplicate_keys", "shuffle_column", *OF_SCHEMA]


def plant(df: DataFrame, defect: Defect, key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """df with the defect, and the answer key: id, column, kind, before. Null values stay null in all kinds but placeholders."""
    c, kind = defect.column, defect.kind
    if kind in IN_PLACE:
        hit = chosen(defect, key, seed)
        out = df.withColumn(c, F.when(hit, values(defect, dict(df.dtypes)[c])).otherwise(F.col(f"`{c}`")))
        told = df.where(hit).select(F.col(key).alias("id"), F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.col(f"`{c}`").cast("string").alias("before"))
        return out, told
    if kind == "duplicate_keys":
        hit = chosen(defect, key, seed)
        return df.unionByName(df.where(hit)), df.where(hit).select(F.col(key).alias("id"), F.lit(key).alias("column"), F.lit(kind).alias("kind"), F.col(key).cast("string").alias("before"))
    if kind == "shuffle_column":
        # the value of rank k by the key goes to the row of rank k in another order
        order = defect.details.get("order")
        rows = df if order else df.withColumn("_h", Stream(seed, kind, c).word(F.col(key)))
        dealt = dense_numbers(rows, [*(order or ["_h"]), key], "_k").drop("_h", c)
        own = dense_numbers(df.select(key, F.col(f"`{c}`").alias("_v")), [key], "_k").select("_k", "_v")
        out = dealt.join(own, "_k").withColumn(c, F.col("_v")).select(*df.columns)
        return out, df.select(F.col(key).alias("id"), F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.col(f"`{c}`").cast("string").alias("before"))
    if kind == "rename_column":
        out = df.withColumnRenamed(c, defect.details.get("to", f"{c}_renamed"))
    elif kind == "drop_column":
        out = df.drop(c)
    elif kind == "retype_column":
        out = df.withColumn(c, F.col(f"`{c}`").cast(defect.details.get("to", "string")))
    else:
        raise ValueError(f"no such defect: {kind}")
    told = df.sparkSession.createDataFrame([(None, c, kind, dict(df.dtypes)[c])], "id string, column string, kind string, before string")
    return out, told


def plant_all(df: DataFrame, defects: list[Defect], key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The defects one after the other, and one answer key of all."""
    answers = None
    for d in defects:
        df, told = plant(df, d, key, seed)
        told = told.withColumn("id", F.col("id").cast("string"))
        answers = told if answers is None else answers.unionByName(told)
    return df, answers


def canary(df: DataFrame, defects: list[Defect], key: str, marker: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A batch that is marked as synthetic (column `_canary`) and carries planted failures, and their answer key."""
    out, answers = plant_all(df, defects, key, seed)
    return out.withColumn("_canary", F.lit(marker)), answers


def canary_caught(answers: DataFrame, caught: DataFrame) -> DataFrame:
    """Per kind and column of the answer key: planted, caught (ids that a check found in that column), missed."""
    found = caught.select(F.col("id").cast("string").alias("id"), "column").distinct().withColumn("_found", F.lit(1))
    both = answers.join(found, ["id", "column"], "left")
    out = both.groupBy("kind", "column").agg(F.count("*").alias("planted"), F.count("_found").alias("caught"))
    return out.withColumn("missed", F.col("planted") - F.col("caught"))


def without_canaries(df: DataFrame, marker: str) -> DataFrame:
    return df.where(~F.col("_canary").eqNullSafe(F.lit(marker))).drop("_canary")


def repeated_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose key an earlier row (by the order) has already; null counts as a value."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n > 1").drop("_n")


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Rows, and a sum of their hashes that doesn't depend on their order."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def same_however_partitioned(make, counts: list[int]) -> bool:
    """Whether make(number of partitions) gives the same rows for each of the numbers."""
    return len({fingerprint(make(n)) for n in counts}) <= 1
