"""Privacy: group sizes, suppression, noise, masking."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import ratio
from ..functions.text import PATTERNS


def groups(df: DataFrame, quasi: list[str]) -> DataFrame:
    return df.groupBy(*quasi).agg(F.count("*").alias("n"))


def k_anonymity(df: DataFrame, quasi: list[str]) -> DataFrame:
    """k (the smallest group), groups, singletons, rows_below_5, risk (the share of rows that are alone). Null is a value."""
    n = F.col("n")
    return groups(df, quasi).agg(F.min("n").alias("k"), F.count("*").alias("groups"), F.count_if(n == 1).alias("singletons"), F.coalesce(F.sum(F.when(n < 5, n)), F.lit(0)).alias("rows_below_5"), F.coalesce(ratio(F.count_if(n == 1), F.sum("n")), F.lit(0.0)).alias("risk"))


def l_diversity(df: DataFrame, quasi: list[str], sensitive: str, least: int = 2) -> DataFrame:
    """l (the fewest sensitive values of a group), groups, violating (groups with fewer than least). Null is a value."""
    kinds = df.groupBy(*quasi, sensitive).agg(F.lit(1).alias("one")).groupBy(*quasi).agg(F.count("*").alias("l"))
    return kinds.agg(F.min("l").alias("l"), F.count("*").alias("groups"), F.count_if(F.col("l") < least).alias("violating"))


def release_groups(df: DataFrame, quasi: list[str], k: int) -> DataFrame:
    """Groups of k rows or more."""
    return groups(df, quasi).where(F.col("n") >= k)


def suppress(counts: DataFrame, category: str, n: str, k: int, other: str = "other") -> DataFrame:
    """Categories below k go to `other`; while that is below k it takes the smallest survivor too; nothing if that can't be.

    counts has a row per category. Sorted by size, what is folded is always a beginning of the list, so its end follows
    from the running total.
    """
    w = Window.orderBy(n, category)
    t = counts.withColumn("_sum", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_small", F.col(n) < k)
    t = t.withColumn("_before", F.col("_sum") - F.col(n)).withColumn("_any", F.max(F.col("_small").cast("int")).over(Window.partitionBy()))
    fold = (F.col("_any") == 1) & (F.col("_small") | (F.col("_before") < k))
    out = t.groupBy(F.when(fold, F.lit(other)).otherwise(F.col(category)).alias(category)).agg(F.sum(n).alias(n))
    return out.where(F.col(n) >= k)


def key_concentration(df: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    """The share of rows that the most frequent keys (that share of them) have."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    sizes = counts.groupBy("n").agg(F.count("*").alias("keys"))  # as many rows as there are different counts
    w = Window.orderBy(F.desc("n"))
    before = F.sum("keys").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("keys")
    top = F.ceil(F.sum("keys").over(Window.partitionBy()) * share)
    return sizes.withColumn("take", F.greatest(F.lit(0), F.least(F.col("keys"), top - before))).agg(F.try_divide(F.sum(F.col("take") * F.col("n")), F.sum(F.col("keys") * F.col("n"))).alias("share"))


def laplace_noise(c: Column, epsilon: float, sensitivity: float, seed: int, *address: Column, low: float | None = None, high: float | None = None) -> Column:
    """c plus Laplace noise that depends on the seed and the row's address only, within bounds."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *address), F.lit(1 << 53)) + 0.5) / float(1 << 53) - 0.5
    out = c - (sensitivity / epsilon) * F.signum(u) * F.log(1 - 2 * F.abs(u))
    out = F.greatest(out, F.lit(low)) if low is not None else out
    return F.least(out, F.lit(high)) if high is not None else out


def masker(key: bytes, kind: str):
    """A pandas UDF that replaces values by a keyed digest in the same form: identifier, name, email, phone, text."""

    def digest(value: str) -> bytes:
        return hmac.new(key, value.encode(), hashlib.sha256).digest()

    def mask(value: str) -> str:
        d = digest(value)
        if kind == "email":
            return f"u{d.hex()[:12]}@{'example.com' if '@' not in value else hashlib.sha256(key + value.split('@')[1].encode()).hexdigest()[:8] + '.example'}"
        if kind == "phone":
            it = iter(d * 4)
            return "".join(str(next(it) % 10) if ch.isdigit() else ch for ch in value)
        if kind == "name":
            return " ".join(digest(w).hex()[: max(3, min(12, len(w)))].capitalize() for w in value.split())
        if kind == "text":
            it = iter((d * (len(value) // 32 + 1))[: len(value)])
            return "".join(chr(97 + next(it) % 26) if ch.isalpha() else ch for ch in value)
        return d.hex()[:16]

    @F.pandas_udf(T.StringType())
    def masked(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else mask(v))

    return masked


def mask_tables(tables: dict[str, DataFrame], columns: dict[str, dict[str, str]], key: bytes) -> dict[str, DataFrame]:
    """Tables with the named columns masked; equal values become equal ones in every table."""
    out = {}
    for name, df in tables.items():
        for c, kind in columns.get(name, {}).items():
            df = df.withColumn(c, masker(key, kind)(F.col(c).cast("string")))
        out[name] = df
    return out


def detect(df: DataFrame, columns: list[str], least: float = 0.8) -> DataFrame:
    """The label of a text column that most of its values fit: column, label, confidence."""
    kinds = {"email": PATTERNS["email"], "us_ssn": PATTERNS["us_ssn"], "phone": PATTERNS["us_phone"], "ipv4": PATTERNS["ipv4"]}
    row = df.agg(*[F.avg(F.col(c).rlike(p).cast("double")).alias(f"{k}_{n}") for k, c in enumerate(columns) for n, p in kinds.items()])
    found = [F.struct(F.lit(c).alias("column"), F.lit(n).alias("label"), F.col(f"{k}_{n}").alias("confidence")) for k, c in enumerate(columns) for n in kinds]
    return row.select(F.explode(F.array(*found)).alias("x")).select("x.*").where(F.col("confidence") >= least)
