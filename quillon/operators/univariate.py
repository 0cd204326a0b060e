"""The behaviour of single numeric columns: heaping, first digits, tails, zeros, placeholders, fitted laws."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import finite, ratio
from ..functions.numbers import normal_cdf
from .ranges import one_row


def numbers(df: DataFrame, column: str) -> DataFrame:
    return df.select(finite(F.col(column)).alias("x")).where("x is not null")


def heaping(df: DataFrame, column: str) -> DataFrame:
    """Per base 5, 10, 100, 1000: the share of whole values that are its multiples, and that over the share by chance."""
    x = numbers(df, column).where("x = floor(x)")
    row = x.agg(F.count("*").alias("n"), *[F.count_if(F.col("x") % m == 0).alias(f"m{m}") for m in (5, 10, 100, 1000)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("base"), ratio(F.col(f"m{m}"), F.col("n")).alias("share"), (ratio(F.col(f"m{m}"), F.col("n")) * m).alias("excess")) for m in (5, 10, 100, 1000)])).alias("x")).select("x.*")


def benford(df: DataFrame, column: str) -> DataFrame:
    """First digits of positive values: digit, n, share, expected, and the mean absolute deviation over the nine."""
    x = numbers(df, column).where("x > 0")
    digit = F.substring(F.regexp_replace(F.format_string("%.6e", "x"), r"^-", ""), 1, 1).cast("int")
    counts = x.groupBy(digit.alias("digit")).agg(F.count("*").alias("n"))
    digits = df.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("digit"))
    t = digits.join(F.broadcast(counts), "digit", "left").select("digit", F.coalesce("n", F.lit(0)).alias("n"))
    every = Window.partitionBy()
    share = ratio(F.col("n"), F.sum("n").over(every))
    t = t.withColumn("share", share).withColumn("expected", F.log10(1 + 1 / F.col("digit")))
    return t.withColumn("mad", F.avg(F.abs(F.col("share") - F.col("expected"))).over(every))


def hill(df: DataFrame, column: str) -> DataFrame:
    """Tail index of the k = max(10, round(sqrt n)) largest positive values: n, k, alpha."""
    x = numbers(df, column).where("x > 0")
    n = x.count()
    k = max(10, round(math.sqrt(n)))
    top = x.orderBy(F.desc("x")).limit(k + 1)  # takes the largest of each partition first
    least = F.min("x")
    row = top.agg(F.count("*").alias("m"), (F.sum(F.log("x")) - F.log(least)).alias("s"), F.log(least).alias("base"))
    return row.where(F.col("m") == k + 1).select(F.lit(n).cast("long").alias("n"), F.lit(k).alias("k"), F.try_divide(F.lit(float(k)), F.col("s") - k * F.col("base")).alias("alpha"))


def zeros(df: DataFrame, column: str) -> DataFrame:
    """Share of zeros, and whether it exceeds what the Poisson law of the same mean would have."""
    row = numbers(df, column).agg(F.count("*").alias("n"), F.count_if(F.expr("x = 0")).alias("zeros"), F.avg("x").alias("mean"))
    share = ratio(F.col("zeros"), F.col("n"))
    return row.select("n", share.alias("zero_share"), F.when(F.col("mean") > 0, share > F.exp(-F.col("mean"))).otherwise(False).alias("inflated"))


# Texts and numbers that often stand for a missing value.
PLACEHOLDERS = ["", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "unknown", "unk", "tbd", "xxx", "0000", "9999", "99999", "-1", "-999", "1900-01-01", "9999-12-31"]


def placeholders(df: DataFrame, column: str, spike: float = 0.2) -> DataFrame:
    """Values that stand for a missing one: listed ones, and spikes that hold such a share of rows: value, n, share, listed."""
    v = F.lower(F.trim(F.col(column).cast("string")))
    counts = df.where(F.col(column).isNotNull()).groupBy(v.alias("value")).agg(F.count("*").alias("n"))
    t = counts.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy()))).withColumn("listed", F.col("value").isin(PLACEHOLDERS))
    return t.where(F.col("listed") | (F.col("share") >= spike))


def fit(df: DataFrame, column: str) -> DataFrame:
    """Normal, uniform, exponential and lognormal laws with the data's moments: family, a, b, ks, smallest first.

    The distance is taken over exact percentiles of the data.
    """
    x = numbers(df, column)
    grid = [k / 100 for k in range(1, 100)]
    positive = F.when(F.col("x") > 0, F.log("x"))
    row = x.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg(positive).alias("lm"), F.stddev_pop(positive).alias("ls")).crossJoin(F.broadcast(one_row(x, "x", grid, "q")))
    cells = row.select("*", F.posexplode("q").alias("k", "v")).withColumn("p", (F.col("k") + 1) / 100.0)
    z = lambda v, m, s: F.try_divide(v - m, s)
    laws = {
        "normal": ("m", "s", normal_cdf(z(F.col("v"), F.col("m"), F.col("s")))),
        "uniform": ("lo", "hi", F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo"))),
        "exponential": ("lo", "m", F.when(F.col("m") > F.col("lo"), 1 - F.exp(-F.try_divide(F.col("v") - F.col("lo"), F.col("m") - F.col("lo"))))),
        "lognormal": ("lm", "ls", F.when(F.col("v") > 0, normal_cdf(z(F.log(F.when(F.col("v") > 0, F.col("v"))), F.col("lm"), F.col("ls")))).otherwise(0.0)),
    }
    one = cells.select(F.explode(F.array(*[F.struct(F.lit(n).alias("family"), F.col(a).alias("a"), F.col(b).alias("b"), F.abs(cdf - F.col("p")).alias("d")) for n, (a, b, cdf) in laws.items()])).alias("x")).select("x.*")
    return one.groupBy("family").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.max("d").alias("ks")).orderBy("ks", "family")


def outliers_iqr(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Values beyond the quartiles by more than that many interquartile ranges: n, outliers, low, high."""
    x = numbers(df, column)
    q = one_row(x, "x", [0.25, 0.75], "q").select((F.get("q", F.lit(0)) - factor * (F.get("q", F.lit(1)) - F.get("q", F.lit(0)))).alias("low"), (F.get("q", F.lit(1)) + factor * (F.get("q", F.lit(1)) - F.get("q", F.lit(0)))).alias("high"))
    return x.crossJoin(F.broadcast(q)).agg(F.count("*").alias("n"), F.count_if(F.expr("x < low or x > high")).alias("outliers"), F.first("low").alias("low"), F.first("high").alias("high"))


def geo_grid(df: DataFrame, lat: str, lon: str, degrees: float) -> DataFrame:
    """Counts of rows in cells of that many degrees."""
    cell = lambda c: F.floor(F.col(c) / degrees).cast("long")
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(cell(lat).alias("cell_lat"), cell(lon).alias("cell_lon")).agg(F.count("*").alias("n"))
