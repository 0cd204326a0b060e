"""Mergeable evidence: one small row for each batch, and the merge that gives what the whole data would.

Every `*_batch` makes rows of counters and moments for the batches named by columns (none: one batch); every `merge_*`
combines such rows, in any grouping and order, to the evidence of all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import finite
from ..functions.text import PATTERNS


def numeric_batch(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """count, nulls, n (finite), mean, m2 (sum of squared deviations), minimum, maximum."""
    c, x = F.col(column), finite(F.col(column))
    made = df.groupBy(*by).agg(F.count("*").alias("count"), F.count_if(c.isNull()).alias("nulls"), F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("minimum"), F.max(x).alias("maximum"))
    return made


def merge_numeric(batches: DataFrame, by: list[str] = ()) -> DataFrame:
    """By the parallel formula: the deviations within batches and those of the batches' means."""
    n, mean = F.col("n"), F.col("mean")
    summed = batches.groupBy(*by).agg(F.sum("count").alias("count"), F.sum("nulls").alias("nulls"), F.sum("n").alias("_n"), F.sum(n * mean).alias("_s"), F.sum("m2").alias("_within"), F.collect_list(F.struct("n", "mean")).alias("_parts"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"))
    whole = F.try_divide(F.col("_s"), F.col("_n"))
    between = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + F.coalesce(p["n"] * (p["mean"] - whole) ** 2, F.lit(0.0)))
    return summed.select(*by, "count", "nulls", F.col("_n").alias("n"), whole.alias("mean"), (F.coalesce("_within", F.lit(0.0)) + between).alias("m2"), "minimum", "maximum")


def text_batch(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """count, nulls, empty, shortest, longest, characters."""
    c = F.col(column)
    return df.groupBy(*by).agg(F.count("*").alias("count"), F.count_if(c.isNull()).alias("nulls"), F.count_if(c == "").alias("empty"), F.min(F.length(c)).alias("shortest"), F.max(F.length(c)).alias("longest"), F.sum(F.length(c)).alias("characters"))


def merge_text(batches: DataFrame, by: list[str] = ()) -> DataFrame:
    add = [F.sum(c).alias(c) for c in ("count", "nulls", "empty", "characters")]
    out = batches.groupBy(*by).agg(*add, F.min("shortest").alias("shortest"), F.max("longest").alias("longest"))
    return out.withColumn("mean_length", F.try_divide(F.col("characters"), F.col("count") - F.col("nulls")))


def pattern_batch(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """n (values that are there), and of each named pattern how many it matches; merged by adding."""
    return df.groupBy(*by).agg(F.count(column).alias("n"), *[F.count_if(F.col(column).rlike(p)).alias(k) for k, p in PATTERNS.items()])


def missing_batch(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """both_present, left_missing, right_missing, both_missing; merged by adding."""
    x, y = F.col(a).isNull(), F.col(b).isNull()
    return df.groupBy(*by).agg(F.count_if(~x & ~y).alias("both_present"), F.count_if(x & ~y).alias("left_missing"), F.count_if(~x & y).alias("right_missing"), F.count_if(x & y).alias("both_missing"))


def merge_counts(batches: DataFrame, by: list[str] = ()) -> DataFrame:
    """The sums of all other columns."""
    return batches.groupBy(*by).agg(*[F.sum(c).alias(c) for c in batches.columns if c not in by and dict(batches.dtypes)[c] in ("bigint", "int", "double")])


def covariance_batch(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """n, mx, my, c, m2x, m2y of the rows where both are finite."""
    both = finite(F.col(a)).isNotNull() & finite(F.col(b)).isNotNull()
    x, y = F.when(both, finite(F.col(a))), F.when(both, finite(F.col(b)))
    n = F.count(x)
    return df.groupBy(*by).agg(n.alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.covar_pop(x, y) * n).alias("c"), (F.var_pop(x) * n).alias("m2x"), (F.var_pop(y) * n).alias("m2y"))


def merge_covariance(batches: DataFrame, by: list[str] = ()) -> DataFrame:
    """The merged co-moments, and r, the correlation."""
    summed = batches.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("mx"), (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("my"), *[F.sum(k).alias(f"_{k}") for k in ("c", "m2x", "m2y")], F.collect_list(F.struct("n", F.col("mx").alias("x"), F.col("my").alias("y"))).alias("_parts"))

    def between(u: str, v: str) -> Column:
        means = {"x": F.col("mx"), "y": F.col("my")}
        return F.aggregate("_parts", F.lit(0.0), lambda a, p: a + F.coalesce(p["n"] * (p[u] - means[u]) * (p[v] - means[v]), F.lit(0.0)))

    out = summed.select(*by, "n", "mx", "my", (F.col("_c") + between("x", "y")).alias("c"), (F.col("_m2x") + between("x", "x")).alias("m2x"), (F.col("_m2y") + between("y", "y")).alias("m2y"))
    return out.withColumn("r", F.try_divide(F.col("c"), F.sqrt(F.col("m2x") * F.col("m2y"))))


def relational_batch(child: DataFrame, fk: str, parent: DataFrame, key: str, by: list[str] = ()) -> DataFrame:
    """checked (keys that are there) and orphans; merged by adding. Counted by key before the join, so no key is hot."""
    counts = child.where(F.col(fk).isNotNull()).groupBy(*by, F.col(fk).alias("_k")).agg(F.count("*").alias("_n"))
    known = parent.select(F.col(key).alias("_k")).distinct().withColumn("_known", F.lit(True))
    return counts.join(known, "_k", "left").groupBy(*by).agg(F.sum("_n").alias("checked"), F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("orphans"))


def temporal_batch(df: DataFrame, time: str, by: list[str]) -> DataFrame:
    """Per batch: n, first, last, and of the gaps between neighbours in seconds the mean and the longest."""
    w = Window.partitionBy(*by).orderBy(time)
    t = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    gaps = df.where(F.col(time).isNotNull()).withColumn("_t", t).withColumn("_gap", F.col("_t") - F.lag("_t").over(w))
    return gaps.groupBy(*by).agg(F.count("*").alias("n"), F.min("_t").alias("first"), F.max("_t").alias("last"), F.avg("_gap").alias("mean_gap"), F.max("_gap").alias("longest_gap"))


def space_saving(df: DataFrame, column: str, capacity: int = 64) -> DataFrame:
    """Heavy hitters by a bounded summary in each partition, merged by adding: value, count, error.

    A value's true count lies in [count - error, count]; every value of more than n / capacity rows is among them.
    """
    import pandas as pd

    def summaries(frames):
        held: dict[str, int] = {}
        floor = 0  # what a value that is not held may have had: the counts that were taken from all
        for f in frames:
            for value, n in f["value"].value_counts().items():
                held[value] = held.get(value, 0) + int(n)
                if len(held) > 8 * capacity:
                    floor += trim(held, capacity)
        floor += trim(held, capacity)
        yield pd.DataFrame({"value": [*held, None], "low": [*held.values(), floor]})

    def trim(held: dict[str, int], size: int) -> int:
        """Takes the (size + 1)-th largest count from all, which leaves at most so many; what was taken."""
        if len(held) <= size:
            return 0
        cut = sorted(held.values(), reverse=True)[size]
        for v in [v for v, n in held.items() if n <= cut]:
            del held[v]
        for v in held:
            held[v] -= cut
        return cut

    parts = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).mapInPandas(summaries, "value string, low long")
    error = parts.where("value is null").agg(F.coalesce(F.sum("low"), F.lit(0)).alias("error"))
    merged = parts.where("value is not null").groupBy("value").agg(F.sum("low").alias("low"))
    out = merged.crossJoin(F.broadcast(error)).select("value", (F.col("low") + F.col("error")).alias("count"), "error")  # one row of errors
    return out.orderBy(F.desc("count"), "value").limit(capacity)
