"""Orders over whole tables, taken within ranges of the order's keys: numbers, running totals, exact quantiles.

The ends of the ranges are values drawn once, so every use of them deals a row to the same range. Partitions of a
range exchange don't: two uses draw their own ends, and adaptive plans merge them differently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import finite
from .resolve import written

#: Keys drawn for each range's end, and ranges at most (their ends are compared in one expression).
DRAWN, RANGES = 32, 64


def literal(v: object, kind: T.DataType) -> Column:
    if v is not None and isinstance(kind, T.StructType):
        return F.struct(*[literal(x, f.dataType).alias(f.name) for x, f in zip(v, kind.fields, strict=True)])
    if v is not None and isinstance(kind, T.ArrayType):
        return F.array(*[literal(x, kind.elementType) for x in v]).cast(kind)
    return F.lit(v).cast(kind)


def ranged(df: DataFrame, order: list[str], name: str = "_p") -> DataFrame:
    """df with the number of each row's range in that order; equal keys share a range.

    The keys with the smallest hashes, a fixed number for each range, give the ends; they only balance the
    ranges, any ends give the same results.
    """
    key = F.col(f"`{order[0]}`") if len(order) == 1 else F.struct(*[F.col(f"`{c}`") for c in order])
    n = min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = df.select(key.alias("k"))
    drawn = [r["k"] for r in keys.orderBy(F.xxhash64("k")).limit(DRAWN * n).orderBy("k").collect()]
    kind, ends = keys.schema["k"].dataType, []
    for v in [drawn[i * len(drawn) // n] for i in range(1, n)] if drawn else []:
        if v is not None and (not ends or v != ends[-1]):
            ends.append(v)
    ends = [literal(v, kind) for v in ends]

    def leaf(i: int, j: int) -> Column:
        if i == j:
            return F.lit(i)
        m = (i + j) // 2
        return F.when(F.col("_key") > ends[m], leaf(m + 1, j)).otherwise(leaf(i, m))

    return df.withColumn("_key", key).withColumn(name, leaf(0, len(ends))).drop("_key")


def running(df: DataFrame, order: list[str], totals: list[str], by: list[str] | None = None, each: dict[str, Column] | None = None) -> DataFrame:
    """df with _p (its range), before_<c> (the sum of c over earlier rows of its group) and all_<c> (over all of them).

    each has further columns by range and group, made of _b_<c> (the sum before it), _t_<c> (its own) and all_<c>.

    Rows are distinct by group and order. Sums run within ranges and are shifted by those of the ranges before, one row
    for each range and group. Groups aren't null.
    """
    by = by or []
    rows = ranged(df, [*by, *order])
    every, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_p", *by).agg(*[F.sum(c).alias(c) for c in totals])
    parts = parts.select("_p", *by, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b_{c}") for c in totals], *[F.col(c).alias(f"_t_{c}") for c in totals], *[F.sum(c).over(every).alias(f"all_{c}") for c in totals])
    parts = parts.withColumns(each).drop(*[f"_t_{c}" for c in totals]) if each else parts.drop(*[f"_t_{c}" for c in totals])
    local = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *[(F.sum(c).over(local) - F.col(c)).alias(f"_l_{c}") for c in totals]).join(F.broadcast(parts), ["_p", *by])
    for c in totals:
        out = out.withColumn(f"before_{c}", F.col(f"_l_{c}") + F.col(f"_b_{c}")).drop(f"_l_{c}", f"_b_{c}")
    return out


def dense_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with 1..n in the order of distinct keys.

    Ranges are numbered by themselves and shifted by the counts of those before, one row for each range.
    """
    rows = ranged(df, order)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return ranked.join(F.broadcast(parts), "_p").withColumn(name, F.col("_r") + F.col("_before")).drop("_p", "_r", "_before")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, v, n of the finite values of numeric columns: counted before a shuffle, written once."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), finite(F.col(c)).alias("v")) for c in columns])
    long = df.select(F.explode(cells).alias("x")).select("x.*").where("v is not null")
    return written(long.groupBy("column", "v").agg(F.count("*").alias("n")))


def count_quantiles(counts: DataFrame, grid: list[float]) -> DataFrame:
    """column, q: the exact quantiles, with linear interpolation, of values of which counts are given (column, v, n).

    Running totals over the distinct values say which value has a rank; no task holds all of them.
    """
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), ((F.col("all_n") - 1) * F.lit(float(p))).alias("place")) for k, p in enumerate(grid)])
    meets = lambda first, last: lambda w: (F.ceil(w["place"]) >= first) & (F.floor(w["place"]) <= last)
    # places of a range first, so that a row is held against few
    own = F.filter(wanted, meets(F.col("_b_n"), F.col("_b_n") + F.col("_t_n") - 1))
    at = running(counts, ["v"], ["n"], ["column"], {"_wanted": own}).where(F.size("_wanted") > 0)
    first, last = F.col("before_n"), F.col("before_n") + F.col("n") - 1
    hits = F.filter("_wanted", meets(first, last))
    found = at.select("column", "v", first.alias("first"), last.alias("last"), F.explode(hits).alias("w")).select("column", "v", "first", "last", "w.*")
    has = lambda r: F.when((F.col("first") <= r) & (r <= F.col("last")), F.col("v"))
    ends = found.groupBy("column", "k", "place").agg(F.max(has(F.floor("place"))).alias("lo"), F.max(has(F.ceil("place"))).alias("hi"))
    low = F.floor("place").cast("double")
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((low + 1 - F.col("place")) * F.col("lo") + (F.col("place") - low) * F.col("hi"))
    return ends.select("column", "k", value.alias("q")).groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda x: x["q"]).alias("q"))


def quantiles(df: DataFrame, columns: list[str], grid: list[float]) -> DataFrame:
    """column, q (an array in the order of the grid) for the columns that have finite values."""
    return count_quantiles(value_counts(df, columns), grid)


def one_row(df: DataFrame, column: str, grid: list[float], name: str) -> DataFrame:
    """The quantiles of a column as one row; null without finite values."""
    return quantiles(df, [column], grid).agg(F.first("q").alias(name))
