"""What columns say of one another: contingency, dependencies, associations, conditionals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import finite, pearson
from .ranges import one_row


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of value pairs without nulls: a, b, n."""
    pair = df.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    return pair.groupBy("a", "b").agg(F.count("*").alias("n"))


def associations(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, mutual_information (nats), cramers_v (bias corrected), chi2, u_ab (of a by b), u_ba, v_levels_a, v_levels_b.

    All from the contingency table: its margins are windows over it, so the data are shuffled once.
    """
    cells = contingency(df, a, b)
    n_a, n_b = F.sum("n").over(Window.partitionBy("a")), F.sum("n").over(Window.partitionBy("b"))
    cells = cells.withColumn("na", n_a).withColumn("nb", n_b)
    row = cells.agg(
        F.sum("n").alias("n"),
        F.count_distinct("a").alias("ka"),
        F.count_distinct("b").alias("kb"),
        F.sum(F.col("n") * F.log("n")).alias("nlogn"),
        F.sum(F.col("n") * F.log("na")).alias("nloga"),
        F.sum(F.col("n") * F.log("nb")).alias("nlogb"),
        F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s"),
    )
    n = F.col("n")
    mi = F.greatest(F.lit(0.0), F.log(n) + (F.col("nlogn") - F.col("nloga") - F.col("nlogb")) / n)
    ha, hb = F.log(n) - F.col("nloga") / n, F.log(n) - F.col("nlogb") / n
    chi2 = n * (F.col("s") - 1)
    phi2 = F.greatest(F.lit(0.0), chi2 / n - F.try_divide((F.col("ka") - 1) * (F.col("kb") - 1), n - 1))
    ra = F.col("ka") - F.try_divide((F.col("ka") - 1) ** 2, n - 1)
    rb = F.col("kb") - F.try_divide((F.col("kb") - 1) ** 2, n - 1)
    v = F.coalesce(F.sqrt(F.try_divide(phi2, F.least(ra, rb) - 1)), F.lit(0.0))
    share = lambda h: F.when(h > 1e-12, mi / h).otherwise(0.0)
    return row.where("n > 0").select("n", mi.alias("mutual_information"), F.least(v, F.lit(1.0)).alias("cramers_v"), chi2.alias("chi2"), share(ha).alias("u_ab"), share(hb).alias("u_ba"), F.col("ka").alias("levels_a"), F.col("kb").alias("levels_b"))


def correlation_ratio(df: DataFrame, category: str, value: str) -> DataFrame:
    """Eta: the root of the share of a number's variance that lies between categories; null below three rows."""
    rows = df.select(F.col(category).alias("g"), finite(F.col(value)).alias("x")).where("g is not null and x is not null")
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    row = groups.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between, total = F.col("b") - F.col("s") ** 2 / F.col("n"), F.col("q") - F.col("s") ** 2 / F.col("n")
    return row.where("n > 0").select("n", F.when(F.col("n") >= 3, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(between, total)))).alias("eta"))


def functional_dependency(df: DataFrame, determinants: list[str], dependent: str) -> DataFrame:
    """determinants -> dependent: rows, groups, repeated_groups, violating_groups, confidence, baseline, lift. Null is a value."""
    pairs = df.groupBy(*[F.col(c).alias(f"d{k}") for k, c in enumerate(determinants)], F.col(dependent).alias("y")).agg(F.count("*").alias("n"))
    by = [f"d{k}" for k in range(len(determinants))]
    groups = pairs.groupBy(*by).agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.count("*").alias("kinds"))
    modal = pairs.groupBy("y").agg(F.sum("n").alias("n")).agg(F.max("n").alias("modal"))
    row = groups.agg(F.sum("n").alias("rows"), F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("repeated_groups"), F.count_if(F.col("kinds") > 1).alias("violating_groups"), F.sum("top").alias("top"))
    confidence, baseline = F.try_divide(F.col("top"), F.col("rows")), F.try_divide(F.col("modal"), F.col("rows"))
    both = row.crossJoin(F.broadcast(modal))  # one row each
    return both.select("rows", "groups", "repeated_groups", "violating_groups", confidence.alias("confidence"), baseline.alias("baseline"), F.coalesce(F.try_divide(confidence - baseline, 1 - baseline), F.lit(0.0)).alias("lift"))


def candidate_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whether the columns together are distinct in every row and never null."""
    some_null = None
    for c in columns:
        some_null = F.col(c).isNull() if some_null is None else some_null | F.col(c).isNull()
    groups = df.groupBy(*columns).agg(F.count("*").alias("n"), F.count_if(some_null).alias("nulls"))
    row = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("with_null"))
    return row.withColumn("is_key", (F.col("rows") == F.col("distinct")) & (F.col("with_null") == 0))


def average_ranks(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """df with rank_<column>: the mean of the ranks that equal values share.

    Ranks come from a running total over the distinct values, so a heavy tie is one row.
    """
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(column))
    ranks = counts.select(*by, column, (upto - (F.col("_n") - 1) / 2).alias(f"rank_{column}"))
    return df.join(ranks, [*by, column], "left")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of the average ranks of rows where both are there."""
    rows = df.select(finite(F.col(a)).alias("a"), finite(F.col(b)).alias("b")).where("a is not null and b is not null")
    ranked = average_ranks(average_ranks(rows, "a"), "b")
    return ranked.agg(pearson(F.col("rank_a"), F.col("rank_b")).alias("rho"))


def kendall(df: DataFrame, a: str, b: str, order: str, rows: int = 500) -> DataFrame:
    """Tau-b of a sample of `rows` rows spaced by their order; the sample bounds the pairs."""
    x = df.select(finite(F.col(a)).alias("a"), finite(F.col(b)).alias("b"), F.xxhash64(order).alias("h")).where("a is not null and b is not null").orderBy("h").limit(rows)
    left = x.select(F.col("a").alias("a1"), F.col("b").alias("b1"), F.col("h").alias("h1"))
    pairs = left.join(F.broadcast(x), F.col("h1") < F.col("h"))
    s, ta, tb = F.signum(F.col("a1") - F.col("a")), F.col("a1") == F.col("a"), F.col("b1") == F.col("b")
    row = pairs.agg(F.sum(s * F.signum(F.col("b1") - F.col("b"))).alias("s"), F.count_if(~ta).alias("na"), F.count_if(~tb).alias("nb"))
    return row.select(F.try_divide(F.col("s"), F.sqrt(F.col("na").cast("double") * F.col("nb"))).alias("tau_b"))


def conditional_means(df: DataFrame, category: str, value: str, least: int = 20) -> DataFrame:
    """Mean of a number per category of which so many finite values are there: category, n, mean, sd."""
    x = finite(F.col(value))
    return df.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("category")).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")).where(F.col("n") >= least)


def quantile_codes(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """df with code_<column>: the number of distinct interior quantile edges that are not above the value; -1 where missing."""
    x = finite(F.col(column))
    row = one_row(df, column, [k / bins for k in range(1, bins)], "_edges").select(F.array_distinct("_edges").alias("_edges"))
    code = F.size(F.filter("_edges", lambda e: e <= x))
    return df.crossJoin(F.broadcast(row)).withColumn(f"code_{column}", F.when(x.isNull(), -1).otherwise(code)).drop("_edges")


def normalised_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information over the smaller entropy."""
    row = associations(df, a, b)
    return row.select("n", F.greatest("u_ab", "u_ba").alias("nmi"))


def implies(df: DataFrame, a: str, value, b: str, allowed: list) -> DataFrame:
    """Rows where a has the value: how many, and in how many of them b is not one of those allowed (null isn't)."""
    rows = df.where(F.col(a) == value)
    return rows.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(F.col(b).isin(allowed), F.lit(False))).alias("violations"))


def hashed_contingency(df: DataFrame, a: str, b: str, bins: int = 64) -> DataFrame:
    """A contingency table of fixed size over hashed values, mergeable by adding: i, j, n."""
    code = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(bins)).cast("int")
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(code(a).alias("i"), code(b).alias("j")).agg(F.count("*").alias("n"))


def chow_liu(pairs: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """The spanning tree of largest total mutual information, over the columns' pairs (as many as columns squared)."""
    root = {}

    def find(x: str) -> str:
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    out = []
    for a, b, w in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.append((a, b, w))
    return out


def dependency_tree(df: DataFrame, columns: list[str]) -> list[tuple[str, str, float]]:
    """Chow-Liu tree over categorical columns; each pair's information is one row from Spark."""
    pairs = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            row = associations(df, a, b).first()
            pairs.append((a, b, row["mutual_information"] if row else 0.0))
    return chow_liu(pairs)


def information_bits(nats: Column) -> Column:
    return nats / math.log(2)
