"""Two samples: stability index, distances between distributions, overlap, fidelity, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import finite, ratio
from ..functions.numbers import chi2_sf
from ..functions.text import PATTERNS
from .profile import numeric_profile
from .ranges import one_row, running
from .resolve import written

# Thresholds of the drift rules.
LIMITS = {
    "row_count_ratio_max": 2.0, "row_count_ratio_min": 0.5, "null_rate": 0.05, "psi": 0.2, "unseen_share": 0.01, "out_of_range_share": 0.01,
    "zero_share": 0.05, "heaping_ratio": 2.0, "tail_alpha_drop": 0.3, "tail_alpha_max": 3.0, "fidelity_overall": 85.0, "fidelity_table": 70.0,
}
#: Change kinds by the class of the version they ask for.
CLASSES = {"column_removed": "breaking", "type_changed": "breaking", "column_added": "additive", "new_categories": "additive", "null_rate_change": "cosmetic", "distribution_shift": "cosmetic", "range_change": "cosmetic", "category_shift": "cosmetic", "row_count_change": "cosmetic"}


def tagged(a: DataFrame, b: DataFrame, column: str, cast: str | None = None) -> DataFrame:
    c = F.col(column).cast(cast) if cast else F.col(column)
    return a.select(c.alias("v"), F.lit(0).alias("side")).unionByName(b.select(c.alias("v"), F.lit(1).alias("side")))


def shares_table(both: DataFrame, bin_: Column) -> DataFrame:
    """bin, n0, n1, all0, all1: one shuffle by bin, counted before it."""
    counts = both.groupBy(bin_.alias("bin")).agg(F.count_if(F.expr("side = 0")).alias("n0"), F.count_if(F.expr("side = 1")).alias("n1"))
    total = Window.partitionBy()
    return counts.withColumn("all0", F.sum("n0").over(total)).withColumn("all1", F.sum("n1").over(total))


def stability(table: DataFrame) -> DataFrame:
    a, e = F.col("n1") / F.col("all1") + 1e-10, F.col("n0") / F.col("all0") + 1e-10
    return table.where("all0 > 0 and all1 > 0").agg(F.coalesce(F.sum((a - e) * F.log(a / e)), F.lit(0.0)).alias("psi"))


def psi_numeric(a: DataFrame, b: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Population stability index over equal-width bins of the joint range; 0 where the range is a point."""
    both = tagged(a, b, column).select(finite(F.col("v")).alias("v"), "side").where("v is not null")
    ends = both.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    wide = both.crossJoin(F.broadcast(ends))
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * bins)).cast("int")).otherwise(0)
    # every bin counts, those that are empty on both sides too, but they add nothing
    return stability(shares_table(wide, bin_))


def psi_categorical(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return stability(shares_table(tagged(a, b, column, "string").where("v is not null"), F.col("v")))


def ks(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """The largest gap between the distribution functions, and the sample sizes.

    Distinct values are counted first; their running totals are taken within ranges of values and shifted by the totals
    of the ranges before.
    """
    both = tagged(a, b, column).select(finite(F.col("v")).alias("v"), "side").where("v is not null")
    counts = both.groupBy("v").agg(F.count_if(F.expr("side = 0")).alias("n0"), F.count_if(F.expr("side = 1")).alias("n1"))
    f = running(written(counts), ["v"], ["n0", "n1"])
    gap = F.abs(F.try_divide(F.col("before_n0") + F.col("n0"), F.col("all_n0")) - F.try_divide(F.col("before_n1") + F.col("n1"), F.col("all_n1")))
    return f.agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"), F.max("all_n0").alias("n_a"), F.max("all_n1").alias("n_b"))


def chi_squared(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Statistic and degrees of freedom of the homogeneity test over the categories of both."""
    t = shares_table(tagged(a, b, column, "string").where("v is not null"), F.col("v"))
    n, N = F.col("n0") + F.col("n1"), F.col("all0") + F.col("all1")
    e0, e1 = n * F.col("all0") / N, n * F.col("all1") / N
    return t.where("all0 > 0 and all1 > 0").agg(F.sum((F.col("n0") - e0) ** 2 / e0 + (F.col("n1") - e1) ** 2 / e1).alias("chi2"), (F.count("*") - 1).alias("df"))


def drift_monitor(a: DataFrame, b: DataFrame, numeric: list[str], categorical: list[str]) -> list[dict]:
    """Per column: PSI, and KS or chi-squared with its p-value; flagged at a PSI of 0.2."""
    out = []
    for c in numeric:
        k, p = ks(a, b, c).first(), psi_numeric(a, b, c).first()["psi"]
        out.append({"column": c, "test": "ks", "statistic": k["ks"], "psi": p, "flagged": p >= LIMITS["psi"]})
    for c in categorical:
        x, p = chi_squared(a, b, c).first(), psi_categorical(a, b, c).first()["psi"]
        out.append({"column": c, "test": "chi2", "statistic": x["chi2"], "p_value": chi2_sf(x["chi2"] or 0.0, x["df"] or 0), "psi": p, "flagged": p >= LIMITS["psi"]})
    return out


def category_overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values of both: in_a, in_b, shared, jaccard."""
    both = tagged(a, b, column).where("v is not null").groupBy("v").agg(F.max(1 - F.col("side")).alias("a"), F.max("side").alias("b"))
    row = both.agg(F.sum("a").alias("in_a"), F.sum("b").alias("in_b"), F.count_if(F.expr("a = 1 and b = 1")).alias("shared"), F.count("*").alias("n"))
    return row.select("in_a", "in_b", "shared", F.coalesce(ratio(F.col("shared"), F.col("n")), F.lit(1.0)).alias("jaccard"))


def new_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values of b that a doesn't have."""
    return b.select(column).where(F.col(column).isNotNull()).distinct().join(a.select(column).distinct(), column, "left_anti")


def unseen_share(train: DataFrame, serve: DataFrame, column: str) -> DataFrame:
    """Share of the serving rows whose value training doesn't have."""
    counts = serve.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    known = train.select(column).where(F.col(column).isNotNull()).distinct().withColumn("known", F.lit(True))
    row = counts.join(known, column, "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("unseen"))
    return row.withColumn("share", F.coalesce(ratio(F.col("unseen"), F.col("rows")), F.lit(0.0)))


def out_of_range_share(train: DataFrame, serve: DataFrame, column: str) -> DataFrame:
    """Share of the serving rows outside the training range."""
    ends = train.agg(F.min(finite(F.col(column))).alias("_lo"), F.max(finite(F.col(column))).alias("_hi"))
    x = finite(F.col(column))
    row = serve.crossJoin(F.broadcast(ends)).agg(F.count(x).alias("rows"), F.count_if((x < F.col("_lo")) | (x > F.col("_hi"))).alias("outside"))
    return row.withColumn("share", F.coalesce(ratio(F.col("outside"), F.col("rows")), F.lit(0.0)))


def skew(train: DataFrame, serve: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Training-serving skew by feature: feature, null_gap, psi, unseen_share, out_of_range_share, flagged."""
    rows = None
    for c in [*numeric, *categorical]:
        nulls = tagged(train, serve, c).agg(F.avg(F.when(F.col("side") == 0, F.col("v").isNull().cast("double"))).alias("a"), F.avg(F.when(F.col("side") == 1, F.col("v").isNull().cast("double"))).alias("b"))
        gap = nulls.select(F.abs(F.col("b") - F.col("a")).alias("null_gap"))
        p = psi_numeric(train, serve, c) if c in numeric else psi_categorical(train, serve, c)
        u = unseen_share(train, serve, c).select(F.col("share").alias("unseen_share")) if c in categorical else gap.select(F.lit(None).cast("double").alias("unseen_share"))
        o = out_of_range_share(train, serve, c).select(F.col("share").alias("out_of_range_share")) if c in numeric else gap.select(F.lit(None).cast("double").alias("out_of_range_share"))
        row = gap.crossJoin(p).crossJoin(u).crossJoin(o).select(F.lit(c).alias("feature"), "*")  # one row each
        rows = row if rows is None else rows.unionByName(row)
    flag = (F.col("null_gap") > LIMITS["null_rate"]) | (F.col("psi") >= LIMITS["psi"]) | (F.coalesce("unseen_share", F.lit(0.0)) > LIMITS["unseen_share"]) | (F.coalesce("out_of_range_share", F.lit(0.0)) > LIMITS["out_of_range_share"])
    return rows.withColumn("flagged", flag)


def total_variation(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Half the summed absolute differences of shares."""
    t = shares_table(tagged(a, b, column, "string").where("v is not null"), F.col("v"))
    return t.where("all0 > 0 and all1 > 0").agg((F.sum(F.abs(F.col("n0") / F.col("all0") - F.col("n1") / F.col("all1"))) / 2).alias("tvd"))


def quantile_gap(a: DataFrame, b: DataFrame, column: str, grid: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """The largest gap between quantiles, over the first sample's range."""
    x = finite(F.col(column))
    both = a.agg((F.max(x) - F.min(x)).alias("span")).crossJoin(one_row(a, column, list(grid), "qa")).crossJoin(one_row(b, column, list(grid), "qb"))
    return both.select(F.try_divide(F.array_max(F.zip_with("qa", "qb", lambda u, v: F.abs(u - v))), F.col("span")).alias("gap"))


def fidelity_numeric(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Points of numeric columns out of 70, scaled to 100: kind, nulls, cardinality, mean, spread, KS."""
    pa, pb = numeric_profile(a, columns, quantiles=False), numeric_profile(b, columns, quantiles=False)
    named = lambda p, s: p.select("column", *[F.col(c).alias(f"{c}_{s}") for c in ("rows", "nulls", "distinct", "mean", "sd")])
    both = named(pa, "a").join(named(pb, "b"), "column")
    gaps = None
    for c in columns:
        k = ks(a, b, c).select(F.lit(c).alias("column"), "ks")
        gaps = k if gaps is None else gaps.unionByName(k)
    near = lambda x, y: F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(F.abs(F.col(y) - F.col(x)), F.abs(F.col(x))), F.when(F.col(y) == F.col(x), 0.0).otherwise(1.0)))
    points = 10 + 10 * (1 - F.abs(F.try_divide(F.col("nulls_a"), F.col("rows_a")) - F.try_divide(F.col("nulls_b"), F.col("rows_b")))) + 10 * near("distinct_a", "distinct_b") + 20 * near("mean_a", "mean_b") + 10 * near("sd_a", "sd_b") + 10 * (1 - F.col("ks"))
    return both.join(gaps, "column").select("column", (points / 70 * 100).alias("score"))


def fidelity_table(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("score").alias("score")).withColumn("passed", F.col("score") >= LIMITS["fidelity_table"])


def dominant_format(a: DataFrame, b: DataFrame, column: str, most: float = 0.1) -> DataFrame:
    """Of the named patterns the one that half of a's values or more match, its rates on both sides, and whether they agree."""
    rates = lambda df, s: df.where(F.col(column).isNotNull()).agg(*[F.avg(F.col(column).rlike(p).cast("double")).alias(f"{n}_{s}") for n, p in PATTERNS.items()])
    row = rates(a, "a").crossJoin(rates(b, "b")).select(F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(f"{n}_a").alias("rate_a"), F.col(f"{n}_b").alias("rate_b")) for n in PATTERNS])).alias("x")).select("x.*")
    return row.where("rate_a >= 0.5").orderBy(F.desc("rate_a"), "pattern").limit(1).withColumn("kept", F.abs(F.col("rate_a") - F.col("rate_b")) <= most)


def ngram_cosine(a: DataFrame, b: DataFrame, column: str, n: int = 3) -> DataFrame:
    """Cosine of the character n-gram counts of two text columns."""
    both = tagged(a, b, column).where(F.length("v") >= n)
    grams = both.select("side", F.explode(F.transform(F.sequence(F.lit(1), F.length("v") - n + 1), lambda i: F.substring(F.col("v"), i, F.lit(n)))).alias("g"))
    t = grams.groupBy("g").agg(F.count_if(F.expr("side = 0")).alias("x"), F.count_if(F.expr("side = 1")).alias("y"))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return t.agg(F.coalesce(F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))), F.lit(0.0)).alias("cosine"))


def schema_changes(a: DataFrame, b: DataFrame) -> list[dict]:
    """Columns removed, added, or of another type; a type that can hold all old values is a widening."""
    wider = {("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("int", "bigint"), ("float", "double"), ("int", "double"), ("date", "timestamp")}
    old, new = dict(a.dtypes), dict(b.dtypes)
    out = [{"column": c, "kind": "column_removed"} for c in old if c not in new]
    out += [{"column": c, "kind": "column_added"} for c in new if c not in old]
    out += [{"column": c, "kind": "type_widened" if (old[c], new[c]) in wider else "type_changed"} for c in old if c in new and old[c] != new[c]]
    return out


def version_bump(kinds: list[str]) -> str:
    """major for a breaking change, minor for an addition, patch for any other, none without changes."""
    classes = {CLASSES.get(k, "cosmetic") for k in kinds}
    return "major" if "breaking" in classes else "minor" if "additive" in classes else "patch" if classes else "none"


def profile_diff(a: DataFrame, b: DataFrame, key: str = "column") -> DataFrame:
    """Field-wise full outer comparison of two profiles: key, field, a, b, change (added, removed, changed)."""
    fields = [c for c in a.columns if c != key and c in b.columns]
    long = lambda p, s: p.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(s)) for c in fields])).alias("x")).select(key, "x.*")
    both = long(a, "a").withColumn("in_a", F.lit(True)).join(long(b, "b").withColumn("in_b", F.lit(True)), [key, "field"], "full_outer")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(key, "field", "a", "b", change.alias("change")).where("change is not null")
