"""Data quality: rules, gates, slices, scorecards, quarantine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import NUMERIC, finite, ratio

SMALL_SLICE = 30
POOLED = "(small slices)"


@dataclass(frozen=True)
class Rule:
    """A check of one column: not_null, min, max, in, regex, between, unique (window), with its argument."""

    column: str
    kind: str
    value: object = None
    dimension: str = "validity"

    @property
    def name(self) -> str:
        return f"{self.kind}({self.column})"

    def fails(self) -> Column:
        """True for rows that break the rule; null passes all but not_null."""
        c = F.col(self.column)
        bad = {
            "not_null": lambda: c.isNull(),
            "min": lambda: c < F.lit(self.value),
            "max": lambda: c > F.lit(self.value),
            "between": lambda: ~c.between(F.lit(self.value[0]), F.lit(self.value[1])),
            "in": lambda: ~c.isin(list(self.value)),
            "regex": lambda: ~c.rlike(f"^(?:{self.value})$"),
            "unique": lambda: c.isNotNull() & (F.count("*").over(Window.partitionBy(c)) > 1),
        }[self.kind]()
        return F.coalesce(bad, F.lit(False))


def check(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per rule: rule, dimension, rows, failures, rate. Rules over single rows are counted in one pass; unique ones group first."""
    plain = [r for r in rules if r.kind != "unique"]
    aggs = [F.count(F.lit(1)).alias("rows"), *[F.count_if(r.fails()).alias(f"f{k}") for k, r in enumerate(plain)]]
    structs = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.dimension).alias("dimension"), F.col("rows"), F.col(f"f{k}").alias("failures")) for k, r in enumerate(plain)]
    out = df.agg(*aggs).select(F.explode(F.array(*structs)).alias("x")).select("x.*") if plain else None
    for r in rules:
        if r.kind == "unique":
            groups = df.groupBy(r.column).agg(F.count("*").alias("n"))
            row = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col(r.column).isNotNull() & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("failures"))
            row = row.select(F.lit(r.name).alias("rule"), F.lit(r.dimension).alias("dimension"), "rows", "failures")
            out = row if out is None else out.unionByName(row)
    return out.withColumn("rate", F.coalesce(ratio(F.col("failures"), F.col("rows")), F.lit(0.0)))


def flag(df: DataFrame, rules: list[Rule], name: str = "failed") -> DataFrame:
    """df with the names of the rules that each row fails, and whether it fails any."""
    broken = F.array_compact(F.array(*[F.when(r.fails(), F.lit(r.name)) for r in rules]))
    return df.withColumn("failed_rules", broken).withColumn(name, F.size("failed_rules") > 0)


def failing_rows(df: DataFrame, rules: list[Rule], key: str, n: int = 10, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Up to n failing rows in the order of the key, with the hidden columns masked."""
    rows = flag(df, rules).where("failed").orderBy(key).limit(n)
    return rows.select(*[F.when(F.col(c).isNotNull(), F.lit("***")).alias(c) if c in hidden else F.col(c) for c in rows.columns])


def quarantine(df: DataFrame, rules: list[Rule], good: str, bad: str) -> None:
    """Rows that pass go to one folder, the rest with the names of their rules to the other."""
    marked = flag(df, rules)
    marked.where("not failed").drop("failed", "failed_rules").write.mode("overwrite").parquet(good)
    marked.where("failed").drop("failed").write.mode("overwrite").parquet(bad)


def infer_rules(df: DataFrame, levels: int = 12) -> list[Rule]:
    """not_null, min, max and in rules that hold for every row of df, from one aggregation."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggs = [F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in df.columns]
    aggs += [f(finite(F.col(c))).alias(f"{n}_{c}") for c in numeric for n, f in (("lo", F.min), ("hi", F.max))]
    aggs += [F.approx_count_distinct(c).alias(f"d_{c}") for c in text]
    row = df.agg(*aggs).first()
    out = [Rule(c, "not_null", dimension="completeness") for c in df.columns if row[f"n_{c}"] == 0]
    for c in numeric:
        if row[f"lo_{c}"] is not None:
            out += [Rule(c, "min", row[f"lo_{c}"]), Rule(c, "max", row[f"hi_{c}"])]
    for c in text:
        if row[f"d_{c}"] <= levels:
            values = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(4 * levels).collect()]
            out.append(Rule(c, "in", sorted(values)))
    return out


def slices(df: DataFrame, by: list[str], positive: Column | None = None, missing: str | None = None) -> DataFrame:
    """Per slice: slice, rows, share, positive_rate, null_rate. Slices under 30 rows are pooled if there are two or more, else left out."""
    name = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("(null)")) for c in by])
    pos = positive if positive is not None else F.lit(None).cast("boolean")
    miss = F.col(missing).isNull() if missing else F.lit(None).cast("boolean")
    made = df.groupBy(name.alias("slice")).agg(F.count("*").alias("rows"), F.count_if(pos).alias("p"), F.count(pos).alias("known"), F.count_if(miss).alias("m"))
    small = F.col("rows") < SMALL_SLICE
    made = made.withColumn("small", F.count_if(small).over(Window.partitionBy())).where(~small | (F.col("small") > 1))
    pooled = made.groupBy(F.when(small, POOLED).otherwise(F.col("slice")).alias("slice")).agg(*[F.sum(c).alias(c) for c in ("rows", "p", "known", "m")])
    total = F.sum("rows").over(Window.partitionBy())
    return pooled.select("slice", "rows", ratio(F.col("rows"), total).alias("share"), ratio(F.col("p"), F.col("known")).alias("positive_rate"), (ratio(F.col("m"), F.col("rows")) if missing else F.lit(None).cast("double")).alias("null_rate"))


def disparity(sliced: DataFrame) -> DataFrame:
    """Lowest over highest positive rate of the slices that are shown; the four-fifths rule asks for 0.8."""
    row = sliced.where(F.col("slice") != POOLED).agg(F.min("positive_rate").alias("lowest"), F.max("positive_rate").alias("highest"))
    return row.withColumn("ratio", ratio(F.col("lowest"), F.col("highest"))).withColumn("passed", F.col("ratio") >= 0.8)


def scorecard(outcomes: DataFrame) -> DataFrame:
    """Score of each dimension: 100 times the share of passing rows over its rules."""
    return outcomes.groupBy("dimension").agg(F.count("*").alias("rules"), F.avg(100 * (1 - F.col("rate"))).alias("score"))


def slice_gaps(scores: DataFrame) -> DataFrame:
    """Per dimension the best less the worst slice: from (slice, dimension, score)."""
    return scores.groupBy("dimension").agg((F.max("score") - F.min("score")).alias("gap"))


def anomaly_rate(df: DataFrame, flag_col: str, expected: float, tolerance: float) -> DataFrame:
    return df.agg(F.avg(F.col(flag_col).cast("double")).alias("rate")).withColumn("ok", F.abs(F.col("rate") - expected) <= tolerance)


def repair(df: DataFrame, column: str, low: float | None, high: float | None, key: str, seed: int = 42) -> DataFrame:
    """Values outside the bounds are drawn anew within them, by the key's hash; types stay and nulls pass."""
    from .generate import Stream

    c, dtype = F.col(column), dict(df.dtypes)[column]
    broken = F.lit(False)
    broken = broken | (c < low) if low is not None else broken
    broken = broken | (c > high) if high is not None else broken
    u = Stream(seed, "repair", column).uniform(F.col(key))
    if low is not None and high is not None:
        drawn = F.lit(float(low)) + u * (high - low)
    else:
        drawn = F.lit(float(low if low is not None else high))
    return df.withColumn(column, F.when(F.coalesce(broken, F.lit(False)), drawn.cast(dtype)).otherwise(c))


def repair_order(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows in which second comes before first get both swapped."""
    bad = F.coalesce(F.col(second) < F.col(first), F.lit(False))
    return df.withColumns({first: F.when(bad, F.col(second)).otherwise(F.col(first)), second: F.when(bad, F.col(first)).otherwise(F.col(second))})
