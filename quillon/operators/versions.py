"""Versions of a dataset: statistics over time, drift between versions, layers, parity, consumers, backtests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import finite, ratio

# From what change on a statistic has drifted (relative, but for shares, which are absolute).
DRIFT = {"rows": 0.5, "null_share": 0.05, "distinct": 0.5, "mean": 0.25, "sd": 0.5, "min": 0.5, "max": 0.5}


def statistics(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """by..., column, rows, null_share, mean, sd, min, max of numeric columns, in one pass."""
    x = lambda c: finite(F.col(c))
    made = df.groupBy(*by).agg(F.count("*").alias("_n"), *[F.struct(F.avg(F.col(c).isNull().cast("double")).alias("null_share"), F.avg(x(c)).alias("mean"), F.stddev_samp(x(c)).alias("sd"), F.min(x(c)).alias("min"), F.max(x(c)).alias("max")).alias(f"_{k}") for k, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_n").alias("rows"), F.col(f"_{k}").alias("s")) for k, c in enumerate(columns)])
    return made.select(*by, F.explode(rows).alias("x")).select(*by, "x.column", "x.rows", "x.s.*")


def timelapse(versions: DataFrame, version: str, column: str, statistic: str = "mean") -> DataFrame:
    """One statistic of one column by version: version, value, previous, change, relative. Versions are few, rows many."""
    made = statistics(versions, [column], [version]).select(version, F.col(statistic).alias("value"))
    w = Window.orderBy(version)  # one row a version
    out = made.withColumn("previous", F.lag("value").over(w)).withColumn("change", F.col("value") - F.col("previous"))
    return out.withColumn("relative", F.try_divide(F.col("change"), F.abs("previous")))


def drifted(before: DataFrame, after: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Univariate drift between two `statistics` frames: column, statistic, before, after, change, drifted."""
    limits = DRIFT | (limits or {})
    names = [c for c in before.columns if c in limits and c in after.columns]
    long = lambda p, s: p.select("column", F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias(s)) for c in names])).alias("x")).select("column", "x.*")
    both = long(before, "before").join(long(after, "after"), ["column", "statistic"], "full_outer")
    limit = F.create_map(*[F.lit(v) for pair in limits.items() for v in pair])[F.col("statistic")]
    gap = F.col("after") - F.col("before")
    change = F.when(F.col("statistic") == "null_share", F.abs(gap)).otherwise(F.coalesce(F.try_divide(F.abs(gap), F.abs("before")), F.when(gap == 0, 0.0).otherwise(F.lit(float("inf")))))
    return both.withColumn("change", change).withColumn("drifted", F.coalesce(F.col("change") > limit, F.col("before").isNull() != F.col("after").isNull()))


def joint_drift(before: DataFrame, after: DataFrame, pairs: list[tuple[str, str]], limit: float = 0.1) -> DataFrame:
    """Change of correlation of pairs of numeric columns: a, b, before, after, change, drifted."""
    r = lambda df: df.agg(*[F.corr(finite(F.col(a)), finite(F.col(b))).alias(f"{k}") for k, (a, b) in enumerate(pairs)])
    names = [f"_{s}{k}" for s in "xy" for k in range(len(pairs))]
    both = r(before).toDF(*names[: len(pairs)]).crossJoin(r(after).toDF(*names[len(pairs) :]))  # one row each
    told = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_x{k}").alias("before"), F.col(f"_y{k}").alias("after")) for k, (a, b) in enumerate(pairs)]
    out = both.select(F.explode(F.array(*told)).alias("x")).select("x.*").withColumn("change", F.abs(F.col("after") - F.col("before")))
    return out.withColumn("drifted", F.coalesce(F.col("change") > limit, F.lit(True)))


def first_changed_layer(layers: list[tuple[str, Callable[[], DataFrame], Callable[[], DataFrame]]], column: str, limits: dict[str, float] | None = None) -> str | None:
    """The first layer of a pipeline, in its order, whose column drifted between the good and the bad date; None if none did."""
    for name, good, bad in layers:
        if not drifted(statistics(good(), [column]), statistics(bad(), [column]), limits).where("drifted").isEmpty():
            return name
    return None


def parity(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """Whether two environments hold the same table: rows and columns on each side, keys on one side only, differing rows."""
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    side = lambda df, s: df.groupBy(*keys).agg(F.count("*").alias(f"_n{s}"), F.sum(F.xxhash64(*[F.col(c).cast("string") for c in shared]).cast("decimal(38,0)")).alias(f"_h{s}"))
    both = side(a, "a").join(side(b, "b"), keys, "full_outer")
    row = both.agg(F.coalesce(F.sum("_na"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("_nb"), F.lit(0)).alias("rows_b"), F.count_if(F.col("_nb").isNull()).alias("only_a"), F.count_if(F.col("_na").isNull()).alias("only_b"), F.count_if((F.col("_ha") != F.col("_hb")) | (F.col("_na") != F.col("_nb"))).alias("different"))
    bad = F.col("only_a") + F.col("only_b") + F.col("different")
    return row.withColumn("columns_only_a", F.lit(len(set(a.columns) - set(b.columns)))).withColumn("columns_only_b", F.lit(len(set(b.columns) - set(a.columns)))).withColumn("ok", (bad <= tolerance * F.greatest("rows_a", "rows_b")) & (F.col("columns_only_a") + F.col("columns_only_b") == 0))


@dataclass(frozen=True)
class Consumer:
    """What a consumer needs of a producer's table: columns, and limits on their statistics (statistic, column, least, most)."""

    name: str
    columns: tuple[str, ...]
    limits: tuple[tuple[str, str, float | None, float | None], ...] = ()


def check_consumers(df: DataFrame, consumers: list[Consumer]) -> DataFrame:
    """consumer, need, value, ok: every need of every consumer, from one profile of the producer."""
    asked = sorted({c for x in consumers for _, c, _, _ in x.limits if c in df.columns})
    spark = df.sparkSession
    out = spark.createDataFrame([(x.name, f"column({c})", None, c in df.columns) for x in consumers for c in x.columns], "consumer string, need string, value double, ok boolean")
    needs = [(x.name, s, c, lo, hi) for x in consumers for s, c, lo, hi in x.limits if c in df.columns]
    if needs:
        limits = spark.createDataFrame(needs, "consumer string, statistic string, column string, least double, most double")
        long = statistics(df, asked)
        long = long.select("column", F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("value")) for s in ("rows", "null_share", "mean", "sd", "min", "max")])).alias("x")).select("column", "x.*")
        ok = F.coalesce(F.col("value") >= F.col("least"), F.col("least").isNull()) & F.coalesce(F.col("value") <= F.col("most"), F.col("most").isNull())
        judged = limits.join(long, ["column", "statistic"]).select("consumer", F.concat("statistic", F.lit("("), "column", F.lit(")")).alias("need"), "value", (ok & F.col("value").isNotNull()).alias("ok"))
        out = out.unionByName(judged)
    return out


def backtest(history: DataFrame, version: str, rule: Column, incidents: DataFrame) -> DataFrame:
    """A row rule replayed over all versions against known incidents: version, rows, failures, alarm, incident, verdict.

    incidents has the versions in which something was wrong. Verdicts: hit, miss, false_alarm, quiet.
    """
    made = history.groupBy(version).agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(rule, F.lit(True))).alias("failures"))
    known = incidents.select(version).distinct().withColumn("_incident", F.lit(True))
    out = made.join(known, version, "left").withColumn("alarm", F.col("failures") > 0).withColumn("incident", F.coalesce("_incident", F.lit(False))).drop("_incident")
    verdict = F.when(F.col("alarm") & F.col("incident"), "hit").when(F.col("incident"), "miss").when(F.col("alarm"), "false_alarm").otherwise("quiet")
    return out.withColumn("verdict", verdict)


def scorecard_trend(outcomes: DataFrame, version: str) -> DataFrame:
    """From (version, dimension, rows, failures): version, dimension, score, change since the version before."""
    made = outcomes.groupBy(version, "dimension").agg((100 * (1 - ratio(F.sum("failures"), F.sum("rows")))).alias("score"))
    return made.withColumn("change", F.col("score") - F.lag("score").over(Window.partitionBy("dimension").orderBy(version)))


def gap_trend(current: DataFrame, previous: DataFrame) -> DataFrame:
    """From two (dimension, gap) frames: dimension, gap, previous, change."""
    return current.join(previous.select("dimension", F.col("gap").alias("previous")), "dimension", "left").withColumn("change", F.col("gap") - F.col("previous"))


def differencing_risk(before: DataFrame, after: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """Groups whose size changed between two releases by fewer than `least` rows, but not by none: what differencing would tell."""
    side = lambda df, s: df.groupBy(*by).agg(F.count("*").alias(s))
    both = side(before, "before").join(side(after, "after"), by, "full_outer").select(*by, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    delta = F.abs(F.col("after") - F.col("before"))
    return both.withColumn("delta", delta).where((delta > 0) & (delta < least))


def tree_similarity(a: list[tuple[str, str, float]], b: list[tuple[str, str, float]]) -> float:
    """Jaccard similarity of the edges of two dependency trees, whichever way they point."""
    x, y = {frozenset(e[:2]) for e in a}, {frozenset(e[:2]) for e in b}
    return len(x & y) / len(x | y) if x | y else 1.0
