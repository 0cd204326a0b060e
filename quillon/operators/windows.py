"""Ordered groups: ranks, versions, gaps, runs, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import microseconds
from ..functions.guards import finite
from .ranges import ranged

#: Groups whose means may be broadcast.
MEANS = 100_000


def group_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with group_rank (from 0), group_size and is_first per group in that order; null is one group."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(*order)) - 1
    return df.withColumn("group_rank", rank).withColumn("group_size", F.count("*").over(w)).withColumn("is_first", F.col("group_rank") == 0)


def next_in_group(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """df with next_<column>: that of the next row of the group."""
    return df.withColumn(f"next_{column}", F.lead(column).over(Window.partitionBy(*keys).orderBy(*order)))


def repeats(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows that repeat an earlier key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n > 1").drop("_n")


def versions(df: DataFrame, key: str, effective: str, gap_days: int = 1) -> DataFrame:
    """Slowly changing rows: end_date (the next effective date less the gap; null for the last), is_current, version from 1.

    A null key has nulls.
    """
    w = Window.partitionBy(key).orderBy(effective)
    following = F.lead(effective).over(w)
    known = F.col(key).isNotNull()
    return df.select("*", F.when(known, F.date_sub(F.to_date(following), gap_days)).alias("end_date"), F.when(known, following.isNull()).alias("is_current"), F.when(known, F.row_number().over(w)).alias("version"))


def cap_per_parent(df: DataFrame, fk: str, order: list[str], most: int) -> DataFrame:
    """Child rows beyond the cap of their parent get a null key and are marked over_cap."""
    n = F.row_number().over(Window.partitionBy(fk).orderBy(*order))
    return df.withColumn("over_cap", F.col(fk).isNotNull() & (n > most)).withColumn(fk, F.when(~F.col("over_cap"), F.col(fk)))


def gaps(df: DataFrame, time: str, step: str, by: list[str] | None = None) -> DataFrame:
    """Per series: steps missing between consecutive times, repeated times, and times off the grid of the first one."""
    by, us = by or [], microseconds(step)
    t = df.where(F.col(time).isNotNull()).select(*by, F.unix_micros(F.col(time).cast("timestamp")).alias("t"))
    w = Window.partitionBy(*by)
    d = F.col("t") - F.lag("t").over(w.orderBy("t"))
    rows = t.withColumn("d", d).withColumn("off", F.pmod(F.col("t") - F.min("t").over(w), F.lit(us)) != 0)
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(F.when(F.col("d") > us, F.floor(F.col("d") / us) - F.when(F.col("d") % us == 0, 1).otherwise(0))), F.lit(0)).alias("missing"),
        F.count_if(F.col("d") > us).alias("gaps"), F.count_if(F.col("d") == 0).alias("duplicates"), F.count_if(F.expr("off")).alias("off_grid"),
    )


def stuck_runs(df: DataFrame, value: str, time: str, max_run: int, by: list[str] | None = None) -> DataFrame:
    """Runs of equal values, longer than max_run: by..., value, length, first, last. Null and NaN break a run."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(time)
    v = F.col(value)
    missing = v.isNull() | F.isnan(v.cast("double"))
    changed = missing | ~v.eqNullSafe(F.lag(v).over(w))
    runs = df.select(*by, time, v.alias("value"), missing.alias("_m"), changed.cast("int").alias("_c")).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where("not _m").groupBy(*by, "_run").agg(F.first("value").alias("value"), F.count("*").alias("length"), F.min(time).alias("first"), F.max(time).alias("last")).where(F.col("length") > max_run).drop("_run")


def lag_autocorrelation(df: DataFrame, value: str, time: str, lag: int, by: list[str] | None = None, constant: float = 1.0) -> DataFrame:
    """Sum of products of deviations a lag apart, over the sum of squares, about the mean of all; null if the series is too short."""
    by = by or []
    rows = df.select(*by, F.col(time).alias("t"), finite(F.col(value)).alias("x")).where("x is not null")
    own = [F.col(c).alias(f"_m_{c}") for c in by]
    means = rows.groupBy(*by).agg(F.avg("x").alias("_m")).select(*own, "_m")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_m_{c}"))
    # one row without groups; a long list of groups is joined by a shuffle
    few = not by or means.limit(MEANS + 1).count() <= MEANS
    rows = ranged(rows, [*by, "t"]).join(F.broadcast(means) if few else means, same).withColumn("e", F.col("x") - F.col("_m"))
    w = Window.partitionBy("_p", *by)
    near = rows.select(*by, "_p", "t", "e", F.lag("e", lag).over(w.orderBy("t")).alias("before"), F.row_number().over(w.orderBy("t")).alias("r"), F.count("*").over(w).alias("n"))
    inner = near.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("e") * F.col("before")).alias("p"), F.sum(F.col("e") * F.col("e")).alias("s"))
    # the first rows of a range meet the last ones of the ranges before: the ends of ranges are a series of their own
    ends = near.where((F.col("r") <= lag) | (F.col("r") > F.col("n") - lag))
    across = ends.withColumn("before", F.lag("e", lag).over(Window.partitionBy(*by).orderBy("_p", "r"))).where(F.col("r") <= lag)
    outer = across.groupBy(*by).agg(F.lit(0).cast("long").alias("n"), F.sum(F.col("e") * F.col("before")).alias("p"), F.lit(0.0).alias("s"))
    made = inner.unionByName(outer).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("s").alias("s"))
    if not by:
        made = made.withColumn("n", F.coalesce("n", F.lit(0)))
    return made.select(*by, "n", F.when(F.col("n") > lag, F.when(F.col("s") == 0, constant).otherwise(F.try_divide("p", "s"))).alias("autocorrelation"))


def seasonal_strength(df: DataFrame, value: str, time: str, period: int, by: list[str] | None = None) -> DataFrame:
    """max(0, 1 - var(remainder) / var(detrended)) about a centred moving average of one period."""
    by = by or []
    w = Window.partitionBy(*by).orderBy("t")
    x = df.select(*by, F.col(time).alias("t"), finite(F.col(value)).alias("x")).where("x is not null")
    half = period // 2
    if period % 2:
        trend = F.avg("x").over(w.rowsBetween(-half, half))
    else:
        inner = F.sum("x").over(w.rowsBetween(-half + 1, half - 1))
        trend = (inner + (F.lag("x", half).over(w) + F.lead("x", half).over(w)) / 2) / period
    full = (F.row_number().over(w) > half) & F.lead("x", half).over(w).isNotNull()
    d = x.withColumn("d", F.when(full, F.col("x") - trend)).withColumn("phase", F.row_number().over(w) % period)
    d = d.withColumn("r", F.col("d") - F.avg("d").over(Window.partitionBy(*by, "phase")))
    made = d.groupBy(*by).agg(F.var_pop("r").alias("r"), F.var_pop("d").alias("d"), F.count("d").alias("n"))
    return made.select(*by, "n", F.greatest(F.lit(0.0), 1 - F.try_divide("r", "d")).alias("strength"))


def period_totals(df: DataFrame, time: str, unit: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Count and sum per calendar period."""
    return df.where(F.col(time).isNotNull()).groupBy(*(by or []), F.date_trunc(unit, time).cast("timestamp_ntz").alias("period")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def temporal_evidence(df: DataFrame, time: str, arrival: str) -> DataFrame:
    """count, first, last, out_of_order and median absolute gap, in the order of arrival: one row.

    The lag runs within ranges of the arrival order; each range's last time goes to the next as one row.
    """
    ordered = ranged(df.where(F.col(time).isNotNull()).select(F.col(arrival).alias("a"), F.unix_micros(F.col(time).cast("timestamp")).alias("t")), ["a"], "p")
    ends = ordered.groupBy("p").agg(F.max_by("t", "a").alias("last")).withColumn("before", F.lag("last").over(Window.orderBy("p")))
    w = Window.partitionBy("p").orderBy("a")
    d = ordered.join(F.broadcast(ends.select("p", "before")), "p").withColumn("d", F.col("t") - F.coalesce(F.lag("t").over(w), F.col("before")))
    return d.agg(F.count("*").alias("count"), F.timestamp_micros(F.min("t")).cast("timestamp_ntz").alias("first"), F.timestamp_micros(F.max("t")).cast("timestamp_ntz").alias("last"), F.count_if(F.col("d") < 0).alias("out_of_order"), (F.median(F.abs("d")) / 1e6).alias("median_gap_seconds"))


def holiday_lift(df: DataFrame, date: str, holidays: DataFrame) -> DataFrame:
    """Per holiday: rows on it over the mean of ordinary days (more than three days from any holiday) of its month and weekday."""
    days = df.where(F.col(date).isNotNull()).groupBy(F.to_date(date).alias("day")).agg(F.count("*").alias("n"))
    around = holidays.select(F.explode(F.sequence(F.date_sub("date", 3), F.date_add("date", 3))).alias("day")).distinct()
    ordinary = days.join(around, "day", "left_anti").groupBy(F.month("day").alias("m"), F.weekday("day").alias("w")).agg(F.avg("n").alias("expected"))
    on = holidays.join(days, holidays["date"] == days["day"]).select("name", "n", F.month("day").alias("m"), F.weekday("day").alias("w"))
    made = on.join(ordinary, ["m", "w"]).groupBy("name").agg(F.sum("n").alias("rows"), F.sum("expected").alias("expected"))
    return made.select("name", "rows", "expected", F.try_divide("rows", "expected").alias("lift"))


def survivor(df: DataFrame, keys: list[str], rules: dict[str, str], order: str, priority: dict[str, list] | None = None) -> DataFrame:
    """One row per key with each column's value by its rule; the order column breaks every tie.

    Rules: first, last, most_common, longest, shortest, min, max, most_recent:<time column>, priority.
    """
    made: list[Column] = []
    for c, rule in rules.items():
        v, o = F.col(c), F.col(order)
        kind, _, arg = rule.partition(":")
        keep = v.isNotNull()
        if kind == "first":
            x = F.min_by(F.when(keep, v), F.when(keep, o))
        elif kind == "last":
            x = F.max_by(F.when(keep, v), F.when(keep, o))
        elif kind == "longest":
            x = F.min_by(v, F.when(keep, F.struct(-F.length(v), o)))
        elif kind == "shortest":
            x = F.min_by(v, F.when(keep, F.struct(F.length(v), o)))
        elif kind in ("min", "max"):
            x = getattr(F, kind)(v)
        elif kind == "most_recent":
            x = F.max_by(v, F.when(keep, F.struct(F.col(arg), -o)))
        elif kind == "priority":
            place = F.array_position(F.array(*map(F.lit, (priority or {})[c])), F.col("_source"))
            x = F.min_by(v, F.when(keep, F.struct(F.when(place > 0, place).otherwise(1 << 30), o)))
        elif kind == "most_common":
            continue
        else:
            raise ValueError(f"no such rule: {rule}")
        made.append(x.alias(c))
    out = df.groupBy(*keys).agg(*made) if made else df.select(*keys).distinct()
    for c, rule in rules.items():
        if rule == "most_common":
            counts = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("_n"), F.min(order).alias("_o"))
            top = counts.groupBy(*keys).agg(F.min_by(c, F.struct(-F.col("_n"), F.col("_o"))).alias(c))
            out = out.join(top, keys, "left")
    return out.select(*keys, *rules)


def sessions(df: DataFrame, by: list[str], time: str, gap: str) -> DataFrame:
    """df with session numbers from 1 per key: a pause of at least the gap begins a new one."""
    w = Window.partitionBy(*by).orderBy(time)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    new = F.coalesce((t - F.lag(t).over(w)) >= microseconds(gap), F.lit(True)).cast("int")
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def periodicity(df: DataFrame, value: str, time: str, periods: list[int], by: list[str] | None = None) -> DataFrame:
    """Power of a series at given periods (in steps), over its variance: by..., period, power. Sums of sines, in one aggregation."""
    import math

    by = by or []
    rows = df.select(*by, F.col(time).alias("t"), finite(F.col(value)).alias("x")).where("x is not null")
    w = Window.partitionBy(*by)
    rows = rows.withColumn("e", F.col("x") - F.avg("x").over(w)).withColumn("k", F.row_number().over(w.orderBy("t")) - 1)
    aggs = [F.sum(F.col("e") * F.col("e")).alias("s"), F.count("*").alias("n")]
    for p in periods:
        angle = F.col("k") * (2 * math.pi / p)
        aggs += [F.sum(F.col("e") * F.cos(angle)).alias(f"c{p}"), F.sum(F.col("e") * F.sin(angle)).alias(f"d{p}")]
    power = lambda p: F.coalesce(F.try_divide(2 * (F.col(f"c{p}") ** 2 + F.col(f"d{p}") ** 2), F.col("n") * F.col("s")), F.lit(0.0))
    return rows.groupBy(*by).agg(*aggs).select(*by, F.explode(F.array(*[F.struct(F.lit(p).alias("period"), power(p).alias("power")) for p in periods])).alias("x")).select(*by, "x.*")
