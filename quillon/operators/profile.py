"""Column and table profiles.

Exact mode counts every value; bounded mode keeps sketches of fixed size (HyperLogLog, KLL, approximate top-k) whose
memory doesn't grow with the data. Both are one pass of partial and final aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import NUMERIC, finite, pearson, ratio
from ..functions.text import PATTERNS, skeleton
from .ranges import count_quantiles, one_row
from .resolve import written

GRID = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def columns_of(df: DataFrame, kinds: tuple) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def long_rows(row: DataFrame, structs: dict[str, dict[str, Column]]) -> DataFrame:
    """One row per key of structs from a one-row frame."""
    rows = F.array(*[F.struct(F.lit(name).alias("column"), *[c.alias(k) for k, c in cells.items()]) for name, cells in structs.items()])
    return row.select(F.explode(rows).alias("x")).select("x.*")


def numeric_profile(df: DataFrame, columns: list[str] | None = None, exact: bool = True, quantiles: bool = True) -> DataFrame:
    """Per numeric column: rows, nulls, nans, infinite, zeros, negative, distinct, min, max, mean, sd, p25, p50, p75.

    Moments and quantiles are of finite values; the quantiles interpolate linearly in exact mode, and are null if not asked for.
    """
    columns = columns or columns_of(df, NUMERIC)
    aggs, out = [], {}
    for k, name in enumerate(columns):
        c, x = F.col(name), finite(F.col(name))
        d = c.cast("double")
        quantile = F.lit(None).cast("array<double>") if exact else F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000)
        made = {
            "rows": F.count(F.lit(1)),
            "nulls": F.count_if(c.isNull()),
            "nans": F.count_if(F.isnan(d)),
            "infinite": F.count_if(F.abs(d) == float("inf")),
            "zeros": F.count_if(d == 0),
            "negative": F.count_if(d < 0),
            "distinct": F.lit(None).cast("long") if exact else F.approx_count_distinct(F.when(~F.isnan(d), c), 0.0081),
            "min": F.min(x),
            "max": F.max(x),
            "mean": F.avg(x),
            "sd": F.stddev_samp(x),
            "quantiles": quantile,
        }
        aggs += [v.alias(f"{k}_{n}") for n, v in made.items()]
        cells = {n: F.col(f"{k}_{n}") for n in made if n != "quantiles"}
        out[name] = cells | {p: F.get(F.col(f"{k}_quantiles"), F.lit(i)) for i, p in enumerate(("p25", "p50", "p75"))}
    made = long_rows(df.agg(*aggs), out)
    if not exact:
        return made
    # counted apart, by (column, value): together with the other aggregates every row would be copied for each column.
    # Numbers that a double can't tell apart keep their text
    def told(c: str) -> Column:
        kind = df.schema[c].dataType
        if isinstance(kind, T.DecimalType):
            return F.col(c).cast("string")
        return F.when((F.col(c) > 2**53) | (F.col(c) < -(2**53)), F.col(c).cast("string")) if isinstance(kind, T.LongType) else F.lit(None).cast("string")

    cells = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c).cast("double") + 0.0).alias("v"), told(c).alias("_s")) for c in columns])
    long = df.select(F.explode(cells).alias("x")).select("x.*").where("v is not null and not isnan(v)")
    counts = written(long.groupBy("column", "v", "_s").agg(F.count("*").alias("n")))
    kinds = counts.groupBy("column").agg(F.count("*").alias("_kinds"))
    both = made.join(kinds, "column", "left")
    if quantiles:
        finite_ = counts.where(F.abs("v") < float("inf")).groupBy("column", "v").agg(F.sum("n").alias("n"))
        both = both.join(count_quantiles(finite_, [0.25, 0.5, 0.75]).withColumnRenamed("q", "_q"), "column", "left")
        of = {p: F.get("_q", F.lit(i)).alias(p) for i, p in enumerate(("p25", "p50", "p75"))}
    else:
        of = {}
    return both.select(*[F.coalesce("_kinds", F.lit(0)).alias(c) if c == "distinct" else of.get(c, F.col(c)) for c in made.columns])


def text_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per text column: rows, nulls, empty, blank, distinct, min_length, max_length, mean_length, sd_length."""
    columns = columns or columns_of(df, (T.StringType,))
    aggs, out = [], {}
    for k, name in enumerate(columns):
        c = F.col(name)
        made = {
            "rows": F.count(F.lit(1)),
            "nulls": F.count_if(c.isNull()),
            "empty": F.count_if(c == ""),
            "blank": F.count_if(F.trim(c) == ""),
            "distinct": F.count_distinct(c),
            "min_length": F.min(F.length(c)),
            "max_length": F.max(F.length(c)),
            "mean_length": F.avg(F.length(c)),
            "sd_length": F.stddev_samp(F.length(c)),
        }
        aggs += [v.alias(f"{k}_{n}") for n, v in made.items()]
        out[name] = {n: F.col(f"{k}_{n}") for n in made}
    return long_rows(df.agg(*aggs), out)


def pattern_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column and named pattern: how many values match, and their share of those that aren't null."""
    aggs = [F.count(F.col(c)).alias(f"{k}_n") for k, c in enumerate(columns)]
    aggs += [F.count_if(F.col(c).rlike(p)).alias(f"{k}_{n}") for k, c in enumerate(columns) for n, p in PATTERNS.items()]
    rows = [F.struct(F.lit(c).alias("column"), F.lit(n).alias("pattern"), F.col(f"{k}_{n}").alias("matches"), ratio(F.col(f"{k}_{n}"), F.col(f"{k}_n")).alias("share")) for k, c in enumerate(columns) for n in PATTERNS]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def top_values(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """Per column its n most frequent values (of equally frequent ones the smaller text first): column, rank, value, count."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = long.where("value is not null").groupBy("column", "value").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).select("column", "rank", "value", "count")


def skeletons(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent value skeletons of a text column."""
    return df.where(F.col(column).isNotNull()).groupBy(skeleton(F.col(column)).alias("skeleton")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "skeleton").limit(n)


def temporal_profile(df: DataFrame, column: str) -> DataFrame:
    """Counts by part (hour, weekday with Monday 0, month, year) of a time column: part, value, count."""
    c = F.col(column)
    parts = {"hour": F.hour(c), "weekday": F.weekday(c), "month": F.month(c), "year": F.year(c)}
    long = df.where(c.isNotNull()).select(F.explode(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("value")) for k, v in parts.items()])).alias("x")).select("x.*")
    return long.groupBy("part", "value").agg(F.count("*").alias("count"))


def length_profile(df: DataFrame, column: str) -> DataFrame:
    """Lengths of an array or map column: min, max, mean, sd (population), p50, p95, nulls, empty, null_elements."""
    c = F.col(column)
    n = F.when(c.isNotNull(), F.size(c))
    elements = F.sum(F.size(F.filter(c, lambda x: x.isNull()))) if isinstance(df.schema[column].dataType, T.ArrayType) else F.lit(0)
    return df.agg(F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("sd"), F.count_if(c.isNull()).alias("nulls"), F.count_if(n == 0).alias("empty"), elements.alias("null_elements")).crossJoin(one_row(df.select(n.alias("n")), "n", [0.5, 0.95], "q")).select(
        "min", "max", "mean", "sd", F.get("q", F.lit(0)).alias("p50"), F.get("q", F.lit(1)).alias("p95"), "nulls", "empty", "null_elements"
    )


def nested_children(df: DataFrame, path: str = "", depth: int = 8) -> dict[str, DataFrame]:
    """The flat frames of nested columns by path: struct fields, array elements (path[]), map keys and values."""
    out: dict[str, DataFrame] = {}
    for f in df.schema.fields:
        at, c = f"{path}{f.name}", F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StructType) and depth:
            out |= nested_children(df.where(c.isNotNull()).select(f"`{f.name}`.*"), f"{at}.", depth - 1)
        elif isinstance(f.dataType, T.ArrayType) and depth:
            out |= nested_children(df.select(F.explode(c).alias("element")), f"{at}[].", depth - 1)
        elif isinstance(f.dataType, T.MapType) and depth:
            out |= nested_children(df.select(F.explode(c).alias("key", "value")), f"{at}{{}}.", depth - 1)
        else:
            out[at] = df.select(c.alias("value"))
    return out


def bounded_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mergeable sketches of numeric columns: column, rows, nulls, hll (binary), kll (binary), min, max."""
    aggs, out = [], {}
    for k, name in enumerate(columns):
        c, x = F.col(name), finite(F.col(name))
        aggs += [F.count(F.lit(1)).alias(f"{k}_rows"), F.count_if(c.isNull()).alias(f"{k}_nulls"), F.hll_sketch_agg(F.xxhash64(x), F.lit(14)).alias(f"{k}_hll"), F.expr(f"kll_sketch_agg_double(CASE WHEN NOT isnan(CAST(`{name}` AS DOUBLE)) AND abs(CAST(`{name}` AS DOUBLE)) < double('infinity') THEN CAST(`{name}` AS DOUBLE) END)").alias(f"{k}_kll"), F.min(x).alias(f"{k}_min"), F.max(x).alias(f"{k}_max")]
        out[name] = {n: F.col(f"{k}_{n}") for n in ("rows", "nulls", "hll", "kll", "min", "max")}
    return long_rows(df.agg(*aggs), out)


def merge_profiles(*parts: DataFrame) -> DataFrame:
    """The profile of the union of the parts' tables, from their sketches alone."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_union_agg("hll").alias("hll"), F.expr("kll_merge_agg_double(kll)").alias("kll"), F.min("min").alias("min"), F.max("max").alias("max"))


def read_sketches(profile: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Estimates from sketches: distinct, and the quantiles p25, p50, ..., with the sketches' nominal errors."""
    q = [F.expr(f"kll_sketch_get_quantile_double(kll, {p}D)").alias(f"p{round(100 * p)}") for p in quantiles]
    return profile.select("column", "rows", "nulls", "min", "max", F.hll_sketch_estimate("hll").alias("distinct"), *q, F.lit(1.04 / 2**7).alias("distinct_error"), F.lit(0.0133).alias("rank_error"))


def correlations(df: DataFrame, columns: list[str] | None = None, strongest: int | None = None) -> DataFrame:
    """Pearson of each pair of numeric columns, rounded to 4 places: a, b, r. All pairs come from one aggregation.

    With strongest, each column keeps that many partners of largest absolute value.
    """
    columns = columns or columns_of(df, NUMERIC)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    row = df.agg(*[F.round(pearson(F.col(a), F.col(b)), 4).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    out = row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")
    if strongest is None:
        return out
    both = out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc_nulls_last(F.abs("r")), "b"))).where(F.col("n") <= strongest).drop("n")


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Shannon entropy in bits of the values that aren't null."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    # sum n log n needs no second pass for the total
    return counts.agg(F.coalesce(F.log2(F.sum("n")) - F.try_divide(F.sum(F.col("n") * F.log2("n")), F.sum("n")), F.lit(0.0)).alias("entropy"))


def missing_together(df: DataFrame, a: str, b: str) -> DataFrame:
    """Of two columns' nulls: both, only_a, only_b, neither, and the phi coefficient."""
    x, y = F.col(a).isNull().cast("double"), F.col(b).isNull().cast("double")
    return df.agg(
        F.count_if((x == 1) & (y == 1)).alias("both"), F.count_if((x == 1) & (y == 0)).alias("only_a"), F.count_if((x == 0) & (y == 1)).alias("only_b"), F.count_if((x == 0) & (y == 0)).alias("neither"),
        F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("phi"),
    )


def infer_types(df: DataFrame, columns: list[str], share: float = 1.0) -> DataFrame:
    """The type that text columns could have: column, n, boolean, integer, float, date, datetime (shares), inferred."""
    tests = {
        "boolean": lambda c: F.lower(c).isin("true", "false", "yes", "no", "t", "f", "y", "n"),
        "integer": lambda c: c.rlike(r"^[+-]?\d{1,18}$"),
        "float": lambda c: c.try_cast("double").isNotNull(),
        "date": lambda c: c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull(),
        "datetime": lambda c: c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:") & c.try_cast("timestamp_ntz").isNotNull(),
    }
    aggs, out = [], {}
    for k, name in enumerate(columns):
        c = F.when(F.trim(F.col(name)) != "", F.trim(F.col(name)))
        aggs += [F.count(c).alias(f"{k}_n"), *[F.count_if(t(c)).alias(f"{k}_{n}") for n, t in tests.items()]]
        shares = {n: F.coalesce(ratio(F.col(f"{k}_{n}"), F.col(f"{k}_n")), F.lit(0.0)) for n in tests}
        inferred = None
        for n in tests:
            inferred = F.when(shares[n] >= share, n) if inferred is None else inferred.when(shares[n] >= share, n)
        out[name] = {"n": F.col(f"{k}_n"), **shares, "inferred": inferred.otherwise("string")}
    return long_rows(df.agg(*aggs), out)


def keys_of(df: DataFrame, table: str, patterns: tuple[str, ...] = ("id", "key")) -> DataFrame:
    """Columns that could be the primary key: never null, all distinct, whole numbers or uuids; named ones first."""
    fields = [f for f in df.schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType))]
    aggs, out = [F.count(F.lit(1)).alias("rows")], {}
    for k, f in enumerate(fields):
        c = F.col(f.name)
        uuid = F.count_if(c.rlike(PATTERNS["uuid"])) if isinstance(f.dataType, T.StringType) else F.count(c)
        aggs += [F.count_distinct(c).alias(f"{k}_d"), F.count(c).alias(f"{k}_n"), uuid.alias(f"{k}_k")]
        named = any(f.name.lower().endswith(p) for p in patterns)
        out[f.name] = {"table": F.lit(table), "named": F.lit(named), "is_key": (F.col(f"{k}_d") == F.col("rows")) & (F.col(f"{k}_n") == F.col("rows")) & (F.col(f"{k}_k") == F.col("rows")) & (F.col("rows") > 0)}
    return long_rows(df.agg(*aggs), out).where("is_key").select("table", "column", "named")


def foreign_key(child: DataFrame, column: str, parent: DataFrame, key: str, least: float = 0.9) -> DataFrame:
    """Whether a child column refers to a parent key: distinct, found, share, is_fk."""
    values = child.select(F.col(column).alias("v")).where("v is not null").distinct()
    found = values.join(parent.select(F.col(key).alias("v")).distinct().withColumn("found", F.lit(1)), "v", "left")
    row = found.agg(F.count("*").alias("distinct"), F.count("found").alias("found"))
    return row.select("distinct", "found", F.coalesce(ratio(F.col("found"), F.col("distinct")), F.lit(0.0)).alias("share")).withColumn("is_fk", F.col("share") >= least)


def adequacy(df: DataFrame, columns: list[str]) -> DataFrame:
    """How much a sample of this size can say of each column: n, null_rate, null_rate_se, min_detectable_share, grade."""
    aggs, out = [F.count(F.lit(1)).alias("n")], {}
    for k, c in enumerate(columns):
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"{k}_nulls"))
        rate = F.coalesce(ratio(F.col(f"{k}_nulls"), F.col("n")), F.lit(0.0))
        out[c] = {"n": F.col("n"), "null_rate": rate, "null_rate_se": F.coalesce(F.sqrt(ratio(rate * (1 - rate), F.col("n"))), F.lit(0.0)), "min_detectable_share": 1 - F.pow(F.lit(0.05), F.coalesce(ratio(F.lit(1), F.col("n")), F.lit(1.0))), "grade": F.when(F.col("n") >= 1000, "adequate").when(F.col("n") >= 30, "limited").otherwise("insufficient")}
    return long_rows(df.agg(*aggs), out)
