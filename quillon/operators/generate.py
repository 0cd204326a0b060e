"""Row-addressed generation: every value depends on (seed, table, column, row) only, never on how rows are partitioned."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import interpolate, normal_quantile

TWO53 = float(1 << 53)


@dataclass(frozen=True)
class Stream:
    """Where a column's random numbers come from."""

    seed: int
    table: str
    column: str

    def word(self, row: Column, label: str = "") -> Column:
        return F.xxhash64(F.lit(self.seed), F.lit(self.table), F.lit(self.column), F.lit(label), row)

    def uniform(self, row: Column, label: str = "") -> Column:
        """In [0, 1), of 53 bits."""
        return F.shiftrightunsigned(self.word(row, label), 11) / TWO53

    def normal(self, row: Column, label: str = "") -> Column:
        """By Box and Muller, of two words."""
        u, v = 1 - self.uniform(row, label + "u"), self.uniform(row, label + "v")
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def pick(u: Column, values: list, weights: list[float] | None = None) -> Column:
    """The value whose part of [0, 1) holds u."""
    weights = weights or [1.0] * len(values)
    total, upto, out = sum(weights), 0.0, None
    for v, w in zip(values[:-1], weights[:-1], strict=True):
        upto += w / total
        out = F.when(u < upto, F.lit(v)) if out is None else out.when(u < upto, F.lit(v))
    return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))


def discrete(u: Column, shares: list[float], first: int = 0) -> Column:
    """The index whose running total first exceeds u, from a literal array by a search in it."""
    upto, ends = 0.0, []
    for s in shares:
        upto += s
        ends.append(upto)
    return F.least(F.lit(len(shares) - 1), F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= u))) + first


def poisson_shares(lam: float) -> list[float]:
    out, p, k = [], math.exp(-lam), 0
    while k <= lam + 12 * math.sqrt(lam) + 20:
        out.append(p)
        k += 1
        p *= lam / k
    return out


def gamma_of(s: Stream, row: Column, alpha: float, scale: float, label: str = "") -> Column:
    """Marsaglia and Tsang's method with eight tries of its own for each row; the last stands."""
    boost = alpha < 1
    d = (alpha + 1 if boost else alpha) - 1 / 3
    c = 1 / math.sqrt(9 * d)
    out = None
    for k in reversed(range(8)):
        x, u = s.normal(row, f"{label}g{k}"), 1 - s.uniform(row, f"{label}h{k}")
        v = (1 + c * x) ** 3
        ok = (v > 0) & (F.log(u) < 0.5 * x * x + d - d * v + d * F.log(F.greatest(v, F.lit(1e-300))))
        out = F.greatest(d * v, F.lit(1e-12)) if out is None else F.when(ok, d * v).otherwise(out)
    return out * scale * (F.pow(1 - s.uniform(row, label + "b"), F.lit(1 / alpha)) if boost else 1.0)


def draw(family: str, source: Stream, row: Column, **p) -> Column:
    """A value of a named law by its inverse distribution where there is one."""
    u = source.uniform(row)
    if family == "normal":
        return p.get("loc", 0.0) + p.get("scale", 1.0) * source.normal(row)
    if family == "uniform":
        return p.get("loc", 0.0) + p.get("scale", 1.0) * u
    if family == "exponential":
        return p.get("loc", 0.0) - p.get("scale", 1.0) * F.log(1 - u)
    if family == "lognormal":
        return p.get("loc", 0.0) + p.get("scale", 1.0) * F.exp(p["s"] * source.normal(row))
    if family == "pareto":
        return p["xm"] * F.pow(1 - u, F.lit(-1 / p["alpha"]))
    if family == "zipf":
        w = [k ** -p["a"] for k in range(1, p["n"] + 1)]
        return discrete(u, [x / sum(w) for x in w], 1)
    if family == "geometric":
        return F.greatest(F.lit(1.0), F.ceil(F.log(1 - u) / math.log(1 - p["p"]))).cast("long")
    if family == "poisson":
        return discrete(u, poisson_shares(p["lam"]))
    if family == "bernoulli":
        return u < p["p"]
    if family == "gamma":
        return gamma_of(source, row, p["k"], p["theta"])
    if family == "beta":
        a, b = gamma_of(source, row, p["a"], 1.0, "a"), gamma_of(source, row, p["b"], 1.0, "b")
        return a / (a + b)
    if family == "weibull":
        return p["lam"] * F.pow(-F.log(1 - u), F.lit(1 / p["k"]))
    if family == "triangular":
        lo, mode, hi = p["low"], p["mode"], p["high"]
        cut = (mode - lo) / (hi - lo)
        return F.when(u < cut, lo + F.sqrt(u * (hi - lo) * (mode - lo))).otherwise(hi - F.sqrt((1 - u) * (hi - lo) * (hi - mode)))
    if family == "negative_binomial":
        shares, q = [], p["p"] ** p["r"]
        for k in range(int(p["r"] * (1 - p["p"]) / p["p"] * 12) + 60):
            shares.append(q)
            q *= (k + p["r"]) / (k + 1) * (1 - p["p"])
        return discrete(u, shares)
    if family == "power_law_cutoff":
        # tries of a power law, accepted by the exponential; the last stands
        out = None
        for k in reversed(range(8)):
            x = p["xmin"] * F.pow(1 - source.uniform(row, f"x{k}"), F.lit(-1 / (p["alpha"] - 1)))
            out = x if out is None else F.when(source.uniform(row, f"y{k}") < F.exp(-p["lam"] * (x - p["xmin"])), x).otherwise(out)
        return out
    if family == "mixture":
        return pick(u, list(range(len(p["parts"]))), p["weights"]).cast("int") if not p["parts"] else F.element_at(F.array(*[draw(f, Stream(source.seed, source.table, f"{source.column}/{k}"), row, **q).cast("double") for k, (f, q) in enumerate(p["parts"])]), pick(u, list(range(1, len(p["parts"]) + 1)), p["weights"]))
    if family == "truncated_normal":
        cdf = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
        a, b = cdf((p["low"] - p["loc"]) / p["scale"]), cdf((p["high"] - p["loc"]) / p["scale"])
        return p["loc"] + p["scale"] * normal_quantile(F.lit(a) + u * (b - a))
    if family == "histogram":
        total, upto, knots = sum(p["weights"]), 0.0, [0.0]
        for w in p["weights"]:
            upto += w / total
            knots.append(upto)
        return interpolate(u, knots, p["edges"])
    if family == "empirical":
        return interpolate(u, p["probabilities"], p["quantiles"])
    raise ValueError(f"no such family: {family}")


@dataclass
class Table:
    """A table to generate: rows, columns by strategy, parents by foreign key."""

    name: str
    rows: int
    columns: dict[str, dict] = field(default_factory=dict)


def column(spark: SparkSession, spec: dict, s: Stream, row: Column, sizes: dict[str, int], tables: dict[str, Table] | None = None) -> Column:
    """The Column of a strategy: constant, sequence, choice, weighted_enum, uniform, distribution, uuid, pattern, string, temporal,
    foreign_key, self_reference, lifecycle, correlated, formula, parent (a column of the row a key points to), record (a field of a
    record drawn by an anchor), hierarchy (level by level), conditional (by another column's value), nested (list, struct, map);
    null_rate may accompany any."""
    kind, u = spec["strategy"], s.uniform(row)
    if kind == "constant":
        out = F.lit(spec["value"])
    elif kind == "sequence":
        out = row * spec.get("step", 1) + spec.get("start", 1)
    elif kind in ("choice", "lifecycle"):
        out = pick(u, spec["values"], spec.get("weights"))
    elif kind == "weighted_enum":
        out = pick(u, list(spec["weights"]), list(spec["weights"].values()))
    elif kind == "uniform":
        out = spec["low"] + u * (spec["high"] - spec["low"])
    elif kind == "distribution":
        out = draw(spec["family"], s, row, **spec.get("params", {}))
    elif kind == "uuid":
        a, b = F.lpad(F.lower(F.hex(s.word(row, "a"))), 16, "0"), F.lpad(F.lower(F.hex(s.word(row, "b"))), 16, "0")
        out = F.concat_ws("-", F.substring(a, 1, 8), F.substring(a, 9, 4), F.concat(F.lit("4"), F.substring(a, 14, 3)), F.concat(F.element_at(F.array(*map(F.lit, "89ab")), (F.pmod(s.word(row, "c"), F.lit(4)) + 1).cast("int")), F.substring(b, 2, 3)), F.substring(b, 5, 12))
    elif kind == "pattern":
        out = F.format_string(spec["format"], *[F.col(c) if c != "row" else row for c in spec["columns"]])
    elif kind == "string":
        letters = spec.get("alphabet", "abcdefghijklmnopqrstuvwxyz")
        out = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(spec["length"])), lambda k: F.substring(F.lit(letters), (F.pmod(F.xxhash64(s.word(row), k), F.lit(len(letters))) + 1).cast("int"), F.lit(1))), "")
    elif kind == "temporal":
        start, end = date.fromisoformat(spec["start"]), date.fromisoformat(spec["end"])
        out = F.lit(start.isoformat()).cast("timestamp_ntz") + F.make_dt_interval(secs=F.floor(u * (end - start).days * 86400).cast("decimal(18,6)"))
    elif kind == "foreign_key":
        n = sizes[spec["parent"]]
        if spec.get("law", "uniform") == "uniform":
            index = F.floor(u * n)
        elif spec["law"] == "zipf":
            # the inverse of the continuous law: exact enough for an index, and free of a table of the parent's size
            a = spec.get("alpha", 1.5)
            index = F.floor(F.pow(1 - u * (1 - float(n + 1) ** (1 - a)), F.lit(1 / (1 - a)))) - 1
        else:
            index = F.floor((F.pow(1 - u, F.lit(-1 / spec.get("alpha", 1.2))) - 1) * n / 5) % n
        out = F.least(index.cast("long"), F.lit(n - 1)) * spec.get("step", 1) + spec.get("start", 1)
    elif kind == "self_reference":
        roots = max(1, sizes[s.table] // 10)
        out = F.when(row >= roots, F.floor(u * F.when(row < roots * 4, roots).otherwise(F.least(row, F.lit(roots * 4)))) + spec.get("start", 1))
    elif kind == "correlated":
        base = F.col(spec["column"])
        out = {"multiply": base * (0.3 + 0.4 * u), "add": base + 10 * u, "subtract": F.greatest(F.lit(0.0), base - 10 * u)}[spec.get("how", "multiply")]
        out = F.rint(out * 100) / 100
    elif kind == "parent":
        # any row's value can be computed where it is needed, so no join
        at, of = (F.col(spec["key"]) - spec.get("start", 1)) / spec.get("step", 1), (tables or {})[spec["parent"]].columns[spec["column"]]
        out = F.when(F.col(spec["key"]).isNotNull(), column(spark, of, Stream(s.seed, spec["parent"], spec["column"]), at.cast("long"), sizes, tables))
    elif kind == "record":
        # fields of one anchor come from the same record
        at = F.floor(Stream(s.seed, s.table, spec["anchor"]).uniform(row) * len(spec["records"])).cast("int")
        out = F.get(F.array(*[F.lit(r[spec["field"]]) for r in spec["records"]]), at)
    elif kind == "hierarchy":
        # {value: (weight, {value: ...})}: the level's value, drawn below the value drawn at the level above
        def below(tree: dict, level: int) -> Column:
            u = Stream(s.seed, s.table, spec["anchor"]).uniform(row, f"level{level}")
            name = pick(u, list(tree), [w for w, _ in tree.values()])
            if level == spec["level"]:
                return name
            out = None
            for value, (_, inner) in tree.items():
                deeper = below(inner, level + 1) if inner else F.lit(None).cast("string")
                out = F.when(name == value, deeper) if out is None else out.when(name == value, deeper)
            return out

        out = below(spec["tree"], 0)
    elif kind == "conditional":
        out = None
        for value, shares in spec["table"].items():
            drawn = pick(u, list(shares), list(shares.values()))
            out = F.when(F.col(spec["column"]) == value, drawn) if out is None else out.when(F.col(spec["column"]) == value, drawn)
    elif kind == "nested":
        inside = lambda name, of, at: column(spark, of, Stream(s.seed, s.table, f"{s.column}.{name}"), at, sizes, tables)
        if spec["kind"] == "struct":
            out = F.struct(*[inside(n, of, row).alias(n) for n, of in spec["fields"].items()])
        else:
            n = F.floor(s.uniform(row, "length") * (spec.get("max", 5) + 1)).cast("int")
            at = F.filter(F.sequence(F.lit(0), F.lit(spec.get("max", 5))), lambda k: k < n)
            values = F.transform(at, lambda k: inside("value", spec["of"], F.xxhash64(row, k)))
            out = values if spec["kind"] == "list" else F.map_from_arrays(F.transform(at, lambda k: F.concat(F.lit("k"), k.cast("string"))), values)
    elif kind == "formula":
        from ..plans.formula import compiled

        out = compiled(spec["expression"])
    else:
        raise ValueError(f"no such strategy: {kind}")
    if rate := spec.get("null_rate", 0):
        out = F.when(s.uniform(row, "null") >= rate, out)
    return out


def generate(spark: SparkSession, tables: list[Table], seed: int = 42, partitions: int | None = None, offset: int = 0) -> dict[str, DataFrame]:
    """Lazy frames of the tables. With an offset, rows begin there: a later batch continues an earlier one."""
    sizes = {t.name: t.rows for t in tables}
    out = {}
    for t in tables:
        df = spark.range(offset, offset + t.rows, 1, partitions) if partitions else spark.range(offset, offset + t.rows)
        df = df.withColumnRenamed("id", "_row")
        for name, spec in t.columns.items():
            df = df.withColumn(name, column(spark, spec, Stream(seed, t.name, name), F.col("_row"), sizes, {x.name: x for x in tables}))
        out[t.name] = df.drop("_row")
    return out


def batches(spark: SparkSession, tables: list[Table], days: int, seed: int = 42):
    """One dict of frames for each day: new rows continue the old ones, and keys reach back to all rows so far."""
    for day in range(days):
        so_far = {t.name: t.rows * (day + 1) for t in tables}
        out = {}
        for t in tables:
            df = spark.range(day * t.rows, (day + 1) * t.rows).withColumnRenamed("id", "_row")
            for name, spec in t.columns.items():
                df = df.withColumn(name, column(spark, spec, Stream(seed, t.name, name), F.col("_row"), so_far, {x.name: x for x in tables}))
            out[t.name] = df.drop("_row")
        yield out


def rank_in_parent(df: DataFrame, fk: str, order: list[str]) -> DataFrame:
    """Children with their ordinal and whether they are the first of their parent."""
    n = F.row_number().over(Window.partitionBy(fk).orderBy(*order))
    return df.withColumn("ordinal", n - 1).withColumn("is_first", n == 1)


def bootstrap(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """Rows of df drawn with replacement: draws of row numbers joined to the numbered rows."""
    from .relational import dense_numbers

    numbered = dense_numbers(df, [key], "_k")
    n = df.count()
    s = Stream(seed, "bootstrap", "row")
    draws = df.sparkSession.range(rows).select((F.floor(s.uniform(F.col("id")) * n) + 1).cast("long").alias("_k"), F.col("id").alias("draw"))
    return draws.join(numbered, "_k").drop("_k")


def copula(df: DataFrame, key: str, a: str, b: str, rho: float, seed: int = 42) -> DataFrame:
    """df with b's values dealt anew so that the ranks of a and b correlate as a Gaussian copula's with rho do."""
    from .relational import dense_numbers

    s = Stream(seed, "copula", b)
    n = max(1, df.count())
    ranked = dense_numbers(df, [a, key], "_ra")
    latent = rho * normal_quantile((F.col("_ra") - 0.5) / n) + math.sqrt(1 - rho * rho) * s.normal(F.xxhash64(key))
    scored = dense_numbers(ranked.withColumn("_z", latent), ["_z", key], "_rb")
    values = dense_numbers(df.select(F.col(b).alias("_b"), F.col(key).alias("_k")), ["_b", "_k"], "_rb").select("_rb", "_b")
    return scored.join(values, "_rb").withColumn(b, F.col("_b")).select(*df.columns)


def duplicates(df: DataFrame, key: str, rate: float, seed: int = 42) -> DataFrame:
    """df and copies of a share of its rows, with the cluster each row belongs to."""
    s = Stream(seed, "duplicates", key)
    marked = df.withColumn("cluster", F.col(key)).withColumn("is_copy", F.lit(False))
    copies = df.where(s.uniform(F.col(key)) < rate).withColumn("cluster", F.col(key)).withColumn("is_copy", F.lit(True))
    return marked.unionByName(copies)


def easter(year: int) -> date:
    """Of the Gregorian calendar."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return date(year, month, day + 1)


def nth_weekday(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th such weekday (Monday 0) of the month; -1 is the last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def federal_holidays(year: int) -> dict[str, date]:
    """The eleven United States federal holidays."""
    return {
        "New Year's Day": date(year, 1, 1), "Martin Luther King Jr. Day": nth_weekday(year, 1, 0, 3), "Presidents' Day": nth_weekday(year, 2, 0, 3), "Memorial Day": nth_weekday(year, 5, 0, -1),
        "Juneteenth": date(year, 6, 19), "Independence Day": date(year, 7, 4), "Labor Day": nth_weekday(year, 9, 0, 1), "Columbus Day": nth_weekday(year, 10, 0, 2), "Veterans Day": date(year, 11, 11),
        "Thanksgiving": nth_weekday(year, 11, 3, 4), "Christmas Day": date(year, 12, 25),
    }


def observed(day: date) -> date:
    """Saturday's holidays are kept on Friday, Sunday's on Monday."""
    return day - timedelta(1) if day.weekday() == 5 else day + timedelta(1) if day.weekday() == 6 else day


def calendar(spark: SparkSession, years: range, kept: bool = False) -> DataFrame:
    """date, name of the federal holidays (and Easter) of the years; kept moves them to the day they are observed."""
    rows = [(observed(d) if kept else d, n) for y in years for n, d in {**federal_holidays(y), "Easter": easter(y)}.items()]
    return spark.createDataFrame(rows, "date date, name string")


def retail_factor(day: date) -> float:
    """Demand on a day against an ordinary one: the weeks before Christmas rise, pay days and month ends a little."""
    thanks = nth_weekday(day.year, 11, 3, 4)
    factor = 1.0
    if thanks <= day <= date(day.year, 12, 24):
        factor *= 1.2 + 0.8 * (day - thanks).days / max(1, (date(day.year, 12, 24) - thanks).days)
    if day in (thanks + timedelta(1), thanks + timedelta(4)):
        factor *= 2.0
    if day.day in (1, 15):
        factor *= 1.1
    if (day + timedelta(1)).month != day.month:
        factor *= 1.05
    return factor


def day_factors(spark: SparkSession, start: date, end: date, growth: float = 0.0, factor=retail_factor) -> DataFrame:
    """date, factor, upto (the running share of all): a calendar to draw days from, with yearly growth."""
    rows, upto = [], 0.0
    days = [start + timedelta(k) for k in range((end - start).days + 1)]
    f = [factor(d) * (1 + growth) ** ((d - start).days / 365.25) for d in days]
    for d, x in zip(days, f, strict=True):
        upto += x / sum(f)
        rows.append((d, float(x), upto))
    return spark.createDataFrame(rows, "date date, factor double, upto double")


def day_drawn(df: DataFrame, days: DataFrame, u: str) -> DataFrame:
    """df with the day whose running share first reaches u (a column in [0, 1)); the calendar is one row of arrays."""
    row = days.orderBy("date").agg(F.sort_array(F.collect_list(F.struct("upto", "date"))).alias("_days"))
    at = F.least(F.size(F.filter("_days", lambda d: d["upto"] <= F.col(u))), F.size("_days") - 1)
    return df.crossJoin(F.broadcast(row)).withColumn("day", F.get("_days", at)["date"]).drop("_days")
