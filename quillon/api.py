"""The library's front door: profile, check, diff, generate, query, and keep what they give."""

from __future__ import annotations

import html
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.guards import NUMERIC, TEMPORAL
from .operators import compare, generate as _generate, joint, profile as _profile, relational
from .operators.compare import CLASSES, LIMITS
from .plans.contracts import Contract
from .plans.paths import ask
from .sources import readers


def profile(spark: SparkSession, source, bounded: bool = False, name: str = "table", **options) -> dict[str, DataFrame]:
    """A source's profile as frames: columns (one row each), top_values, relationships (correlations), times."""
    df = readers.resolve(spark, source, **options)
    numeric, text = _profile.columns_of(df, NUMERIC), _profile.columns_of(df, (T.StringType,))
    parts = []
    if numeric:
        parts.append(_profile.numeric_profile(df, numeric, exact=not bounded).withColumn("kind", F.lit("numeric")))
    if text:
        parts.append(_profile.text_profile(df, text).withColumn("kind", F.lit("text")))
    columns = parts[0]
    for p in parts[1:]:
        columns = columns.unionByName(p, allowMissingColumns=True)
    out = {"columns": columns.withColumn("table", F.lit(name)), "top_values": _profile.top_values(df, text or numeric)}
    out["relationships"] = _profile.correlations(df, numeric).withColumn("kind", F.lit("correlation"))
    if text:
        out["classifications"] = _profile.pattern_profile(df, text).where(F.col("share") >= 0.8)
    for c in _profile.columns_of(df, TEMPORAL):
        one = _profile.temporal_profile(df, c).withColumn("column", F.lit(c))
        out["times"] = out["times"].unionByName(one) if "times" in out else one
    return out


def profile_folder(spark: SparkSession, path: str) -> dict[str, dict[str, DataFrame]]:
    """Profiles of all tables of a folder; `links` has the foreign keys that their names and values suggest."""
    tables = readers.folder(spark, path)
    out = {n: profile(spark, df, name=n) for n, df in tables.items()}
    out["links"] = {"foreign_keys": links(spark, tables)}
    return out


def links(spark: SparkSession, tables: dict[str, DataFrame], least: float = 0.9) -> DataFrame:
    """child, column, parent, key, share for columns <parent>_id that hold that share of values of the parent's key."""
    keys = {n: [r["column"] for r in _profile.keys_of(df, n).orderBy(F.desc("named"), "column").collect()] for n, df in tables.items()}
    rows = []
    for child, df in tables.items():
        for c in df.columns:
            parent = c.removesuffix("_id")
            if c.endswith("_id") and parent in tables and parent != child and keys[parent]:
                found = _profile.foreign_key(df, c, tables[parent], keys[parent][0], least).first()
                if found["is_fk"]:
                    rows.append((child, c, parent, keys[parent][0], found["share"]))
    return spark.createDataFrame(rows, "child string, column string, parent string, key string, share double")


def save(profiled: dict[str, DataFrame], path: str) -> None:
    for name, df in profiled.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load(spark: SparkSession, path: str, names: tuple[str, ...] = ("columns", "top_values", "relationships", "classifications", "times")) -> dict[str, DataFrame]:
    """A saved profile, as far as it has these parts."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names if fs.exists(hadoop(f"{path.rstrip('/')}/{n}"))}


def query(profiled: dict[str, DataFrame], expression: str) -> DataFrame:
    return ask(profiled, expression)


def check(spark: SparkSession, source, contract: dict | Contract, **options) -> list[dict]:
    """What a source breaks of a contract."""
    return (contract if isinstance(contract, Contract) else Contract.of(contract)).findings(readers.resolve(spark, source, **options))


def diff(spark: SparkSession, before, after, numeric: list[str] | None = None, categorical: list[str] | None = None) -> list[dict]:
    """Scored changes between two versions of a table, the gravest first: column, kind, class, score."""
    a, b = readers.resolve(spark, before), readers.resolve(spark, after)
    out = [c | {"score": 1.0} for c in compare.schema_changes(a, b)]
    n_a, n_b = a.count(), b.count()
    ratio = n_b / n_a if n_a else math.inf if n_b else 1.0
    if not LIMITS["row_count_ratio_min"] <= ratio <= LIMITS["row_count_ratio_max"]:
        out.append({"column": "*", "kind": "row_count_change", "score": ratio})
    shared = [c for c in a.columns if c in b.columns and dict(a.dtypes)[c] == dict(b.dtypes)[c]]
    numeric = [c for c in shared if isinstance(a.schema[c].dataType, NUMERIC)] if numeric is None else numeric
    categorical = [c for c in shared if isinstance(a.schema[c].dataType, T.StringType)] if categorical is None else categorical
    rates = lambda df: df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in shared]).first() if shared else {}
    r_a, r_b = rates(a), rates(b)
    for c in shared:
        gap = abs((r_b[c] or 0) - (r_a[c] or 0))
        if gap > LIMITS["null_rate"]:
            out.append({"column": c, "kind": "null_rate_change", "score": gap})
    for c in numeric:
        gap = compare.psi_numeric(a, b, c).first()["psi"]
        if gap and gap >= LIMITS["psi"]:
            out.append({"column": c, "kind": "distribution_shift", "score": gap})
        outside = compare.out_of_range_share(a, b, c).first()["share"]
        if outside > LIMITS["out_of_range_share"]:
            out.append({"column": c, "kind": "range_change", "score": outside})
    for c in categorical:
        gap = compare.psi_categorical(a, b, c).first()["psi"]
        if gap and gap >= LIMITS["psi"]:
            out.append({"column": c, "kind": "category_shift", "score": gap})
        elif not compare.new_values(a, b, c).isEmpty():
            out.append({"column": c, "kind": "new_categories", "score": compare.unseen_share(a, b, c).first()["share"]})
    order = {"breaking": 0, "additive": 1, "cosmetic": 2}
    out = [c | {"class": CLASSES.get(c["kind"], "cosmetic")} for c in out]
    return sorted(out, key=lambda c: (order[c["class"]], -c["score"], c["column"]))


def gate(changes: list[dict], at: str = "breaking") -> bool:
    """Whether no change is of that class or a graver one."""
    order = ["breaking", "additive", "cosmetic"]
    return not any(order.index(c["class"]) <= order.index(at) for c in changes)


def types_report(spark: SparkSession, source, **options) -> DataFrame:
    """Text columns whose values would fit another type."""
    df = readers.resolve(spark, source, **options)
    return _profile.infer_types(df, _profile.columns_of(df, (T.StringType,))).where("inferred <> 'string'")


def generate(spark: SparkSession, tables: list[_generate.Table], seed: int = 42) -> dict[str, DataFrame]:
    return _generate.generate(spark, tables, seed)


def learn(spark: SparkSession, source, name: str, rows: int | None = None, **options) -> _generate.Table:
    """A table to generate like a source: quantiles of numbers, shares of frequent texts, null rates."""
    df = readers.resolve(spark, source, **options)
    n, grid = df.count(), [k / 20 for k in range(21)]
    columns = {}
    for f in df.schema.fields:
        nulls = df.where(F.col(f.name).isNull()).count() / max(1, n)
        if isinstance(f.dataType, NUMERIC):
            q = df.agg(F.percentile_approx(F.col(f.name).cast("double"), grid, 10_000)).first()[0]
            if q:
                columns[f.name] = {"strategy": "distribution", "family": "empirical", "params": {"probabilities": grid, "quantiles": [float(x) for x in q]}, "null_rate": nulls}
        elif isinstance(f.dataType, T.StringType):
            top = _profile.top_values(df, [f.name], 50).orderBy("rank").collect()
            if top:
                columns[f.name] = {"strategy": "weighted_enum", "weights": {r["value"]: float(r["count"]) for r in top}, "null_rate": nulls}
        elif isinstance(f.dataType, TEMPORAL):
            ends = df.agg(F.min(f.name).cast("date"), F.max(f.name).cast("date")).first()
            if ends[0]:
                columns[f.name] = {"strategy": "temporal", "start": ends[0].isoformat(), "end": ends[1].isoformat(), "null_rate": nulls}
    return _generate.Table(name, n if rows is None else rows, columns)


def timeline(history: list[DataFrame], key: str = "column") -> list[DataFrame]:
    """Changes between each profile and the next."""
    return [compare.profile_diff(a, b, key) for a, b in zip(history, history[1:], strict=False)]


def certify(spark: SparkSession, source, generated, numeric: list[str]) -> dict:
    """Fidelity of generated rows to a source: each column's score, the table's, and whether it passes."""
    scores = compare.fidelity_numeric(readers.resolve(spark, source), readers.resolve(spark, generated), numeric)
    table = compare.fidelity_table(scores).first()
    return {"columns": {r["column"]: r["score"] for r in scores.collect()}, "table": table["score"], "passed": table["passed"]}


def plan(tables: list[_generate.Table]) -> list[str]:
    """The order in which tables are generated: parents first; a cycle is refused."""
    needs = {t.name: {c["parent"] for c in t.columns.values() if c.get("parent") and c["parent"] != t.name} for t in tables}
    out: list[str] = []
    while len(out) < len(needs):
        ready = sorted(n for n in needs if n not in out and needs[n] <= set(out))
        if not ready:
            raise ValueError(f"tables need one another: {sorted(set(needs) - set(out))}")
        out += ready
    return out


def report(rows: list[dict], form: str = "json") -> str:
    """Rows as sorted JSON, a Markdown table, or a page of HTML that needs nothing else."""
    if form == "json":
        return json.dumps(rows, indent=2, sort_keys=True, default=str)
    names = sorted({k for r in rows for k in r})
    if form == "md":
        lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
        return "\n".join(lines + ["| " + " | ".join(str(r.get(n, "")).replace("|", "\\|") for n in names) + " |" for r in rows])
    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values) + "</tr>"
    return "<!doctype html><meta charset='utf-8'><table>" + cells("th", names) + "".join(cells("td", [r.get(n, "") for n in names]) for r in rows) + "</table>"


def star(fact: DataFrame, dimensions: dict[str, tuple[DataFrame, str, str]], dates: list[str]) -> dict[str, DataFrame]:
    """A star: {name: (table, its key, the fact's column)} to dimensions with surrogates, and the fact that points to them."""
    dims = {n: relational.dimension(df, key, n) for n, (df, key, _) in dimensions.items()}
    out = relational.fact(fact, [(dims[n], own, key, f"sk_{n}") for n, (_, key, own) in dimensions.items()], dates)
    return dims | {"fact": out}


def dependencies(df: DataFrame, columns: list[str], least: float = 0.95) -> list[dict]:
    """Near-exact dependencies between single columns."""
    out = []
    for a in columns:
        for b in columns:
            if a != b:
                r = joint.functional_dependency(df, [a], b).first()
                if r and r["confidence"] and r["confidence"] >= least and r["repeated_groups"] >= 5:
                    out.append({"from": a, "to": b, "confidence": r["confidence"], "lift": r["lift"]})
    return out
