"""Contract rules over several columns or with their own tests, and contracts as other tools write them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import ratio
from ..functions.text import full_match, is_code
from ..operators.joint import functional_dependency
from ..operators.quality import Rule
from ..operators.relational import membership

# Texts that stand for a missing value, upper-cased.
PLACEHOLDERS = ["N/A", "NULL", "UNKNOWN", "-", "?", "NONE", "TBD", "TEST"]


def outcome(row: DataFrame, rule: str, on: str, value: Column, ok: Column) -> DataFrame:
    """One row: rule, on, value, ok. Without anything to judge the value is null and the rule holds."""
    return row.select(F.lit(rule).alias("rule"), F.lit(on).alias("on"), value.cast("double").alias("value"), F.coalesce(ok, F.lit(True)).alias("ok"))


def fd_rule(df: DataFrame, determinants: list[str], dependent: str, least: float = 1.0) -> DataFrame:
    """The dependency holds with that confidence."""
    c = F.col("confidence")
    return outcome(functional_dependency(df, determinants, dependent), "fd", f"{' '.join(determinants)} -> {dependent}", c, c >= least)


def reference_pair(df: DataFrame, columns: list[str], reference: DataFrame, least: float = 1.0) -> DataFrame:
    """So large a share of the complete tuples is in the reference."""
    c = F.col("share")
    return outcome(membership(df, columns, reference), "reference_pair", " ".join(columns), c, c >= least)


def implausible(df: DataFrame, column: str, test: Column, most: float) -> DataFrame:
    """No more than that share of the values that are there passes a test that plausible ones fail."""
    share = F.avg(F.when(F.col(column).isNotNull(), F.coalesce(test, F.lit(False)).cast("double")))
    return outcome(df.agg(share.alias("s")), "implausible", column, F.col("s"), F.col("s") <= most)


def no_placeholder(df: DataFrame, column: str, values: list[str] = PLACEHOLDERS, most: float = 0.0) -> DataFrame:
    c = F.upper(F.trim(F.col(column).cast("string")))
    return outcome(df.agg(F.avg(c.isin(values).cast("double")).alias("s")), "no_placeholder", column, F.col("s"), F.col("s") <= most)


def valid_as(df: DataFrame, column: str, kind: str, least: float = 1.0) -> DataFrame:
    """So large a share of the values is a valid code (iban, us_zip, a list of ISO codes)."""
    return outcome(df.agg(F.avg(is_code(F.col(column), kind).cast("double")).alias("s")), "valid_as", f"{column} {kind}", F.col("s"), F.col("s") >= least)


def regex_rule(df: DataFrame, column: str, pattern: str, least: float = 1.0) -> DataFrame:
    return outcome(df.agg(F.avg(full_match(F.col(column), pattern).cast("double")).alias("s")), "regex", column, F.col("s"), F.col("s") >= least)


def regex_on_profile(top_values: DataFrame, column: str, pattern: str, rows: int) -> DataFrame:
    """The rule judged on a profile's top values (column, value, count) alone: violated, passed, or unknown where values are not all listed."""
    own = top_values.where(F.col("column") == column)
    row = own.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("seen"), F.coalesce(F.sum(F.when(~full_match(F.col("value"), pattern), F.col("count"))), F.lit(0)).alias("bad"))
    verdict = F.when(F.col("bad") > 0, "violated").when(F.col("seen") >= rows, "passed").otherwise("unknown")
    return row.select(F.lit(column).alias("column"), "seen", "bad", ratio(F.col("seen"), F.lit(rows)).alias("share_seen"), verdict.alias("verdict"))


def fix(df: DataFrame, rule: Rule, key: str, seed: int = 42) -> DataFrame:
    """df with one rule repaired: bounds by values drawn within them, lists by their first value, missing ones by the rule's value."""
    from ..operators.quality import repair

    if rule.kind in ("min", "max", "between"):
        low, high = {"min": (rule.value, None), "max": (None, rule.value)}.get(rule.kind, rule.value)
        return repair(df, rule.column, low, high, key, seed)
    c = F.col(rule.column)
    if rule.kind == "in":
        return df.withColumn(rule.column, F.when(rule.fails(), F.lit(rule.value[0])).otherwise(c))
    if rule.kind == "not_null":
        return df.withColumn(rule.column, F.coalesce(c, F.lit(rule.value)))
    raise ValueError(f"{rule.kind} can't be repaired row by row")


def expectation_suite(name: str, rules: list[Rule]) -> str:
    """The rules as an expectation suite, as JSON text."""
    made = {
        "not_null": lambda r: ("expect_column_values_to_not_be_null", {}),
        "unique": lambda r: ("expect_column_values_to_be_unique", {}),
        "min": lambda r: ("expect_column_values_to_be_between", {"min_value": r.value}),
        "max": lambda r: ("expect_column_values_to_be_between", {"max_value": r.value}),
        "between": lambda r: ("expect_column_values_to_be_between", {"min_value": r.value[0], "max_value": r.value[1]}),
        "in": lambda r: ("expect_column_values_to_be_in_set", {"value_set": list(r.value)}),
        "regex": lambda r: ("expect_column_values_to_match_regex", {"regex": f"^(?:{r.value})$"}),
    }
    told = [made[r.kind](r) for r in rules]
    return json.dumps({"name": name, "expectations": [{"type": t, "kwargs": {"column": r.column, **k}} for r, (t, k) in zip(rules, told, strict=True)]}, indent=2, default=str)


def read_expectation_suite(text: str) -> list[Rule]:
    """The rules of such a suite; expectations of other kinds raise."""
    out = []
    for e in json.loads(text)["expectations"]:
        k = dict(e["kwargs"])
        c, kind = k.pop("column"), e["type"]
        if kind == "expect_column_values_to_not_be_null":
            out.append(Rule(c, "not_null"))
        elif kind == "expect_column_values_to_be_unique":
            out.append(Rule(c, "unique"))
        elif kind == "expect_column_values_to_be_in_set":
            out.append(Rule(c, "in", k["value_set"]))
        elif kind == "expect_column_values_to_match_regex":
            out.append(Rule(c, "regex", k["regex"].removeprefix("^(?:").removesuffix(")$")))
        elif kind == "expect_column_values_to_be_between":
            both = "min_value" in k and "max_value" in k
            out.append(Rule(c, "between", (k["min_value"], k["max_value"])) if both else Rule(c, "min", k["min_value"]) if "min_value" in k else Rule(c, "max", k["max_value"]))
        else:
            raise ValueError(f"no such expectation: {kind}")
    return out


# JSON Schema types of Spark's.
JSON_TYPES = {"string": "string", "int": "integer", "bigint": "integer", "smallint": "integer", "double": "number", "float": "number", "boolean": "boolean", "date": "string", "timestamp": "string"}


def json_schema(name: str, columns: dict[str, str], rules: list[Rule]) -> str:
    """A JSON Schema of one row."""
    properties: dict[str, dict] = {}
    for c, t in columns.items():
        kind = JSON_TYPES.get(t, "number" if t.startswith("decimal") else "string")
        own = [r for r in rules if r.column == c]
        p: dict = {"type": kind if any(r.kind == "not_null" for r in own) else [kind, "null"]}
        if t in ("date", "timestamp"):
            p["format"] = "date" if t == "date" else "date-time"
        for r in own:
            p |= {"min": lambda r=r: {"minimum": r.value}, "max": lambda r=r: {"maximum": r.value}, "between": lambda r=r: {"minimum": r.value[0], "maximum": r.value[1]}, "in": lambda r=r: {"enum": list(r.value)}, "regex": lambda r=r: {"pattern": f"^(?:{r.value})$"}}.get(r.kind, dict)()
        properties[c] = p
    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "title": name, "type": "object", "properties": properties, "required": list(columns)}, indent=2, default=str)


def pandera_schema(name: str, columns: dict[str, str], rules: list[Rule]) -> str:
    """Python text of a pandera schema for Spark frames."""
    checks = {"min": lambda r: f"pa.Check.ge({r.value!r})", "max": lambda r: f"pa.Check.le({r.value!r})", "between": lambda r: f"pa.Check.in_range({r.value[0]!r}, {r.value[1]!r})", "in": lambda r: f"pa.Check.isin({list(r.value)!r})", "regex": lambda r: f"pa.Check.str_matches({'^(?:' + r.value + ')$'!r})"}
    lines = ["import pandera.pyspark as pa", "import pyspark.sql.types as T", "", f"{name} = pa.DataFrameSchema({{"]
    kinds = {"string": "T.StringType()", "int": "T.IntegerType()", "bigint": "T.LongType()", "double": "T.DoubleType()", "date": "T.DateType()", "timestamp": "T.TimestampType()", "boolean": "T.BooleanType()"}
    for c, t in columns.items():
        own = [r for r in rules if r.column == c]
        made = ", ".join(checks[r.kind](r) for r in own if r.kind in checks)
        lines.append(f"    {c!r}: pa.Column({kinds.get(t, 'T.StringType()')}, nullable={not any(r.kind == 'not_null' for r in own)}{', checks=[' + made + ']' if made else ''}),")
    return "\n".join([*lines, "})", ""])


GATE_SCHEMA = {
    "type": "object",
    "required": ["rules"],
    "properties": {"rules": {"type": "array", "items": {"type": "object", "required": ["column", "kind"], "properties": {"column": {"type": "string"}, "kind": {"enum": ["not_null", "min", "max", "between", "in", "regex", "unique"]}, "value": {}, "dimension": {"type": "string"}}}}},
}


def check_gate_document(document: dict) -> list[str]:
    """What a gate document lacks or has wrong, by GATE_SCHEMA; empty if nothing."""
    if not isinstance(document, dict) or not isinstance(document.get("rules"), list):
        return ["rules: a list is required"]
    kinds, out = GATE_SCHEMA["properties"]["rules"]["items"]["properties"]["kind"]["enum"], []
    for k, r in enumerate(document["rules"]):
        out += [f"rules[{k}].{need}: required" for need in ("column", "kind") if need not in r]
        if "kind" in r and r["kind"] not in kinds:
            out.append(f"rules[{k}].kind: {r['kind']} is not one of {', '.join(kinds)}")
        if r.get("kind") in ("min", "max", "between", "in", "regex") and "value" not in r:
            out.append(f"rules[{k}].value: required")
    return out
