"""Proposals from data: relationships, personal data, semantics, types and rules, each with its evidence and a confidence."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import NUMERIC
from ..functions.text import CODES, PATTERNS, is_iban
from ..operators.quality import Rule

# Words of column names that speak for a kind of personal data, in the order in which they are tried.
PERSONAL = {
    "email": ["email", "mail"],
    "phone": ["phone", "mobile", "fax", "tel"],
    "ssn": ["ssn", "social", "tin"],
    "name": ["firstname", "lastname", "surname", "fullname", "name"],
    "address": ["address", "street", "addr"],
    "postal_code": ["zip", "postal", "postcode"],
    "birth_date": ["birth", "dob", "birthday"],
    "ip_address": ["ip", "ipaddress"],
    "card": ["card", "pan", "creditcard"],
    "account": ["iban", "account"],
}
# Words of column names that speak for a meaning.
SEMANTICS = {
    "identifier": ["id", "key", "code", "uuid", "guid"],
    "money": ["price", "amount", "cost", "total", "balance", "bal", "revenue", "charge"],
    "quantity": ["quantity", "qty", "count", "num", "number", "size", "stock"],
    "rate": ["rate", "ratio", "percent", "pct", "discount", "tax", "share"],
    "time": ["date", "time", "ts", "at", "day", "month", "year"],
    "place": ["country", "nation", "region", "city", "state", "lat", "lon"],
    "status": ["status", "flag", "state", "type", "kind", "priority", "segment", "mode"],
    "text": ["comment", "note", "description", "text", "title", "html"],
}


def words_of(name: str) -> list[str]:
    """Words of a snake- or camel-case name, lower-cased."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def singular(word: str) -> str:
    return word[:-3] + "y" if word.endswith("ies") and len(word) > 4 else word[:-1] if word.endswith("s") and not word.endswith("ss") and len(word) > 3 else word


def stem(name: str) -> str:
    """A column's name without the prefix that all of a table's columns share (one or two letters) and without key words."""
    words = words_of(name)
    words = words[1:] if len(words) > 1 and len(words[0]) <= 2 else words
    joined = "".join(words)
    for end in ("key", "id", "code", "fk", "sk"):
        if joined.endswith(end) and len(joined) > len(end):
            return joined[: -len(end)]
    return joined


def name_evidence(child: str, parent_table: str, parent_key: str) -> float:
    """How much a child column's name points to a parent's key: 1 for its very name, or for the parent's name before a key word."""
    own, key, table = stem(child), stem(parent_key), singular("".join(words_of(parent_table)))
    if own and (own in (key, table) or table.startswith(own) and len(own) >= 4 or own.startswith(table)):
        return 1.0
    return round(max(SequenceMatcher(None, own, table).ratio(), SequenceMatcher(None, own, key).ratio()), 6)


def key_columns(df: DataFrame) -> list[str]:
    """Columns that are distinct in every row and never null: first by a sketch, those near enough then exactly."""
    fit = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.StringType))]
    if not fit:
        return []
    row = df.agg(F.count("*").alias("n"), *[F.approx_count_distinct(c, 0.02).alias(f"d_{c}") for c in fit], *[F.count(c).alias(f"c_{c}") for c in fit]).first()
    likely = [c for c in fit if row["n"] and row[f"c_{c}"] == row["n"] and row[f"d_{c}"] >= 0.9 * row["n"]]
    return [c for c in likely if df.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").isEmpty()]


def contained(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """One row: distinct values of the column, and how many of them the key has."""
    own = child.select(F.col(column).alias("v")).where("v is not null").distinct()
    known = parent.select(F.col(key).alias("v"), F.lit(1).alias("known"))
    return own.join(known, "v", "left").agg(F.count("*").alias("distinct"), F.count("known").alias("found"))


def propose_relationships(tables: dict[str, DataFrame], least: float = 0.9, least_name: float = 0.6) -> DataFrame:
    """child, column, parent, key, name_score, containment, confidence: foreign keys that names and values speak for.

    Names are judged first, so values are compared of the pairs only that names allow; the confidence is the mean of both.
    """
    spark = next(iter(tables.values())).sparkSession
    keys = {name: key_columns(df) for name, df in tables.items()}
    out = spark.createDataFrame([], "child string, column string, parent string, key string, name_score double, containment double")
    for child, df in tables.items():
        kinds = dict(df.dtypes)
        for parent, other in tables.items():
            for key in keys[parent] if parent != child else []:
                for c in df.columns:
                    score = name_evidence(c, parent, key)
                    if kinds[c] != dict(other.dtypes)[key] or score < least_name or kinds[c] not in ("int", "bigint", "smallint", "string"):
                        continue
                    row = contained(df, c, other, key)
                    out = out.unionByName(row.select(F.lit(child).alias("child"), F.lit(c).alias("column"), F.lit(parent).alias("parent"), F.lit(key).alias("key"), F.lit(score).alias("name_score"), F.coalesce(F.try_divide("found", "distinct"), F.lit(0.0)).alias("containment")))
    return out.where(F.col("containment") >= least).withColumn("confidence", (F.col("name_score") + F.col("containment")) / 2)


def by_words(name: str, lists: dict[str, list[str]]) -> str | None:
    """The first kind one of whose words the name ends with, else has."""
    words = words_of(name)
    joined = "".join(words)
    for kind, known in lists.items():
        if words and words[-1] in known or joined in known:
            return kind
    for kind, known in lists.items():
        if set(words) & set(known) or any(len(w) > 2 and joined.endswith(w) for w in known):
            return kind
    return None


def propose_pii(df: DataFrame, least: float = 0.8) -> DataFrame:
    """column, kind, name_kind, value_kind, value_rate, confidence: personal data by a column's name, its values, or both.

    Values speak where the share of those that a pattern matches reaches `least`; name and values together give 0.95.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    tests: dict[str, callable] = {
        "email": lambda c: c.rlike(PATTERNS["email"]),
        "phone": lambda c: c.rlike(PATTERNS["us_phone"]),
        "ssn": lambda c: c.rlike(PATTERNS["us_ssn"]),
        "ip_address": lambda c: c.rlike(PATTERNS["ipv4"]),
        "account": is_iban,
    }
    rate = lambda c, t: F.coalesce(F.avg(t(F.col(c)).cast("double")), F.lit(0.0))
    rates = df.agg(*[rate(c, t).alias(f"{k}_{n}") for k, c in enumerate(text) for n, t in tests.items()]) if text else df.limit(0).select(F.lit(None).alias("none"))
    rows = []
    for name in df.columns:
        kind = by_words(name, PERSONAL)
        found = F.array(*[F.struct(F.col(f"{text.index(name)}_{n}").alias("rate"), F.lit(n).alias("kind")) for n in tests]) if name in text else F.array().cast("array<struct<rate:double,kind:string>>")
        best = F.array_max(F.filter(found, lambda x: x["rate"] >= least))
        rows.append(F.struct(F.lit(name).alias("column"), F.lit(kind).cast("string").alias("name_kind"), best["kind"].alias("value_kind"), F.coalesce(best["rate"], F.lit(0.0)).alias("value_rate")))
    out = rates.select(F.explode(F.array(*rows)).alias("x")).select("x.*") if text else df.sparkSession.createDataFrame([(n, by_words(n, PERSONAL), None, 0.0) for n in df.columns], "column string, name_kind string, value_kind string, value_rate double")
    both = F.col("name_kind").isNotNull() & F.col("value_kind").isNotNull()
    confidence = F.when(both & (F.col("name_kind") == F.col("value_kind")), 0.95).when(F.col("value_kind").isNotNull(), F.col("value_rate")).when(F.col("name_kind").isNotNull(), 0.6)
    return out.withColumn("kind", F.coalesce("value_kind", "name_kind")).withColumn("confidence", confidence).where("kind is not null").select("column", "kind", "name_kind", "value_kind", "value_rate", "confidence")


def propose_semantics(df: DataFrame) -> DataFrame:
    """column, semantics, by (name or values): by the words of the name; else codes, or few levels, by the values."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    named = {c: by_words(c, SEMANTICS) for c in df.columns}
    asked = [c for c in text if named[c] is None]
    spark = df.sparkSession
    out = spark.createDataFrame([(c, s, "name") for c, s in named.items() if s], "column string, semantics string, by string")
    if asked:
        aggs = [F.coalesce(F.avg(F.col(c).isin(codes).cast("double")), F.lit(0.0)).alias(f"{k}_{n}") for k, c in enumerate(asked) for n, codes in CODES.items()]
        row = df.agg(*aggs, *[F.approx_count_distinct(c).alias(f"{k}_levels") for k, c in enumerate(asked)])
        told = []
        for k, c in enumerate(asked):
            s = F.lit(None).cast("string")
            for n in reversed(CODES):
                s = F.when(F.col(f"{k}_{n}") >= 0.95, F.lit(n)).otherwise(s)
            told.append(F.struct(F.lit(c).alias("column"), F.coalesce(s, F.when(F.col(f"{k}_levels") <= 20, "status")).alias("semantics"), F.lit("values").alias("by")))
        out = out.unionByName(row.select(F.explode(F.array(*told)).alias("x")).select("x.*").where("semantics is not null"))
    return out


# The types that text is tried as, narrowest first.
TRIED = ["bigint", "double", "date", "timestamp", "boolean"]


def propose_types(df: DataFrame, least: float = 1.0) -> DataFrame:
    """column, declared, proposed, rate, is_identifier: of text columns the narrowest type that so many values fit.

    Numbers with leading zeros, and digits of one length that are distinct in nearly every row, are identifiers and stay text.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    spark = df.sparkSession
    rest = spark.createDataFrame([(n, k, k, 1.0, False) for n, k in df.dtypes if n not in text], "column string, declared string, proposed string, rate double, is_identifier boolean")
    if not text:
        return rest

    def fits(c: Column, kind: str) -> Column:
        if kind == "boolean":
            return F.lower(c).isin("true", "false", "yes", "no", "t", "f", "y", "n")
        if kind in ("bigint", "double"):
            return F.trim(c).rlike(r"^[+-]?\d+$" if kind == "bigint" else r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
        return c.rlike(r"^\d{4}-\d{2}-\d{2}$" if kind == "date" else r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$") & c.try_cast(kind).isNotNull()

    aggs = [F.coalesce(F.avg(F.coalesce(fits(F.col(c), t), F.lit(False)).cast("double")), F.lit(0.0)).alias(f"{k}_{t}") for k, c in enumerate(text) for t in TRIED]
    aggs += [F.count_if(F.col(c).rlike(r"^0\d")).alias(f"{k}_zeros") for k, c in enumerate(text)]
    aggs += [F.count(c).alias(f"{k}_n") for k, c in enumerate(text)] + [F.approx_count_distinct(c, 0.02).alias(f"{k}_d") for k, c in enumerate(text)]
    aggs += [F.min(F.length(c)).alias(f"{k}_lo") for k, c in enumerate(text)] + [F.max(F.length(c)).alias(f"{k}_hi") for k, c in enumerate(text)]
    told = []
    for k, c in enumerate(text):
        digits = F.col(f"{k}_bigint") >= least
        identifier = digits & ((F.col(f"{k}_zeros") > 0) | ((F.col(f"{k}_lo") == F.col(f"{k}_hi")) & (F.col(f"{k}_lo") >= 6) & (F.col(f"{k}_d") >= 0.9 * F.col(f"{k}_n"))))
        proposed, rate = F.lit("string"), F.lit(1.0)
        for t in reversed(TRIED):
            hit = (F.col(f"{k}_n") > 0) & (F.col(f"{k}_{t}") >= least)
            proposed, rate = F.when(hit, F.lit(t)).otherwise(proposed), F.when(hit, F.col(f"{k}_{t}")).otherwise(rate)
        told.append(F.struct(F.lit(c).alias("column"), F.lit("string").alias("declared"), F.when(identifier, "string").otherwise(proposed).alias("proposed"), rate.alias("rate"), identifier.alias("is_identifier")))
    return df.agg(*aggs).select(F.explode(F.array(*told)).alias("x")).select("x.*").unionByName(rest)


def propose_rules(df: DataFrame, least: float = 0.99, levels: int = 12) -> DataFrame:
    """rule, column, kind, support, confidence: rules that at least that share of the rows keeps.

    not_null and unique by counting, between by the least and the greatest finite value, in by the values of a column of
    few. A rule that personal data would give away (values of a column that propose_pii names) is left out.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    hidden = {c for c in df.columns if by_words(c, PERSONAL)}
    row = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"c_{c}") for c in df.columns], *[f(c).cast("double").alias(f"{n}_{c}") for c in numeric for n, f in (("lo", F.min), ("hi", F.max))], *[F.approx_count_distinct(c).alias(f"d_{c}") for c in text], *[F.count_distinct(c).alias(f"u_{c}") for c in df.columns[:1]])
    got = row.first()
    n, rules = got["n"], []
    for c in df.columns:
        if n and got[f"c_{c}"] >= least * n:
            rules.append((Rule(c, "not_null").name, c, "not_null", None, got[f"c_{c}"], got[f"c_{c}"] / n))
    for c in numeric:
        if got[f"lo_{c}"] is not None:
            rules.append((Rule(c, "between").name, c, "between", f"{got[f'lo_{c}']:.10g} {got[f'hi_{c}']:.10g}", got[f"c_{c}"], 1.0))
    for c in text:
        if c not in hidden and 0 < got[f"d_{c}"] <= levels:
            values = sorted(r[0] for r in df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*")).collect())
            rules.append((Rule(c, "in").name, c, "in", "|".join(values), got[f"c_{c}"], 1.0))
    first = df.columns[0]
    if n and got[f"u_{first}"] == n:
        rules.append((Rule(first, "unique").name, first, "unique", None, n, 1.0))
    return df.sparkSession.createDataFrame(rules, "rule string, column string, kind string, value string, support long, confidence double")
