"""Path queries over stored profiles: rows, column("x").field, relationship("a","b").field, classification("x").field."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORM = re.compile(r'(rows|(column|classification|relationship)\((("[^"]*")(?:\s*,\s*"[^"]*")*)\))(?:\.([A-Za-z_][A-Za-z0-9_.]*))?')


def ask(profile: dict[str, DataFrame], expression: str) -> DataFrame:
    """The value an expression names, as a frame. profile has columns (key `column`), relationships (`a`, `b`), classifications (`column`).

    A correlation is found either way round; a foreign key only as it points.
    """
    m = FORM.fullmatch(expression.strip())
    if not m:
        raise ValueError(f"not a path: {expression!r}")
    if m[1] == "rows":
        return profile["columns"].agg(F.max("rows").alias("value"))
    names, field = re.findall(r'"([^"]*)"', m[3]), m[5]
    if m[2] == "relationship":
        if len(names) != 2:
            raise ValueError("a relationship has two ends")
        t = profile["relationships"]
        there = (F.col("a") == names[0]) & (F.col("b") == names[1])
        if "kind" in t.columns:
            there = there | ((F.col("a") == names[1]) & (F.col("b") == names[0]) & (F.col("kind") == "correlation"))
        found = t.where(there)
    else:
        found = profile["columns" if m[2] == "column" else "classifications"].where(F.col("column") == names[0])
    return found.select(F.col(field).alias("value")) if field else found
