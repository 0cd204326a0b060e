"""Rule documents: parsed from data, checked against tables, compared between versions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.compare import schema_changes
from ..operators.joint import functional_dependency, implies
from ..operators.quality import Rule, check


@dataclass
class Contract:
    """What a table promises: columns with types, rules, dependencies, implications."""

    columns: dict[str, str] = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)
    dependencies: list[tuple[list[str], str, float]] = field(default_factory=list)
    implications: list[tuple[str, object, str, list]] = field(default_factory=list)

    @classmethod
    def of(cls, document: dict) -> Contract:
        rules = [Rule(r["column"], r["kind"], r.get("value"), r.get("dimension", "validity")) for r in document.get("rules", [])]
        return cls(document.get("columns", {}), rules, [(d["from"], d["to"], d.get("confidence", 1.0)) for d in document.get("dependencies", [])], [(i["if"], i["equals"], i["then"], i["in"]) for i in document.get("implications", [])])

    def findings(self, df: DataFrame) -> list[dict]:
        """What df breaks: one entry for each rule that fails."""
        types = dict(df.dtypes)
        out = [{"rule": f"column({c})", "detail": "missing" if c not in types else types[c]} for c, t in self.columns.items() if types.get(c) != t]
        if self.rules:
            out += [{"rule": r["rule"], "detail": r["failures"]} for r in check(df, self.rules).where("failures > 0").collect()]
        for a, b, least in self.dependencies:
            c = functional_dependency(df, a, b).first()["confidence"] or 1.0
            if c < least:
                out.append({"rule": f"{','.join(a)} -> {b}", "detail": c})
        for a, value, b, allowed in self.implications:
            n = implies(df, a, value, b, allowed).first()["violations"]
            if n:
                out.append({"rule": f"{a}={value} => {b}", "detail": n})
        return out

    def ddl(self, table: str) -> str:
        """CREATE TABLE with the not_null rules as constraints."""
        solid = {r.column for r in self.rules if r.kind == "not_null"}
        return f"CREATE TABLE {table} (" + ", ".join(f"`{c}` {t.upper()}{' NOT NULL' if c in solid else ''}" for c, t in self.columns.items()) + ")"


def compatible(old: DataFrame, new: DataFrame, mode: str = "backward") -> bool:
    """backward: new readers read old rows; forward: old readers read new rows; full: both."""
    kinds = {c["kind"] for c in schema_changes(old, new)}
    back, forth = not kinds & {"column_added", "type_changed"}, not kinds & {"column_removed", "type_changed", "type_widened"}
    return {"backward": back, "forward": forth, "full": back and forth}[mode]


def first_bad(history: list[DataFrame], contract: Contract) -> int | None:
    """The first of ordered versions that breaks the contract, by bisection (later ones are taken to break it too)."""
    lo, hi = 0, len(history)
    while lo < hi:
        mid = (lo + hi) // 2
        if contract.findings(history[mid]):
            hi = mid
        else:
            lo = mid + 1
    return lo if lo < len(history) else None


def mutation_test(df: DataFrame, contract: Contract, key: str) -> dict[str, bool]:
    """Which rules notice planted damage: for each a table with one fault of its kind."""
    out = {}
    for r in contract.rules:
        c, first = F.col(r.column), F.col(key) == df.agg(F.min(key)).first()[0]
        bad = {"not_null": F.lit(None), "min": F.lit(r.value) - 1 if r.kind == "min" else None, "max": F.lit(r.value) + 1 if r.kind == "max" else None, "in": F.lit("?planted?"), "regex": F.lit("?planted?"), "between": F.lit(r.value[1]) + 1 if r.kind == "between" else None}.get(r.kind)
        damaged = df.withColumn(r.column, F.when(first, bad).otherwise(c)) if bad is not None else df.unionByName(df.where(first))
        out[r.name] = check(damaged, [r]).first()["failures"] > check(df, [r]).first()["failures"]
    return out
