"""Design theory against brute force, contracts as other tools write them, summaries of heavy hitters, releases, schedules."""

import json
import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.operators import defects, evidence, releases, versions
from quillon.operators.quality import Rule
from quillon.plans import design, proposals, rules
from quillon.streaming import schedule

ORDER = list("abcde")
some = st.frozensets(st.sampled_from(ORDER), min_size=1, max_size=2)
dependencies = st.lists(st.builds(design.FD, some, some), max_size=6)


def brute_closure(x, fds):
    known = set(x)
    for _ in ORDER * 2:
        for d in fds:
            if d.left <= known:
                known |= d.right
    return known


@given(dependencies)
@settings(max_examples=150, deadline=None)
def test_design_theory(fds):
    subsets = [frozenset(c) for n in range(1, 6) for c in combinations(ORDER, n)]
    cover = design.minimal_cover(fds, ORDER)
    for x in subsets:
        assert design.closure(x, fds) == brute_closure(x, fds) == design.closure(x, cover)
    for d in cover:
        assert brute_closure(d.left, [o for o in cover if o != d]) != brute_closure(d.left, cover)
    whole = [x for x in subsets if brute_closure(x, fds) == set(ORDER)]
    keys = {x for x in whole if not any(y < x for y in whole)}
    assert {frozenset(k) for k in design.candidate_keys(ORDER, fds)} == keys
    relations = design.synthesize_3nf(ORDER, fds)
    assert set().union(*map(set, relations)) == set(ORDER) and design.is_lossless(ORDER, relations, fds)
    kept = [design.FD(d.left, d.right) for d in cover if any(d.left | d.right <= set(r) for r in relations)]
    assert all(brute_closure(d.left, kept) >= d.right for d in fds)


def test_normal_forms_and_modes():
    fds = [design.FD.of("order", "customer"), design.FD.of("customer", "city"), design.FD.of("order item", "price")]
    d = design.Design("sales", dict.fromkeys(["order", "customer", "city", "item", "price"], "string"), fds)
    assert d.keys() == [("order", "item")] and not design.is_3nf(d.order, fds) and design.is_3nf(["a", "b"], [design.FD.of("a", "b")])
    assert not design.is_lossless(d.order, [("order", "item"), ("customer", "city", "price")], fds)
    assert design.derive(d, "star") == {"fact_sales": ["order", "customer", "item", "price"], "dim_customer": ["customer", "city"]}
    assert ["customer", "city"] in design.derive(d, "3nf").values()
    assert {f["finding"] for f in design.lint(d, {"price": "average", "stock": "balance"})} == {"not_3nf", "not_additive", "semi_additive"}


def test_design_from_rows(spark):
    df = spark.createDataFrame([(1, "x", 10, None), (2, "x", 10, 5), (3, "y", 20, 5), (4, "y", 20, 5)], "id int, code string, n int, m int")
    d = design.design_from_rows(df, "t")
    assert ("id",) in d.keys()
    found = {(tuple(sorted(f.left)), *f.right) for f in d.fds}
    assert {(("code",), "n"), (("n",), "code"), (("id",), "m")} <= found and (("code",), "m") not in found


RULES = [Rule("a", "not_null"), Rule("a", "between", (1, 5)), Rule("b", "in", ["x", "y"]), Rule("b", "regex", "[xy]"), Rule("c", "min", 0), Rule("c", "max", 9), Rule("a", "unique")]


def test_contracts_as_text():
    assert rules.read_expectation_suite(rules.expectation_suite("s", RULES)) == [Rule(r.column, r.kind, r.value) for r in [Rule("a", "not_null"), Rule("a", "between", (1, 5)), *RULES[2:]]]
    made = json.loads(rules.json_schema("t", {"a": "int", "b": "string", "c": "double"}, RULES))
    assert made["properties"]["a"] == {"type": "integer", "minimum": 1, "maximum": 5} and made["properties"]["b"]["enum"] == ["x", "y"]
    compile(rules.pandera_schema("t", {"a": "int", "b": "string", "c": "double"}, RULES), "t", "exec")
    assert rules.check_gate_document({"rules": [{"column": "a", "kind": "min", "value": 1}]}) == []
    assert len(rules.check_gate_document({"rules": [{"kind": "odd"}, {"column": "a", "kind": "in"}]})) == 3


def test_rules_are_repaired(spark):
    df = spark.createDataFrame([(1, 50, None, "z"), (2, 3, 7, "x")], "k int, a int, c int, b string")
    assert [r["a"] for r in rules.fix(df, Rule("a", "between", (1, 5)), "k").orderBy("k").collect()][1] == 3
    assert rules.fix(df, Rule("a", "between", (1, 5)), "k").where("a not between 1 and 5").isEmpty()
    assert [r["b"] for r in rules.fix(df, Rule("b", "in", ["x"]), "k").collect()] == ["x", "x"] and rules.fix(df, Rule("c", "not_null", 0), "k").where("c is null").isEmpty()
    top = spark.createDataFrame([("b", "x", 3), ("b", "zz", 1)], "column string, value string, count long")
    assert rules.regex_on_profile(top, "b", "x", 9).first()["verdict"] == "violated" and rules.regex_on_profile(top.where("value = 'x'"), "b", "x", 9).first()["verdict"] == "unknown"


def test_heavy_hitters_keep_their_bounds(spark):
    rng = random.Random(2)
    values = [f"v{min(int(rng.paretovariate(0.9)), 5000)}" for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "x string").repartition(5)
    true = {v: values.count(v) for v in set(values)}
    got = {r["value"]: r for r in evidence.space_saving(df, "x", 32).collect()}
    assert all(r["count"] - r["error"] <= true[v] <= r["count"] for v, r in got.items())
    assert all(v in got for v, n in true.items() if n > len(values) / 8)


def test_defects_and_releases(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit("abcdef").alias("s"))
    for kind in defects.KINDS:
        c = "s" if kind in ("truncate_strings", "corrupt_encoding", "placeholder_values") else "v"
        if kind in ("late_arrivals", "shift_hours"):
            continue
        out, told = defects.plant(df, defects.Defect(kind, c, rate=0.3), "k")
        assert told.count() > 0 and (kind in defects.OF_SCHEMA or out.count() >= 200), kind
    out, _ = defects.plant(df, defects.Defect("shuffle_column", "v"), "k")
    assert sorted(r["v"] for r in out.collect()) == list(range(0, 400, 2)) and out.where("v = 2 * k").count() < 30
    assert defects.same_however_partitioned(lambda n: spark.range(100, numPartitions=n), [1, 3, 7])
    with pytest.raises(ValueError):
        defects.plant(df, defects.Defect("odd", "v"), "k")
    assert releases.highest([]) == "public" and releases.derived_level(["internal"], "public") == "internal"
    assert releases.level_column([F.lit("public"), F.lit(None)]) is not None
    assert releases.leaks({"a": ["x"] * 30, "b": {"c": "me@x.com"}, "d": "fine"}) == ["$.a: 30 texts", "$.b.c: a personal value"]
    assert releases.release_decision({"a": "public", "b": "confidential", "c": "restricted"}, "internal", 10, 5) == {"a": "value", "b": "aggregate", "c": "withheld"}
    assert {r["s"] for r in releases.suppress_column(df.withColumn("s", F.when(F.col("k") < 3, "rare").otherwise("many")), "s", 5).collect()} == {"(suppressed)", "many"}


def test_names_and_layers(spark):
    assert proposals.name_evidence("o_custkey", "customer", "c_custkey") == 1.0 and proposals.name_evidence("o_comment", "region", "r_regionkey") < 0.6
    same, other = spark.range(10).select(F.col("id").alias("x")), spark.range(10).select((F.col("id") * 9).alias("x"))
    assert versions.first_changed_layer([("raw", lambda: same, lambda: same), ("clean", lambda: same, lambda: other)], "x") == "clean"
    assert versions.tree_similarity([("a", "b", 1.0)], [("b", "a", 0.5), ("b", "c", 0.5)]) == 0.5
    starts = []
    assert schedule.replay_with_failures(lambda n: starts.append(n) or (1 / 0 if n is not None else None), [1, 2]) == 3 and starts == [1, 2, None]


def test_readers(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"k": 1, "v": "a"}\n{"k": 1, "v": "a"}\n{"k": 2, "v": "b"}\n{"k": 3, "v":')
    assert schedule.read_events(spark, str(tmp_path / "e.json"), "k int, v string", ["k"]).count() == 2
    (tmp_path / "a.json").write_text('{"kind": "poison", "table": "t", "seq": 1}\n' * 2)
    assert schedule.read_answer_key(spark, str(tmp_path / "a.json")).count() == 1
    (tmp_path / "d.json").write_text('{"body": "x", "error": "bad", "attempts": 2}\nnot json\n')
    assert sorted(r["ok"] for r in schedule.read_dead_letters(spark, str(tmp_path / "d.json")).collect()) == [False, True]
    df = spark.createDataFrame([(k,) for k in range(5)], "seq long")
    assert [r["due_seconds"] for r in schedule.day_schedule(df, "seq", 2, 10.0).orderBy("seq").collect()] == [0.0, 5.0, 10.0, 15.0, 20.0]
