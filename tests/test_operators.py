from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quillon.operators import chaos, compare, generate, joint, privacy, profile, quality, relational, resolve, univariate, windows
from quillon.operators.generate import Stream, Table
from quillon.operators.quality import Rule
from quillon.plans.contracts import Contract, compatible, first_bad, mutation_test
from quillon.plans.paths import ask


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_star_known_answers(spark):
    customer = spark.createDataFrame([(3, "c", "west"), (1, "a", "east"), (2, "b", "east")], "customer_id bigint, name string, region string")
    region = spark.createDataFrame([("east", "E"), ("west", "W")], "region string, label string")
    dim = relational.dimension(customer, "customer_id", "customer", [(region, "region", "region", "r_")])
    assert sorted(rows(dim.select("sk_customer", "customer_id", "r_label"))) == [(1, 1, "E"), (2, 2, "E"), (3, 3, "W")]
    order = spark.createDataFrame([(10, 1), (11, None), (12, 9)], "order_id bigint, customer_id bigint")
    fact = relational.fact(order, [(dim, "customer_id", "customer_id", "sk_customer")])
    assert relational.fact_orphans(fact, "customer_id", "sk_customer").first()[0] == 1


def test_null_keys(spark):
    child = spark.createDataFrame([(1, 1), (2, None), (3, 7)], "id int, fk int")
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    assert [r[0] for r in rows(relational.orphans(child, "fk", parent, "k"))] == [3]
    assert sorted(r[0] for r in rows(relational.integrity_violations(child, "fk", parent, "k"))) == [2, 3]
    nulls = parent.unionByName(spark.createDataFrame([(None,)], "k int"))
    assert [r[0] for r in rows(relational.integrity_violations(child, "fk", nulls, "k"))] == [3]


def test_single_match_is_asserted(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    assert relational.left_join(a, b, {"k": "k"}).count() == 2
    with pytest.raises(Exception, match="more than one row"):
        relational.left_join(a, b, {"k": "k"}, single=True).collect()


def test_children_keep_integers(spark):
    orders = spark.createDataFrame([(1,), (2,), (3,)], "o int")
    lines = spark.createDataFrame([(1, 1), (1, 2), (2, 12)], "o int, q bigint")
    out = relational.children(orders, "o", lines, "o", "q", "sum", "total")
    assert sorted(rows(out)) == [(1, 3), (2, 12), (3, 0)] and dict(out.dtypes)["total"] == "bigint"


def test_reconcile(spark):
    s = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "g string, x double")
    t = spark.createDataFrame([("a", 3.0), ("c", 1.0)], "g string, x double")
    out = {(r["g"], r["measure"]): (r["side"], r["ok"]) for r in relational.reconcile(s, t, ["g"], [("sum", "x"), ("count", "*")]).collect()}
    assert out["a", "sum(x)"] == ("both", True) and out["a", "count(*)"] == ("both", False)
    assert out["b", "sum(x)"] == ("source", False) and out["c", "sum(x)"] == ("target", False)


def test_nearest(spark):
    s = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    g = spark.createDataFrame([(1, 1.0), (2, 9.0)], "id int, x double")
    assert sorted(round(r["distance"], 6) for r in relational.nearest(s, g, ["x"], "id").collect()) == [0.2, 0.2]


def test_fd_known_answers(spark):
    df = spark.createDataFrame([(g, v) for g in range(200) for v in (0, 0, 1, 1)], "a int, b int")
    r = joint.functional_dependency(df, ["a"], "b").first()
    assert r["confidence"] == 0.5 and r["violating_groups"] == 200


def test_profiles_of_odd_values(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (-0.0,), (0.0,)], "x double")
    r = profile.numeric_profile(df).first()
    assert (r["nulls"], r["nans"], r["infinite"], r["distinct"], r["min"], r["max"]) == (1, 1, 1, 3, 0.0, 1.0)
    empty = profile.numeric_profile(df.where("false")).first()
    assert empty["rows"] == 0 and empty["mean"] is None


def test_sketches_merge(spark):
    df = spark.range(20_000).select(F.col("id").cast("double").alias("x"))
    parts = [profile.bounded_profile(df.where(F.col("id") % 3 == k) if False else df.where(F.pmod(F.col("x"), F.lit(3.0)) == k), ["x"]) for k in range(3)]
    r = profile.read_sketches(profile.merge_profiles(*parts)).first()
    assert r["rows"] == 20_000 and abs(r["distinct"] / 20_000 - 1) < 0.03 and abs(r["p50"] / 10_000 - 1) < 0.03


def test_windows(spark):
    ts = [datetime(2026, 1, 1, h) for h in (0, 1, 4, 4, 5)]
    df = spark.createDataFrame([(t, v) for t, v in zip(ts, [1.0, 1.0, 1.0, 2.0, None], strict=True)], "ts timestamp_ntz, v double")
    g = windows.gaps(df, "ts", "1h").first()
    assert (g["rows"], g["missing"], g["gaps"], g["duplicates"]) == (5, 2, 1, 1)
    run = windows.stuck_runs(df, "v", "ts", 2).collect()
    assert [(r["value"], r["length"]) for r in run] == [(1.0, 3)]
    assert windows.lag_autocorrelation(df.withColumn("v", F.lit(2.0)), "v", "ts", 1).first()["autocorrelation"] == 1.0


def test_survivor_rules(spark):
    df = spark.createDataFrame([(1, 1, "aa", None), (1, 2, "b", 5), (1, 3, "b", 4)], "k int, o int, s string, n int")
    r = windows.survivor(df, ["k"], {"s": "longest", "n": "first"}, "o").first()
    assert (r["s"], r["n"]) == ("aa", 5)
    assert windows.survivor(df, ["k"], {"s": "most_common"}, "o").first()["s"] == "b"


def test_compare(spark):
    a = spark.range(1000).select((F.col("id") % 10).cast("double").alias("x"))
    b = a.select((F.col("x") + 5).alias("x"))
    assert compare.ks(a, a, "x").first()["ks"] == 0 and compare.ks(a, b, "x").first()["ks"] == 0.5
    assert compare.psi_numeric(a, a, "x").first()["psi"] == 0 and compare.psi_numeric(a, b, "x").first()["psi"] > 1
    point = a.select(F.lit(1.0).alias("x"))
    assert compare.psi_numeric(point, point, "x").first()["psi"] == 0
    assert compare.version_bump(["column_added", "range_change"]) == "minor" and compare.version_bump([]) == "none"
    assert compare.drift_monitor(a, b, ["x"], [])[0]["flagged"]


def test_quality(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.0), (2, None, float("nan"))], "id int, s string, x double")
    out = {r["rule"]: r["failures"] for r in quality.check(df, [Rule("s", "not_null"), Rule("id", "unique"), Rule("s", "in", ["a"]), Rule("id", "min", 2)]).collect()}
    assert out == {"not_null(s)": 1, "unique(id)": 2, "in(s)": 1, "min(id)": 1}
    assert {r.name for r in quality.infer_rules(df)} >= {"not_null(id)", "min(id)", "in(s)"}
    shown = quality.failing_rows(df, [Rule("id", "min", 2)], "id", hidden=("s",)).first()
    assert shown["s"] == "***"


def test_small_slices_are_pooled(spark):
    df = spark.createDataFrame([("a",)] * 40 + [("b",)] * 5 + [("c",)] * 4, "g string")
    assert sorted((r["slice"], r["rows"]) for r in quality.slices(df, ["g"]).collect()) == [("(small slices)", 9), ("a", 40)]
    alone = df.where("g <> 'c'")
    assert [r["slice"] for r in quality.slices(alone, ["g"]).collect()] == ["a"]


def test_privacy(spark):
    df = spark.createDataFrame([("1", 30, "x"), ("1", 30, None), ("2", 40, "x")], "zip string, age int, dx string")
    r = privacy.k_anonymity(df, ["zip", "age"]).first()
    assert (r["k"], r["groups"], r["singletons"]) == (1, 2, 1)
    assert privacy.l_diversity(df, ["zip"], "dx").first()["l"] == 1
    counts = spark.createDataFrame([("a", 50), ("b", 12), ("c", 3), ("d", 2)], "c string, n bigint")
    assert sorted(rows(privacy.suppress(counts, "c", "n", 10))) == [("a", 50), ("other", 17)]
    assert rows(privacy.suppress(counts.where("n < 4"), "c", "n", 10)) == []
    masked = privacy.mask_tables({"t": df, "u": df}, {"t": {"zip": "identifier"}, "u": {"zip": "identifier"}}, b"k")
    assert masked["t"].select("zip").distinct().exceptAll(masked["u"].select("zip").distinct()).isEmpty()


def test_resolution(spark):
    names = ["robert smith", "robert smyth", "mary jones", "rob brown", "mary jones", None]
    df = spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
    pairs, _ = resolve.candidate_pairs(df, "id", [("name", "phonetic")])
    scored = resolve.score(df, "id", pairs, {"name": ("jaro_winkler", 1.0)})
    clusters = dict(rows(resolve.clusters(df, "id", scored, 0.9)))
    assert clusters[1] == 0 and clusters[4] == 2 and clusters[3] == 3 and clusters[5] == 5
    chain = spark.createDataFrame([(i + 1, i) for i in range(60)], "a bigint, b bigint")
    assert {r[1] for r in rows(resolve.connected(chain))} == {0}
    _, skipped = resolve.candidate_pairs(df, "id", [("name", "prefix")], max_block=1)
    assert skipped.count() > 0


def test_generation_ignores_partitions(spark):
    spec = [Table("t", 500, {"a": {"strategy": "distribution", "family": "gamma", "params": {"k": 2.0, "theta": 1.0}}, "b": {"strategy": "uuid"}, "c": {"strategy": "foreign_key", "parent": "t", "law": "pareto"}, "d": {"strategy": "string", "length": 5}, "e": {"strategy": "correlated", "column": "a"}, "f": {"strategy": "self_reference"}})]
    one, many = generate.generate(spark, spec, partitions=1)["t"], generate.generate(spark, spec, partitions=7)["t"]
    assert one.exceptAll(many).isEmpty()
    assert one.select("b").distinct().count() == 500
    assert one.where("c < 1 or c > 500").isEmpty()


def test_copula_reorders_only(spark):
    df = spark.range(400).select("id", Stream(1, "t", "a").normal(F.col("id")).alias("a"), Stream(1, "t", "b").uniform(F.col("id")).alias("b"))
    out = generate.copula(df, "id", "a", "b", 0.8)
    assert out.select("b").exceptAll(df.select("b")).isEmpty()
    assert joint.spearman(out, "a", "b").first()["rho"] > 0.6


def test_calendar():
    assert generate.easter(2024) == date(2024, 3, 31) and generate.federal_holidays(2023)["Thanksgiving"] == date(2023, 11, 23)
    assert generate.observed(date(2021, 7, 4)) == date(2021, 7, 5)


def test_chaos_answers(spark):
    df = spark.range(1000).select("id", F.col("id").cast("double").alias("x"))
    out, answers = chaos.inject(df, "id", "x", "null", 0.1)
    assert out.where("x is null").count() == answers.count() > 50
    assert chaos.repeated(df, "id", 0.5).count() > 1300 and chaos.volume(df, 0).isEmpty() and chaos.volume(df, 3).count() == 3000


def test_univariate(spark):
    df = spark.range(1, 2001).select((F.lit(1.0) / F.col("id")).alias("x"))
    assert abs(univariate.hill(df, "x").first()["alpha"] - 1) < 0.3
    normal = spark.range(5000).select(Stream(3, "u", "x").normal(F.col("id")).alias("x"))
    assert univariate.fit(normal, "x").first()["family"] == "normal"
    assert univariate.benford(spark.range(1, 1000).select(F.pow(F.lit(1.02), "id").alias("x")), "x").first()["mad"] < 0.01


def test_paths_and_contracts(spark):
    columns = spark.createDataFrame([("c", 10, 2)], "column string, rows int, null_count int")
    links = spark.createDataFrame([("a", "b", "correlation", 0.8), ("x", "y", "foreign_key", 1.0)], "a string, b string, kind string, r double")
    p = {"columns": columns, "relationships": links}
    assert ask(p, "rows").first()[0] == 10 and ask(p, 'column("c").null_count').first()[0] == 2
    assert ask(p, 'relationship("b","a").r').first()[0] == 0.8 and ask(p, 'relationship("y","x").r').isEmpty()
    with pytest.raises(ValueError):
        ask(p, "__import__('os')")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, s string")
    c = Contract.of({"columns": {"id": "bigint"}, "rules": [{"column": "s", "kind": "in", "value": ["a", "b"]}, {"column": "id", "kind": "unique"}], "dependencies": [{"from": ["id"], "to": "s"}]})
    assert c.findings(df) == [] and all(mutation_test(df, c, "id").values())
    bad = df.withColumn("s", F.lit("z"))
    assert first_bad([df, df, bad, bad], c) == 2 and first_bad([df], c) is None
    assert not compatible(df, df.drop("s"), "forward") and compatible(df, df.drop("s"), "backward")
