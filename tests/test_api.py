import pytest
from pyspark.sql import functions as F

from quillon import api, plugins
from quillon.operators import sampling, simulate, zones
from quillon.operators.generate import Table


def test_profile_save_load_query(spark, data, tmp_path):
    p = api.profile(spark, f"{data}/orders.parquet", name="orders")
    api.save(p, str(tmp_path / "p"))
    back = api.load(spark, str(tmp_path / "p"))
    assert api.query(back, "rows").first()[0] == 1500
    assert api.query(back, 'column("o_totalprice").nulls').first()[0] == 0
    assert back["times"].where("part = 'month'").count() == 12


def test_diff_and_gate(spark):
    a = spark.range(1000).select((F.col("id") % 50).cast("double").alias("x"), F.lit("u").alias("c"), F.lit(1).alias("gone"))
    b = a.select((F.col("x") + 40).alias("x"), F.when(F.col("x") < 25, "u").otherwise("w").alias("c"))
    kinds = {c["kind"] for c in api.diff(spark, a, b)}
    assert kinds >= {"column_removed", "distribution_shift", "range_change", "category_shift"}
    assert api.diff(spark, a, a) == [] and api.gate([]) and not api.gate(api.diff(spark, a, b))
    assert "row_count_change" in {c["kind"] for c in api.diff(spark, a, a.limit(400))}


def test_learn_generate_certify(spark, data):
    source = spark.read.parquet(f"{data}/lineitem.parquet").select("l_quantity", "l_returnflag", "l_shipdate")
    table = api.learn(spark, source, "lineitem", rows=3000)
    made = api.generate(spark, [table])["lineitem"]
    assert made.count() == 3000
    assert api.certify(spark, source, made, ["l_quantity"])["passed"]


def test_plan_and_reports():
    tables = [Table("line", 1, {"o": {"strategy": "foreign_key", "parent": "order"}}), Table("order", 1)]
    assert api.plan(tables) == ["order", "line"]
    with pytest.raises(ValueError):
        api.plan([Table("a", 1, {"x": {"parent": "b"}}), Table("b", 1, {"x": {"parent": "a"}})])
    assert "| a |" in api.report([{"a": "1|2"}], "md") and "&lt;" in api.report([{"a": "<"}], "html")


def test_check_and_links(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id bigint")
    child = spark.createDataFrame([(10, 1), (11, 2)], "id bigint, parent_id bigint")
    assert [(r["child"], r["parent"]) for r in api.links(spark, {"parent": parent, "child": child}).collect()] == [("child", "parent")]
    assert api.check(spark, child, {"rules": [{"column": "id", "kind": "max", "value": 10}]})[0]["rule"] == "max(id)"
    facts = api.star(child, {"parent": (parent, "id", "parent_id")}, [])["fact"]
    assert sorted(r["sk_parent"] for r in facts.collect()) == [1, 2]


def test_samples(spark):
    df = spark.range(1000).toDF("k")
    for how in ("random", "systematic", "head"):
        out = sampling.rows(df, "k", 50, how)
        assert out.count() == 50 and out.exceptAll(sampling.rows(df.repartition(5), "k", 50, how)).isEmpty()
    assert sampling.spread(df, "k", 20).count() == 20
    assert sampling.stratified(df.withColumn("g", F.col("k") % 3), ["g"], "k", 5).count() == 15
    assert 150 < sampling.share(df, "k", 0.2).count() < 250


def test_clock_changes(spark):
    df = spark.sql("select * from values (timestamp_ntz'2024-03-10 02:30:00'), (timestamp_ntz'2024-11-03 01:30:00'), (timestamp_ntz'2024-06-01 01:30:00') as v(t)")
    assert sorted(r["kind"] for r in zones.clock_changes(df, "t", "America/New_York", 2024, 2024).collect()) == ["nonexistent", "repeated"]


def test_simulators(spark):
    c = simulate.clickstream(spark, 200)
    assert c.select("entity").distinct().count() == 200 and c.exceptAll(simulate.clickstream(spark, 200).repartition(3)).isEmpty()
    assert simulate.readings(spark, 3, 100).count() == 300
    p = simulate.payments(spark, 5000, 100)
    assert 0 < p.where("fraud").count() < 100
    assert simulate.versions(spark, 100).groupBy("key").agg(F.max("version").alias("m")).where("m > 5").isEmpty()


def test_plugins():
    class Doubler:
        def detect(self, column):
            return column

    plugins.register("detector", "double", Doubler())
    assert plugins.get("detector", "double").detect(2) == 2
    assert plugins.conform("sink", Doubler()) and plugins.conform("nothing", 1)
    with pytest.raises(KeyError):
        plugins.get("sink", "absent")
    assert isinstance(plugins.contained(lambda: 1 / 0)[1], ZeroDivisionError)
