from pyspark.sql import functions as F

from quillon.operators import chaos, multivariate, quality, resolve, windows
from quillon.operators.generate import Stream


def test_repair(spark):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id int, x int")
    out = {r["id"]: r["x"] for r in quality.repair(df, "x", 0, 10, "id").collect()}
    assert out[1] == 5 and 0 <= out[2] <= 10 and out[3] is None
    swapped = quality.repair_order(spark.createDataFrame([(2, 1)], "a int, b int"), "a", "b").first()
    assert (swapped["a"], swapped["b"]) == (1, 2)


def test_center_clusters(spark):
    scored = spark.createDataFrame([(1, 2, 0.99), (2, 3, 0.95), (3, 4, 0.9)], "a bigint, b bigint, score double")
    out = {r["id"]: r["center"] for r in resolve.center_clusters(scored).collect()}
    assert out[1] == out[2] == 1 and out[3] == out[4] == 3


def test_periodicity(spark):
    df = spark.range(240).select(F.col("id").alias("t"), F.sin(F.col("id") * (2 * 3.141592653589793 / 24)).alias("x"))
    power = {r["period"]: r["power"] for r in windows.periodicity(df, "x", "t", [7, 12, 24]).collect()}
    assert power[24] > 0.99 and power[7] < 0.01


def test_outliers_and_angle(spark):
    s = Stream(1, "m", "x")
    df = spark.range(1000).select("id", s.normal(F.col("id"), "a").alias("a"), s.normal(F.col("id"), "b").alias("b"), s.normal(F.col("id"), "c").alias("c"))
    bad = df.withColumn("a", F.when(F.col("id") < 50, 30.0).otherwise(F.col("a")))
    out = multivariate.outliers(bad, ["a", "b"], "id")
    assert out.where("id < 50 and outlier").count() == 50 and out.where("id >= 50 and outlier").count() < 80
    assert multivariate.subspace_angle(df, df, ["a", "b", "c"], 1) < 1
    one, two = df.withColumn("cohort", F.when(F.col("a") > 0, 1).otherwise(0)), df.withColumn("cohort", F.when(F.col("a") > 0, 8).otherwise(9))
    assert {r["cohort_a"]: r["cohort_b"] for r in multivariate.match_cohorts(one, two, ["a", "b"]).collect()} == {1: 8, 0: 9}


def test_more_chaos(spark):
    assert chaos.damaged_bytes(b"abc", "bom").startswith(b"\xef\xbb\xbf") and len(chaos.damaged_bytes(b"abcdef", "truncate")) < 6
    df = spark.range(500).select("id", F.timestamp_seconds(F.col("id") * 60).alias("t"), F.lit(1.0).alias("x"))
    for kind in ("spike", "drop", "freeze", "gap", "shift"):
        out, answers = chaos.anomalies(df, "id", "t", "x", kind, 0.1)
        assert 20 < answers.count() < 90
        assert out.count() == 500 - (answers.count() if kind == "gap" else 0)
