"""Exact quantiles from counts in ranges, against one sort; no aggregate keeps all values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import compare, joint, profile, ranges, univariate


@pytest.fixture
def many(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def no_percentile(monkeypatch):
    def refuse(*_):
        raise AssertionError("F.percentile keeps every distinct value in one task")

    monkeypatch.setattr(F, "percentile", refuse)


def numbers(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(3_000) < 0.4, 7.0, rng.normal(0, 50, 3_000).round(2))
    return x, spark.createDataFrame([(float(v),) for v in x], "x double").unionByName(spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double"))


@pytest.mark.parametrize("some", [1, 2, 3, 7, 3_000])
def test_quantiles_equal_a_sort(many, no_percentile, some):
    x, _ = numbers(many)
    df = many.createDataFrame([(float(v), int(v > 0)) for v in x[:some]], "x double, y int")
    grid = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    out = {r["column"]: r["q"] for r in ranges.quantiles(df, ["x", "y"], grid).collect()}
    assert np.allclose(out["x"], np.quantile(x[:some], grid), atol=1e-9)
    assert np.allclose(out["y"], np.quantile((x[:some] > 0).astype(int), grid), atol=1e-9)


def test_fit_keeps_no_values(many, no_percentile):
    x, df = numbers(many)
    out = {r["family"]: r["ks"] for r in univariate.fit(df, "x").collect()}
    q, p = np.quantile(x, np.arange(1, 100) / 100), np.arange(1, 100) / 100
    assert out["uniform"] == pytest.approx(np.abs((q - x.min()) / (x.max() - x.min()) - p).max(), abs=1e-9)
    assert univariate.outliers_iqr(df, "x").first()["n"] == 3_000
    assert joint.quantile_codes(df, "x").count() == 3_003


def test_profile_keeps_no_values(many, no_percentile):
    x, df = numbers(many)
    df = df.withColumn("big", F.lit(2**60) + F.monotonically_increasing_id() % 3).withColumn("none", F.lit(None).cast("int"))
    out = {r["column"]: r for r in profile.numeric_profile(df).collect()}
    assert np.allclose([out["x"][p] for p in ("p25", "p50", "p75")], np.quantile(x, [0.25, 0.5, 0.75]))
    assert out["x"]["distinct"] == len(set(x)) + 1 and out["big"]["distinct"] == 3 and out["none"]["distinct"] == 0 and out["none"]["p50"] is None


def test_gap_keeps_no_values(many, no_percentile):
    x, df = numbers(many)
    other = df.withColumn("x", F.col("x") * 2 + 1)
    gap = np.abs(np.quantile(x, [0.05, 0.25, 0.5, 0.75, 0.95]) - np.quantile(2 * x + 1, [0.05, 0.25, 0.5, 0.75, 0.95])).max() / (x.max() - x.min())
    assert compare.quantile_gap(df, other, "x").first()["gap"] == pytest.approx(gap, abs=1e-9)


def test_fidelity_keeps_no_values(many, no_percentile):
    x, df = numbers(many)
    assert compare.fidelity_numeric(df, df, ["x"]).first()["score"] == pytest.approx(100)
