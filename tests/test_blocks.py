"""Pairs of large and overlapping blocks, and lags across ranges, against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import resolve, windows
from quillon.plans import catalog


def test_query_keeps_large_blocks(spark, tmp_path):
    n = 1_300
    spark.range(n).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit("A").alias("c_mktsegment"), F.lit(10.0).alias("c_acctbal")).write.parquet(f"{tmp_path}/customer.parquet")
    pairs = catalog.QUERIES["blocked_pairs"](spark, str(tmp_path))
    row = pairs.agg(F.count("*").alias("n"), F.count_distinct("a", "b").alias("d"), F.count_if(F.col("a") < F.col("b")).alias("ordered")).first()
    assert row["n"] == row["d"] == row["ordered"] == n * (n - 1) // 2


def test_pairs_of_several_blocks_come_once(spark, monkeypatch):
    monkeypatch.setattr(resolve, "GROUP", 7)
    rows = [(k, "abcd"[k % 4] * 3 + "xyz"[k % 3] * 3, str(k % 5)) for k in range(60)] + [(3, "zzz", "9")]
    df = spark.createDataFrame(rows, "id bigint, name string, code string")
    pairs, left = resolve.candidate_pairs(df, "id", [("name", "ngram"), ("code", "key")], max_block=18)
    keys = {}
    for r in df.select("id", F.concat(resolve.block_keys("name", "ngram"), resolve.block_keys("code", "key")).alias("k")).collect():
        for k in r["k"]:
            keys.setdefault(k, set()).add(r["id"])
    want = {(a, b) for ids in keys.values() if len(ids) <= 18 for a in ids for b in ids if a < b}
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r["block"] for r in left.collect()} == {k for k, ids in keys.items() if len(ids) > 18}


@pytest.mark.parametrize("lag", [1, 3, 40])
def test_lag_across_ranges(spark, lag):
    rng = np.random.default_rng(5)
    df = pd.DataFrame({"g": [None if k % 4 == 3 else "ab"[k % 4 % 2] for k in range(900)], "t": rng.permutation(900), "x": rng.normal(50, 1, 900).cumsum()})
    s = spark.createDataFrame(df.astype({"g": object}), "g string, t bigint, x double").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    got = {r["g"]: (r["n"], r["autocorrelation"]) for r in windows.lag_autocorrelation(s, "x", "t", lag, ["g"]).collect()}
    plan = windows.lag_autocorrelation(s, "x", "t", lag, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    whole = windows.lag_autocorrelation(s, "x", "t", lag).first()
    spark.conf.set("spark.sql.shuffle.partitions", before)

    def known(x):
        e = x - x.mean()
        return len(x), (e[lag:] * e[:-lag]).sum() / (e * e).sum()

    for g, part in df.sort_values("t").groupby("g", dropna=False):
        n, r = known(part["x"].to_numpy())
        k = None if pd.isna(g) else g
        assert got[k][0] == n and got[k][1] == pytest.approx(r, abs=1e-9)
    n, r = known(df.sort_values("t")["x"].to_numpy())
    assert whole["n"] == n and whole["autocorrelation"] == pytest.approx(r, abs=1e-9)
    assert "_p" in plan  # groups are worked through in ranges
