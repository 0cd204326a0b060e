"""What operators leave with an executor for the stages after them, and what they compute once only."""

import gc
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import common, exact_dedup, near_dedup, packing


@pytest.fixture
def docs(spark):
    return spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("a text of the group "), (F.col("id") % 7).cast("string")).alias("text"), F.lit("en").alias("lang"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def private_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024


def test_workers_give_back_what_a_task_has_freed(spark):
    pins = []

    def task(batches):
        for batch in batches:
            held = [bytes(600) for _ in range(200_000)]
            pins.append(bytes(600))
            del held
            yield batch

    gc.collect()
    before = private_mb()
    assert list(common.tidy(task)(iter([1, 2]))) == [1, 2]
    assert private_mb() - before < 60 and len(pins) == 2

    def odd(batches):
        for batch in batches:
            yield batch.filter(np.array(batch.column("id").to_pylist()) % 2 == 1)

    assert [r.id for r in spark.range(10).mapInArrow(common.tidy(odd), "id long").orderBy("id").collect()] == [1, 3, 5, 7, 9]


def test_packing_plan_starts_no_python_workers(docs):
    out = packing.pack(docs)
    assert "ExistingRDD" not in plan(out) and out.count() == 40
    assert packing.pack(docs.limit(0)).count() == 0


def test_exact_dedup_has_one_python_worker_a_task(docs, monkeypatch):
    plans = []
    monkeypatch.setattr(exact_dedup, "cut", lambda df: plans.append(plan(df)) or common.cut(df))
    out = exact_dedup.exact_duplicates(docs)
    assert out.count() == 40 and out.where("kept").count() == 7
    assert max(len(re.findall(r"(?:MapInPandas|FlatMapGroupsInPandas) ", p)) for p in [*plans, plan(out)]) == 1


def test_stages_read_without_direct_buffers(spark, docs):
    was = spark.conf.get(common.VECTORED, None)
    try:
        for stage in ("language_id", "exact_dedup", "near_dedup", "packing"):
            spark.conf.unset(common.VECTORED)
            dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
            assert spark.conf.get(common.VECTORED) == "false"
        spark.conf.set(common.VECTORED, "true")
        common.cut(docs)
        assert spark.conf.get(common.VECTORED) == "true"
    finally:
        spark.conf.unset(common.VECTORED)
        if was is not None:
            spark.conf.set(common.VECTORED, was)


def test_lists_of_the_index_are_named_once_a_turn(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(near_dedup, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or common.cut(df))
    first = spark.createDataFrame([(v, 3, cid, True, 9, 1) for v, cids in ((1, (1, 2, 3)), (2, (1, 2)), (3, (3, 4, 5))) for cid in cids], "v long, df long, cid long, minor boolean, n int, rank int")
    of = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)], "cid long, c long")
    open_, pairs, rows = near_dedup.NearDuplicates.mixed_lists(None, first, of, 5)
    assert {(r.v, r.cid, r.c, r.most) for r in open_.collect()} == {(3, 3, 1, 4), (3, 4, 4, 4), (3, 5, 4, 4)} and (pairs, rows) == (3, 3)
    assert sum(len(re.findall(r"Join Inner, \(cid#", p)) for p in plans) == 1
