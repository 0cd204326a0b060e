"""Orders over whole tables, in plans whose ranges are merged and drawn differently from one use to the next."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import relational
from quillon.operators.defects import Defect, plant


@pytest.fixture
def uneven(spark):
    """Adaptive plans that merge narrow branches into fewer partitions than wide ones."""
    changed = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_numbers_are_dense(uneven):
    n = 30_000
    df = uneven.range(n).select((F.col("id") * 7919 % n).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("wide"))
    out, want = relational.dimension(df, "k", "k"), df.select((F.col("k") + 1).alias("sk_k"), "k", "wide")
    assert out.exceptAll(want).count() == want.exceptAll(out).count() == 0


def test_shuffled_column_keeps_all_rows(uneven):
    n = 30_000
    df = uneven.range(n).select(F.col("id").alias("k"), (F.col("id") * 7919 % n / 2).alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    out = plant(df, Defect("shuffle_column", "v", details={"order": ["x"]}), "k")[0]
    want = df.select((F.col("x") * 2).cast("long").alias("at"), "k").join(df.select(F.col("k").alias("at"), "v"), "at").select("k", "v")
    assert out.count() == n and out.select("k", "v").exceptAll(want).count() == 0
