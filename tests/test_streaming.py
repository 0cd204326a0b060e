from datetime import datetime

from pyspark.sql import functions as F

from quillon.streaming import windows as w

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def test_stream_equals_batch(spark, data, tmp_path):
    src = tmp_path / "in"
    batch = spark.read.parquet(f"{data}/events.parquet")
    batch.repartition(4).write.parquet(str(src))
    stream = w.file_stream(spark, str(src), SCHEMA, "parquet", files=10)
    out = []
    w.run(w.tumbling(stream, "ts", "6h", "value", lateness="1000d"), lambda df, n: out.append(df.toPandas()), str(tmp_path / "cp"), "complete")
    want = w.tumbling(batch, "ts", "6h", "value").toPandas()
    got = out[-1]
    assert len(got) == len(want) and got["rows"].sum() == want["rows"].sum()


def test_sessions_end_at_the_gap(spark):
    at = lambda s: datetime(2026, 1, 1, 0, 0, s)
    df = spark.createDataFrame([(1, at(0), 1.0), (1, at(9), 1.0), (1, at(19), 1.0)], "k int, ts timestamp_ntz, v double")
    out = w.session(df, "ts", "10s", "v", ["k"]).orderBy("window_start").collect()
    assert [(r["rows"], r["window_end"]) for r in out] == [(2, at(19)), (1, at(29))]


def test_deduplication_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (None, 1), (None, 2)], "k int, t int")
    assert sorted(tuple(r) for r in w.deduplicate(df, ["k"], "t").collect() if r["k"]) == [(1, 3)]
    assert w.deduplicate(df, ["k"], "t").count() == 3


def test_decode_and_faults(spark):
    df = spark.createDataFrame([("a", '{"x": 1}'), ("b", '{"x": 2}'), ("c", "nonsense")], "key string, value string")
    out = {r["key"]: (r["status"], r["x"]) for r in w.decode(df, "x int").collect()}
    assert out == {"a": ("ok", 1), "b": ("ok", 2), "c": ("undecodable", None)}
    many = spark.range(1000).select(F.col("id").cast("string").alias("key"), F.lit('{"x": 12345678}').alias("value"))
    spoiled, answers = w.faults(many, "key", "value", 0.1, 0.1)
    assert spoiled.count() == 1000 + answers.where("kind = 'duplicate'").count()


def test_side_output(spark, tmp_path):
    spark.range(10).toDF("id").write.json(str(tmp_path / "in"))
    stream = w.file_stream(spark, str(tmp_path / "in"), "id bigint", files=10)
    good, bad = [], []
    w.side_output(stream, F.col("id") < 7, lambda d: good.append(d.count()), lambda d: bad.append(d.count()), str(tmp_path / "cp"))
    assert sum(good) == 7 and sum(bad) == 3


def test_due_times(spark):
    df = w.due_times(spark.range(40).toDF("seq"), "seq", 10.0, [(1.0, 2.0, 2.0)])
    got = {r["seq"]: round(r["due_seconds"], 6) for r in df.collect()}
    assert got[0] == 0 and got[10] == 1.0 and got[20] == 1.5 and got[30] == 2.0 and got[35] == 2.5


def test_cloud_events(spark):
    e = w.events({"t": spark.range(2).toDF("id")}, {"t": "id"})
    assert [r["seq"] for r in e.orderBy("seq").collect()] == [0, 1]
    assert '"specversion":"1.0"' in w.cloud_events(e, "s").first()[0]
