from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.sources import readers, sinks


def test_csv_keeps_identifiers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("zip,amount,n,day,flag\n01234,1.5,7,2024-01-01,true\n12345,2,8,2024-01-02,false\n")
    df = readers.resolve(spark, str(tmp_path / "x.csv"))
    assert dict(df.dtypes) == {"zip": "string", "amount": "double", "n": "bigint", "day": "date", "flag": "boolean"}
    assert dict(readers.read_csv(spark, str(tmp_path / "x.csv"), types={"n": "string"}).dtypes)["n"] == "string"


def test_documents_become_tables(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"id": 1, "who": {"name": "a"}, "items": [{"p": 1, "tags": ["x", "y"]}, {"p": 2, "tags": []}]}, {"id": 2, "who": null, "items": []}]')
    tables = readers.flatten(readers.resolve(spark, str(tmp_path / "d.json")), "doc", "id")
    assert set(tables) == {"doc", "doc__items", "doc__items__tags"}
    assert tables["doc"].count() == 2 and "who__name" in tables["doc"].columns
    assert sorted(tuple(r) for r in tables["doc__items"].select("_parent_id", "_ordinal", "p").collect()) == [(1, 0, 1), (1, 1, 2)]
    assert tables["doc__items__tags"].count() == 2


def test_xml_arrow_duckdb(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><item><a>1</a></item><item><a>2</a></item></r>")
    assert readers.resolve(spark, str(tmp_path / "a.xml"), record="//item").count() == 2
    df = spark.range(5).select("id", F.col("id").cast("string").alias("s"))
    sinks.write_arrow(df, str(tmp_path / "a.arrow"))
    assert readers.resolve(spark, str(tmp_path / "a.arrow")).exceptAll(df).isEmpty()
    sinks.write_duckdb(df, str(tmp_path / "a.duckdb"), "t")
    assert readers.resolve(spark, str(tmp_path / "a.duckdb"), table="t", rows="2").exceptAll(df).isEmpty()


@pytest.mark.parametrize("kind", ["parquet", "csv", "tsv", "jsonl", "orc"])
def test_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id bigint, s string")
    sinks.write(df, str(tmp_path / kind), kind)
    back = readers.resolve(spark, str(tmp_path / kind), format=kind) if kind != "orc" else spark.read.orc(str(tmp_path / kind))
    assert back.select("id", "s").exceptAll(df).isEmpty() and back.count() == 2


def test_sql_script_runs(spark, tmp_path):
    df = spark.createDataFrame([(1, "it's", [1, 2]), (2, None, None)], "id bigint, s string, a array<int>")
    with duckdb.connect() as c:
        c.execute(sinks.create_statement(df, "t", ["id"]))
        for r in sinks.insert_statements(df, "t").collect():
            c.execute(r["sql"])
        assert c.execute("select count(*), max(s), max(a) from t").fetchall() == [(2, "it's", "[1,2]")]


def test_folder_landing_and_provenance(spark, tmp_path):
    df = spark.range(3).toDF("id")
    paths = sinks.land({"t": df}, str(tmp_path) + "/{table}/{yyyy}-{mm}-{dd}", date(2024, 2, 3))
    assert paths == [f"{tmp_path}/t/2024-02-03"] and spark.read.parquet(paths[0]).count() == 3
    assert sinks.provenance(spark, paths[0]).where(F.length("sha256") == 64).count() >= 1
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.jsonl").write_text('{"x": 1}\n')
    (tmp_path / "f" / "b.jsonl").write_text('{"x": 2}\n')
    frames = readers.folder(spark, str(tmp_path / "f"))
    assert set(frames) == {"a", "b"} and readers.one_table(frames)
    assert readers.within_budget(spark, paths[0], rows=3) and not readers.within_budget(spark, paths[0], rows=2)


def test_fan_out_contains_failures(spark):
    seen = []

    def broken(df):
        raise RuntimeError("no")

    out = sinks.fan_out(spark.range(3), [lambda df: seen.append(df.count()), broken, lambda df: seen.append(df.count())])
    assert seen == [3, 3] and isinstance(out[1], RuntimeError) and out[0] is None


def test_cdm(spark, tmp_path):
    sinks.write_cdm({"t": spark.range(2).toDF("id")}, str(tmp_path / "cdm"), "m")
    assert '"int64"' in "".join(r[0] for r in spark.read.text(str(tmp_path / "cdm" / "model")).collect())
