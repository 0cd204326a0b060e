"""Sinks: DataFrames to files, scripts, databases and landing folders."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.StructType, T.MapType)
#: Rows that a driver-side workbook may have.
SHEET_ROWS = 1_000_000
CDM_TYPES = {"bigint": "int64", "int": "int64", "smallint": "int64", "tinyint": "int64", "double": "double", "float": "double", "string": "string", "boolean": "boolean", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime"}


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without them."""
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, NESTED) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, rows_per_file: int = 0) -> None:
    """csv, tsv, json, jsonl, parquet, orc, xml, or an installed lakehouse format."""
    out = flat(df) if kind in ("csv", "tsv") else df
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if kind in ("csv", "tsv"):
        writer.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    elif kind in ("json", "jsonl"):
        writer.json(path)
    elif kind == "xml":
        writer.option("rowTag", "row").format("xml").save(path)
    else:
        writer.format(kind).save(path)


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    for name, df in tables.items():
        write(df, f"{folder.rstrip('/')}/{name}", kind, mode)


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """One INSERT for each row, quoted for ANSI databases: a text column `sql`."""

    def literal(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            text = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
        else:
            text = F.upper(c.cast("string")) if isinstance(f.dataType, T.BooleanType) else c.cast("string")
        return F.coalesce(text, F.lit("NULL"))

    fields = flat(df).schema.fields
    head = f"INSERT INTO {table} ({', '.join(f.name for f in fields)}) VALUES ("
    return flat(df).select(F.concat(F.lit(head), F.concat_ws(", ", *map(literal, fields)), F.lit(");")).alias("sql"))


def create_statement(df: DataFrame, table: str, keys: list[str] = ()) -> str:
    types = {"string": "TEXT", "double": "DOUBLE PRECISION", "float": "REAL", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
    body = [f"{n} {types.get(t, t.upper())}" for n, t in flat(df).dtypes]
    return f"CREATE TABLE {table} ({', '.join(body + ([f'PRIMARY KEY ({", ".join(keys)})'] if keys else []))});"


def write_sql(df: DataFrame, table: str, path: str) -> None:
    df.sparkSession.createDataFrame([(create_statement(df, table),)], "sql string").unionByName(insert_statements(df, table)).write.text(path)


def write_arrow(df: DataFrame, path: str) -> None:
    """One Feather file; for tables that the driver can hold."""
    import pyarrow.feather as feather

    feather.write_feather(df.toArrow(), path)


def write_workbook(tables: dict[str, DataFrame], path: str) -> None:
    """One worksheet for each table of a million rows at most."""
    import pandas as pd

    with pd.ExcelWriter(path) as book:
        for name, df in tables.items():
            if df.limit(SHEET_ROWS + 1).count() > SHEET_ROWS:
                raise ValueError(f"{name} has too many rows for a worksheet")
            flat(df).toPandas().to_excel(book, sheet_name=name[:31], index=False)


def write_duckdb(df: DataFrame, path: str, table: str) -> None:
    import duckdb

    with duckdb.connect(path) as c:
        c.register("incoming", df.toArrow())
        c.execute(f'create or replace table "{table}" as select * from incoming')


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **properties: str) -> None:
    flat(df).write.jdbc(url, table, mode=mode, properties=properties)


def landing_path(template: str, table: str, day: date, batch: int = 0) -> str:
    """A template of {table}, {yyyy}, {mm}, {dd}, {batch}."""
    return template.format(table=table, yyyy=f"{day:%Y}", mm=f"{day:%m}", dd=f"{day:%d}", batch=f"{batch:06d}")


def land(tables: dict[str, DataFrame], template: str, day: date, kinds: dict[str, str] | None = None, batch: int = 0) -> list[str]:
    """Each table in its place for the day, in its format."""
    out = []
    for name, df in tables.items():
        path = landing_path(template, name, day, batch)
        write(df, path, (kinds or {}).get(name, "parquet"), mode="overwrite")
        out.append(path)
    return out


def provenance(spark, path: str) -> DataFrame:
    """Of each file below a path: path, length, sha256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def fan_out(df: DataFrame, sinks: list) -> list[Exception | None]:
    """One computation to several sinks (functions of a DataFrame); one that fails doesn't stop the others."""
    kept, out = df.persist(), []
    for sink in sinks:
        try:
            sink(kept)
            out.append(None)
        except Exception as error:  # reported to the caller, per sink
            out.append(error)
    kept.unpersist()
    return out


def cdm_model(tables: dict[str, DataFrame], name: str) -> str:
    """The model document of a folder of entities."""
    entities = [{"$type": "LocalEntity", "name": t, "attributes": [{"name": c, "dataType": CDM_TYPES.get(k, "string")} for c, k in df.dtypes]} for t, df in tables.items()]
    return json.dumps({"name": name, "version": "1.0", "entities": entities}, indent=2, sort_keys=True)


def write_cdm(tables: dict[str, DataFrame], folder: str, name: str) -> None:
    for t, df in tables.items():
        flat(df).write.mode("overwrite").csv(f"{folder}/{t}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(cdm_model(tables, name),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/model")
