"""Sources: files, folders, databases and rows to DataFrames."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

IDENTIFIER_NAMES = ("zip", "postal", "phone", "account", "acct", "ssn", "code", "number", "no", "id")
FORMATS = {".parquet": "parquet", ".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".orc": "orc", ".xml": "xml", ".arrow": "arrow", ".feather": "arrow", ".duckdb": "duckdb"}


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, quote: str = '"', types: dict[str, str] | None = None, protect: bool = True) -> DataFrame:
    """CSV read as text, then cast to what every value fits: bigint, double, date, timestamp, boolean, else string.

    Digits that look like identifiers stay text: any leading zero, or one width under a name like zip or account. types
    overrides. One aggregation decides all columns.
    """
    from ..operators.profile import infer_types

    raw = spark.read.csv(path, sep=sep, header=header, quote=quote, inferSchema=False)
    chosen = dict(types or {})
    rest = [c for c in raw.columns if c not in chosen]
    if rest:
        casts = {"boolean": "boolean", "integer": "bigint", "float": "double", "date": "date", "datetime": "timestamp_ntz", "string": "string"}
        found = {r["column"]: casts[r["inferred"]] if r["n"] else "string" for r in infer_types(raw, rest).collect()}
        kept = identifiers(raw, [c for c in rest if found[c] == "bigint"]) if protect else set()
        chosen |= {c: "string" if c in kept else found[c] for c in rest}
    text = lambda c: F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`"))
    return raw.select(*[F.col(f"`{c}`") if chosen[c] == "string" else text(c).try_cast(chosen[c]).alias(c) for c in raw.columns])


def identifiers(df: DataFrame, columns: list[str]) -> set[str]:
    """Columns of digits that are names rather than numbers."""
    if not columns:
        return set()
    aggs = []
    for k, c in enumerate(columns):
        aggs += [F.max(F.col(f"`{c}`").rlike(r"^0\d")).alias(f"z{k}"), F.min(F.length(f"`{c}`")).alias(f"a{k}"), F.max(F.length(f"`{c}`")).alias(f"b{k}")]
    row = df.agg(*aggs).first()
    named = lambda c: any(w in c.lower() for w in IDENTIFIER_NAMES[:7])
    return {c for k, c in enumerate(columns) if row[f"z{k}"] or (named(c) and row[f"a{k}"] == row[f"b{k}"] and (row[f"a{k}"] or 0) > 3)}


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    return spark.read.json(path, schema=schema)


def read_document(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """One document, or an array of them, in a file."""
    return spark.read.json(path, schema=schema, multiLine=True)


def read_xml(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records by a path like //item or /a/b: its last name is the row tag."""
    return spark.read.format("xml").option("rowTag", record.rstrip("/").split("/")[-1]).load(path)


def flatten(df: DataFrame, table: str, key: str | None = None) -> dict[str, DataFrame]:
    """Documents as tables: the root with _id, and one table per array of documents with _id, _parent_id, _ordinal.

    Ids are 1..n in the order of the key (of the rows' hash without one); structs become columns a__b.
    """
    from ..operators.relational import dense_numbers

    if key is None:
        df, key = df.withColumn("_order", F.xxhash64(*df.columns)), "_order"
    rooted = dense_numbers(df, [key], "_id").drop("_order")
    out: dict[str, DataFrame] = {}

    def spread(frame: DataFrame, prefix: str = "") -> tuple[list, list]:
        flat, arrays = [], []

        def walk(schema: T.StructType, path: str, name: str) -> None:
            for f in schema.fields:
                at, label = f"{path}`{f.name}`", f"{name}{f.name}"
                if isinstance(f.dataType, T.StructType):
                    walk(f.dataType, f"{at}.", f"{label}__")
                elif isinstance(f.dataType, T.ArrayType):
                    arrays.append((at, label, f.dataType.elementType))
                else:
                    flat.append(F.col(at).alias(label))

        walk(frame.schema, "", prefix)
        return flat, arrays

    def table_of(frame: DataFrame, name: str) -> None:
        flat, arrays = spread(frame)
        out[name] = frame.select(*flat)
        for at, label, element in arrays:
            child = frame.select(F.col("_id").alias("_parent_id"), F.posexplode(F.col(at)).alias("_ordinal", "_e"))
            columns = [F.col("_e.*")] if isinstance(element, T.StructType) else [F.col("_e").alias("value")]
            table_of(dense_numbers(child.select("_parent_id", "_ordinal", *columns), ["_parent_id", "_ordinal"], "_id"), f"{name}__{label}")

    table_of(rooted, table)
    return out


class ArrowFiles(DataSource):
    """Arrow IPC (Feather) files: one partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "arrowipc"

    def _paths(self) -> list[str]:
        import glob

        return sorted(glob.glob(self.options["path"]))

    def schema(self):
        import pyarrow.feather as feather
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(feather.read_table(self._paths()[0], memory_map=True).slice(0, 0).schema)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrowReader(self._paths())


class ArrowReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow.feather as feather

        yield from feather.read_table(partition.value, memory_map=True).to_batches(max_chunksize=65_536)


class DuckTable(DataSource):
    """A table or query of a DuckDB file, read only, in ranges of rows."""

    @classmethod
    def name(cls) -> str:
        return "duckdb"

    def _sql(self) -> str:
        return f"({self.options['query']})" if "query" in self.options else '"' + self.options["table"].replace('"', '""') + '"'

    def schema(self):
        import duckdb
        from pyspark.sql.pandas.types import from_arrow_schema

        with duckdb.connect(self.options["path"], read_only=True) as c:
            return from_arrow_schema(c.execute(f"select * from {self._sql()} limit 0").to_arrow_table().schema)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DuckReader(self.options["path"], self._sql(), int(self.options.get("rows", "500000")))


class DuckReader(DataSourceReader):
    def __init__(self, path: str, sql: str, rows: int):
        self.path, self.sql, self.rows = path, sql, rows

    def partitions(self):
        import duckdb

        with duckdb.connect(self.path, read_only=True) as c:
            n = c.execute(f"select count(*) from {self.sql}").fetchall()[0][0]
        return [InputPartition(k) for k in range(0, max(1, n), self.rows)]

    def read(self, partition: InputPartition) -> Iterator:
        import duckdb

        with duckdb.connect(self.path, read_only=True) as c:
            yield from c.execute(f"select * from {self.sql} limit {self.rows} offset {partition.value}").to_arrow_table().to_batches()


def register(spark: SparkSession) -> None:
    for source in (ArrowFiles, DuckTable):
        spark.dataSource.register(source)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **properties: str) -> DataFrame:
    """A database's table, in parts by ranges of a numeric column; the driver's jar has to be there."""
    if column:
        return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


def read_lakehouse(spark: SparkSession, kind: str, path: str, version: int | None = None, as_of: str | None = None) -> DataFrame:
    """A Delta or Iceberg table, at a version or time; the format's jar has to be there."""
    reader = spark.read.format(kind)
    if version is not None:
        reader = reader.option("versionAsOf" if kind == "delta" else "snapshot-id", version)
    if as_of is not None:
        reader = reader.option("timestampAsOf" if kind == "delta" else "as-of-timestamp", as_of)
    return reader.load(path)


def resolve(spark: SparkSession, source, **options) -> DataFrame:
    """A DataFrame, rows (dicts), a pandas or Arrow table, or a path or URI by its ending, as a DataFrame."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, list):
        return spark.createDataFrame(source)
    if not isinstance(source, str):
        return spark.createDataFrame(source.to_pandas() if hasattr(source, "to_pandas") else source)
    kind = options.pop("format", None) or FORMATS.get(PurePosixPath(source.split("?")[0].rstrip("/*")).suffix, "parquet")
    if kind == "csv":
        return read_csv(spark, source, **options)
    if kind == "tsv":
        return read_csv(spark, source, sep="\t", **options)
    if kind == "jsonl":
        return read_jsonl(spark, source, **options)
    if kind == "json":
        return read_document(spark, source, **options)
    if kind == "xml":
        return read_xml(spark, source, options["record"])
    if kind in ("arrow", "duckdb"):
        register(spark)
        return spark.read.format("arrowipc" if kind == "arrow" else "duckdb").options(path=source, **options).load()
    if kind in ("delta", "iceberg"):
        return read_lakehouse(spark, kind, source, **options)
    return spark.read.format(kind).load(source)


def folder(spark: SparkSession, path: str, pattern: str = "*") -> dict[str, DataFrame]:
    """Every table file of a folder by its stem, through Hadoop's file system, so any store will do; a stem that comes twice is refused."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    out: dict[str, DataFrame] = {}
    for status in listed:
        name = status.getPath().getName()
        stem, dot, ending = name.rpartition(".")
        if not dot or f".{ending}" not in FORMATS or not fnmatch.fnmatch(stem, pattern):
            continue
        if stem in out:
            raise ValueError(f"two files are named {stem}")
        out[stem] = resolve(spark, status.getPath().toString())
    return out


def one_table(frames: dict[str, DataFrame]) -> bool:
    """Whether the files of a folder share their columns, so that they are parts of one table."""
    return len({tuple(sorted(f.columns)) for f in frames.values()}) <= 1


def within_budget(spark: SparkSession, path: str, rows: int | None = None, size: int | None = None) -> bool:
    """Whether a Parquet source has no more rows (from its footers) and bytes than that."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    length = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()
    return (size is None or length <= size) and (rows is None or spark.read.parquet(path).count() <= rows)
