"""What the training-data operators share: inputs, written intermediates, bounded broadcasts, blocked Bloom filters."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (key, few short columns) that may be broadcast; a larger side is joined by a shuffle.
BROADCAST_ROWS = 100_000
VECTORED = "parquet.hadoop.vectored.io.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir. Unset, it is /tmp/checkpoints on one machine, and an error on more."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "/tmp/checkpoints"
    return f"{top.rstrip('/')}/quillon-{uuid.uuid4().hex}"


def plain_reads(spark: SparkSession) -> None:
    """Turns parquet's vectored reads off, unless the session says otherwise: each thread that has done one keeps a direct buffer as large as its largest range, outside the heap."""
    if spark.conf.get(VECTORED, None) is None:
        spark.conf.set(VECTORED, "false")


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: its lineage ends there, and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    plain_reads(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is (Spark then joins it by a shuffle)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df written to the shared folder, and its rows."""
    df = cut(df)
    return df, df.count()


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, known to have so many rows at most, with a broadcast hint if those are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def short_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, after making sure that Arrow hands so many rows at most to a Python worker at once: texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= rows:
        df.sparkSession.conf.set(key, str(rows))
    return df


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """task over batches, after which its Python worker gives back what allocators still hold: workers stay for later tasks."""

    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)

    return run


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; Spark's lower() does the same, faster, where all is ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, ascii_uppercase, ascii_lowercase))


def plain(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under our names: extra columns with clashing names go."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def row_names(text: Column) -> dict[str, Column]:
    """128 bits of hash that name a text."""
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)}


def bloom_block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks)).cast("int")


def bloom_mask(h: Column) -> Column:
    """Four bits of a 64-bit block."""
    g = F.xxhash64(h, F.lit(17))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def bloom_size(keys: int, most: int = 1 << 17) -> int:
    """Blocks for so many keys at 16 bits each; never more than most, which bounds what is broadcast."""
    blocks = 64
    while blocks < min(most, keys / 4):
        blocks *= 2
    return blocks


def bloom_build(hashes: DataFrame, h: str, blocks: int) -> DataFrame:
    """A blocked Bloom filter as a table (bloom_block, bloom_bits) of at most `blocks` rows."""
    return hashes.groupBy(bloom_block(F.col(h), blocks).alias("bloom_block")).agg(F.bit_or(bloom_mask(F.col(h))).alias("bloom_bits"))


def bloom_pass(df: DataFrame, h: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows whose hash may be in the filter. The filter's size is fixed, so it is broadcast."""
    mask = bloom_mask(F.col(h))
    return (
        df.withColumn("bloom_block", bloom_block(F.col(h), blocks))
        .join(F.broadcast(bloom), "bloom_block")
        .where(F.col("bloom_bits").bitwiseAND(mask) == mask)
        .drop("bloom_block", "bloom_bits")
    )


def drawn(key: Column, share: Column | float) -> Column:
    """True for about that share of keys, chosen by their hash alone: a sample that no task has to gather or sort."""
    return F.pmod(F.xxhash64(key, F.lit(23)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * share
