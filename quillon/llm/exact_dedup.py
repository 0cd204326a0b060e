"""Exact duplicates by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, bloom_build, bloom_pass, bloom_size, cut, plain, tidy

#: Fingerprints of one partition that are sorted and sent together; bounds the memory of the sender.
CHUNK = 1 << 19
#: Documents for each owner of a range of fingerprints; bounds the memory of the receiver.
PER_OWNER = 1 << 18
SENT = "chunk string, owner int, n int, width int, quotients binary, remainders binary, repeated binary"


def golomb_encode(values: np.ndarray, span: int) -> tuple[int, bytes, bytes]:
    """Rice-coded gaps of sorted distinct values below span: the remainders' width, quotients in unary, remainders."""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    width = max(0, int(math.log2(max(1.0, span / max(1, len(values)) * math.log(2)))))
    quotients, low = gaps >> width, gaps & ((1 << width) - 1)
    bits = np.ones(int(quotients.sum()) + len(gaps), np.uint8)
    bits[np.cumsum(quotients + 1) - 1] = 0
    rest = ((low[:, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8)
    return width, np.packbits(bits).tobytes(), np.packbits(rest.ravel()).tobytes()


def golomb_decode(n: int, width: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)) == 0)[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.int64) << width
    if width:
        rest = np.unpackbits(np.frombuffer(remainders, np.uint8), count=n * width).reshape(n, width).astype(np.int64)
        gaps += rest @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))
    return np.cumsum(gaps + 1) - 1


def sender(bits: int, owner_bits: int):
    """Each partition's fingerprints of so many bits: sorted, those it holds twice marked, the rest of the range coded per owner."""
    span = 1 << (bits - owner_bits)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pd.DataFrame:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            owners, rows = values // span, []
            for owner in np.unique(owners):
                lo, hi = np.searchsorted(owners, [owner, owner + 1])
                rows.append((f"{part}-{k}", int(owner), int(hi - lo), *golomb_encode(values[lo:hi] - owner * span, span), np.packbits(counts[lo:hi] > 1).tobytes()))
            return pd.DataFrame(rows, columns=[c.split()[0] for c in SENT.split(", ")])

        for batch in batches:
            held.append(batch["fp"].to_numpy(np.int64))
            n += len(batch)
            if n >= CHUNK:
                yield flush()
                k, held, n = k + 1, [], 0
        if n:
            yield flush()

    return coded


def bitmaps(sent: pd.DataFrame) -> pd.DataFrame:
    """An owner's answer to each chunk: a bitmap of its fingerprints that some chunk repeats."""
    own = [golomb_decode(*x) for x in zip(sent["n"], sent["width"], sent["quotients"], sent["remainders"], strict=True)]
    values, counts = np.unique(np.concatenate(own), return_counts=True)
    twice = [np.unpackbits(np.frombuffer(r, np.uint8), count=n) for r, n in zip(sent["repeated"], sent["n"], strict=True)]
    out = [np.packbits((counts[np.searchsorted(values, v)] > 1) | (t > 0)).tobytes() for v, t in zip(own, twice, strict=True)]
    return pd.DataFrame({"chunk": sent["chunk"], "owner": sent["owner"], "bitmap": out})


def suspects(span: int):
    def picked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                marks = np.unpackbits(np.frombuffer(r.bitmap, np.uint8), count=r.n)
                yield pd.DataFrame({"fp": golomb_decode(r.n, r.width, r.quotients, r.remainders)[marks > 0] + r.owner * span})

    return picked


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays (a row without an id stays only if none of the group has one); of rows that repeat both id and
    text, one. Each partition sends its sorted fingerprints, Golomb-coded, to the owners of their ranges and gets
    bitmaps of the repeated ones back; only rows marked so are shuffled by their text and compared byte by byte.
    """
    rows = plain(docs, doc_id=id_col, norm=ascii_lower(F.coalesce(F.col(text_col), F.lit(""))))
    total = docs.count()
    bits = min(60, max(1, total).bit_length() + 12)
    owner_bits = min(bits - 8, max(4, (total // PER_OWNER).bit_length()))
    fp = F.shiftrightunsigned(F.xxhash64("norm"), 64 - bits)
    known = cut(rows.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), fp.alias("fp")))

    sent = cut(known.select("fp").mapInPandas(tidy(sender(bits, owner_bits)), SENT))
    back = cut(sent.groupBy("owner").applyInPandas(bitmaps, "chunk string, owner int, bitmap binary"))  # one Python worker for a task
    marked = cut(sent.join(back, ["chunk", "owner"]).mapInPandas(tidy(suspects(1 << (bits - owner_bits))), "fp long").distinct())

    blocks = bloom_size(marked.count())
    may = bloom_pass(rows.withColumn("fp", fp), "fp", bloom_build(marked, "fp", blocks), blocks)
    same = may.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = same.select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")

    each = known.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("copies"))
    joined = each.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that exact_duplicates keeps."""
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_quillon_id"), F.col("text_sha256").alias("_quillon_sha"))
    marked = docs.withColumn("_quillon_text", F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    joined = marked.join(kept, F.col(id_col).eqNullSafe(F.col("_quillon_id")) & (F.col("_quillon_text") == F.col("_quillon_sha")))
    once = Window.partitionBy("_quillon_id", "_quillon_sha").orderBy(F.lit(1))
    return joined.withColumn("_quillon_n", F.row_number().over(once)).where("_quillon_n = 1").select(*docs.columns)
