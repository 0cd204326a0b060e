"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, plain, short_batches, small, tidy

END_OF_DOCUMENT = 2
PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"
#: Runs of the plan, as best_fit_decreasing gives them.
PLAN = pa.schema([("length", pa.int32()), *((k, pa.int64()) for k in ("first", "n", "each", "bin", "base"))])


class OpenBins:
    """A segment tree over remaining capacities: how many open bins have each, and which (as ranges of bin numbers)."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.ranges[room].append((first, n))
            self._count(room, n)

    def take(self, room: int) -> tuple[int, int]:
        first, n = self.ranges[room].pop()
        self._count(room, -n)
        return first, n

    def tightest(self, need: int) -> int:
        """The least remaining capacity of at least need that an open bin has; 0 if none has."""
        i = self.leaves + need
        if self.tree[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return 0

    def _count(self, room: int, n: int) -> None:
        i = self.leaves + room
        while i:
            self.tree[i] += n
            i //= 2


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over documents given as {length: how many}.

    Documents of one length are alike, so those that meet bins of the same remaining capacity are placed in one step;
    the result is that of placing them one by one. Runs (length, first rank, documents, documents a bin, first bin,
    offset in the bin); their number depends on the capacity, not on the documents.
    """
    bins, runs, opened = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room:
                first, n = bins.take(room)
            else:
                room = capacity
                first, n = opened, -(-left // (capacity // length))
                opened += n
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, each, first, capacity - room))
                bins.add(room - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if left and n:
                runs.append((length, rank, left, left, first, capacity - room))
                bins.add(room - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            bins.add(room, first, n)
    return runs


@lru_cache(1)
def encoder(vocabulary: str, ranks: str | None):
    """text -> ids of the tokenizers vocabulary; texts with none of its special tokens go through its ranks, if given, faster."""
    import tiktoken
    import tokenizers
    from public_tokenizers import PATTERN

    if ranks is None:
        own = tokenizers.Tokenizer.from_file(vocabulary)
        return lambda text: own.encode(text, add_special_tokens=False).ids
    with open(ranks, "rb") as lines:
        by_bytes = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=by_bytes, special_tokens={}).encode_ordinary
    whole = []

    def encode(text: str) -> list[int]:
        if "<|" not in text:
            return fast(text)
        if not whole:
            whole.append(tokenizers.Tokenizer.from_file(vocabulary))
        return whole[0].encode(text, add_special_tokens=False).ids

    return encode


def pieces(capacity: int, vocabulary: str | None, ranks: str | None, with_ids: bool):
    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        encode = encoder(vocabulary or public_tokenizers.path("byte_bpe_50k.json"), ranks if vocabulary or ranks else public_tokenizers.path("byte_bpe_50k.tiktoken"))
        names = [c.split()[0] for c in PIECE.split(", ")] + ["ids"] * with_ids
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encode(text), END_OF_DOCUMENT], "<u4")
                start, k = 0, 0
                while start < len(ids):
                    length = (len(ids) - start) % capacity or capacity
                    part = ids[start : start + length]
                    rows.append((doc, k, start, length, zlib.crc32(part.tobytes()), *[part.astype(np.int32)] * with_ids))
                    start, k = start + length, k + 1
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return cut_up


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if with_ids).

    A document is its ids, then id 2; null text counts as empty, so every row gives a piece at least. Only documents
    longer than the capacity are cut, into full pieces after a first one that may be shorter. Repeated rows and rows
    without an id are packed like all others. The plan is made from the counts of the lengths alone (at most
    `capacity` numbers); each piece finds its place by its rank among those of its length.
    """
    rows = plain(docs, doc_id=F.col(id_col).cast("long"), text=F.coalesce(F.col(text_col), F.lit("")))
    made = cut(short_batches(rows).mapInPandas(tidy(pieces(capacity, vocabulary, ranks, with_ids)), PIECE + ", ids array<int>" * with_ids))
    buckets = max(16, made.count() // 200_000)
    made = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    shares = cut(made.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    plan = best_fit_decreasing(counts, capacity)
    runs = pa.table({k: [r[i] for r in plan] for i, k in enumerate(PLAN.names)}, PLAN)
    runs = docs.sparkSession.createDataFrame(runs)  # a list would go through Python workers of a kind of their own, which then stay

    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = made.withColumn("rank", F.row_number().over(order) - 1).join(small(shares), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    at = F.col("rank") - F.col("first")
    placed = ranked.join(F.broadcast(runs), "length").where((at >= 0) & (at < F.col("n")))
    return placed.select(
        "doc_id",
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        (F.col("bin") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + at % F.col("each") * F.col("length")).cast("long").alias("offset"),
        *["ids"] * with_ids,
    )
