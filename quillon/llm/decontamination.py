"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact weighted shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bloom_build, bloom_pass, bloom_size, cut, let, plain, small

WORDS, SIMILARITY, RADIUS = 5, 0.8, 18
#: Bits of a fingerprint, and the places of its three 21-bit counters in one long.
BITS, LANES = 63, 1 | 1 << 21 | 1 << 42


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def grams(words: Column, n: int) -> Column:
    """Hashes of all runs of n words, in order; none for fewer words."""
    none = F.array().cast("array<bigint>")
    return let(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))).otherwise(none))


def weighed(words: Column) -> Column:
    """Distinct shingles with their weights, the letters and digits they have."""
    return let(
        words,
        lambda w: F.array_distinct(
            F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]).alias("h"), sum(F.length(F.get(w, i + k)) for k in range(WORDS)).alias("w")))
        ),
    )


def weight(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda a, x: a + x["w"])


def simhash(words: Column) -> Column:
    """63 bits: the majority of the hashes of the words. Three 21-bit counters are summed at a time."""

    def counted(k: int):
        return lambda a, x: a + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(LANES))

    def vote(h: Column) -> Column:
        half, out = F.lit((1 << 20) - 1) - F.floor(F.size(h) / 2), None
        for k in range(21):
            total = F.aggregate(h, F.lit(0).cast("long"), counted(k))
            bits = F.shiftleft(F.shiftrightunsigned((total + half * F.lit(LANES)).bitwiseAND(F.lit(LANES << 20)), 20), k)
            out = bits if out is None else out.bitwiseOR(bits)
        return out

    return let(grams(words, 1), vote)


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """radius + 1 parts of the bits: fingerprints within the radius have one of them in common."""
    edges = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("bits")) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and text (128 bits of hash): rows that share an id, or have none, stay apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per document and item of which it holds a passage: doc_id, item_id, similarity, start, words.

    Windows have the length of an item, and start where a shingle that they share with an item puts its beginning (a
    window that shares none has similarity 0). Fingerprints within the radius of an item's meet in a block; then the
    weight of the item's shingles that the window holds, over the weight of all of them, has to reach the similarity.
    A row gives the best window, the first of equals. Items of fewer than five words, or null, match nothing; so do
    null and shorter texts. Rows that share an id (also the missing one) are one document.
    """
    scored = passages(plain(docs, doc_id=row_key(f"`{id_col}`", f"`{text_col}`"), text=text_col), items, item_col, item_text_col, similarity, radius)
    best = scored.groupBy("doc_id.id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("x"))
    return best.select(F.col("id").alias("doc_id"), "item_id", F.col("x.similarity").alias("similarity"), (-F.col("x.back")).alias("start"), F.col("x.n").alias("words"))


def passages(docs: DataFrame, items: DataFrame, item_col: str, item_text_col: str, similarity: float, radius: int) -> DataFrame:
    """(doc_id, item_id, start, n, similarity) of the windows of docs (doc_id, text) that reach the similarity; doc_id is a row key."""
    bench = plain(items, item_id=item_col, words=words_of(F.col(item_text_col))).where(F.size("words") >= WORDS)
    bench = cut(bench.select("item_id", F.size("words").alias("length"), grams(F.col("words"), WORDS).alias("grams"), weighed(F.col("words")).alias("shingles"), simhash(F.col("words")).alias("print")))
    anchors = bench.select("length", F.posexplode("grams").alias("at", "h")).distinct()

    texts = plain(docs, doc_id="doc_id", words=words_of(F.col("text")))
    each = texts.select("doc_id", F.posexplode(grams(F.col("words"), WORDS)).alias("pos", "h"))
    n = anchors.count()
    if n > BROADCAST_ROWS:  # too many for a broadcast: a filter of fixed size first, then a shuffle of what passes
        size = bloom_size(n)
        each = bloom_pass(each, "h", bloom_build(anchors, "h", size), size)
    begun = each.join(small(anchors), "h").select("doc_id", "length", (F.col("pos") - F.col("at")).alias("start"))
    begun = cut(begun.groupBy("doc_id").agg(F.collect_set(F.struct("start", "length")).alias("begun")))

    hashes, size = begun.select(F.xxhash64("doc_id").alias("h")), bloom_size(begun.count())
    named = bloom_pass(docs.withColumn("h", F.xxhash64("doc_id")), "h", bloom_build(hashes, "h", size), size)
    held = named.join(begun.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", words_of(F.col("text")).alias("words"), "begun")
    inside = lambda b: F.struct(F.greatest(F.lit(0), F.least(b["start"], F.size("words") - b["length"])).alias("start"), b["length"].alias("length"))
    windows = held.where(F.size("words") >= WORDS).select("doc_id", "words", F.explode(F.array_distinct(F.transform("begun", inside))).alias("b"))
    windows = windows.select("doc_id", F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.slice("words", F.col("b.start") + 1, F.col("b.length")).alias("words"))
    windows = cut(windows.select("doc_id", "start", "length", F.size("words").alias("n"), weighed(F.col("words")).alias("held"), simhash(F.col("words")).alias("own")))

    # a window has the length of the items that it may hold
    keyed = bench.select("item_id", "length", "print", F.explode(blocks(F.col("print"), radius)).alias("b")).select("item_id", "length", "print", "b.*")
    near = windows.select("doc_id", "start", "n", "length", "own", F.explode(blocks(F.col("own"), radius)).alias("b")).select("doc_id", "start", "n", "length", "own", "b.*")
    near = near.join(small(keyed), ["length", "block", "bits"]).where(F.bit_count(F.col("own").bitwiseXOR(F.col("print"))) <= radius)
    near = near.select("doc_id", "start", "n", "length", "item_id").distinct()

    of = small(bench.select("item_id", "shingles"), 5_000)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("start") == F.col("_start")) & (F.col("length") == F.col("_length"))
    pairs = near.join(windows.select(F.col("doc_id").alias("_id"), F.col("start").alias("_start"), F.col("length").alias("_length"), "held"), same).join(of, "item_id")
    share = weight(F.array_intersect("shingles", "held")) / weight(F.col("shingles"))
    return pairs.select("doc_id", "item_id", "start", "n", share.alias("similarity")).where(F.col("similarity") >= similarity)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no item's passage; each row by itself, whatever its id."""
    key = row_key(f"`{id_col}`", f"`{text_col}`")
    found = passages(plain(docs, doc_id=key, text=text_col), items, "item_id", "text", SIMILARITY, RADIUS).select(F.col("doc_id").alias("_quillon_key")).distinct()
    return docs.join(found, key.eqNullSafe(F.col("_quillon_key")), "left_anti")
