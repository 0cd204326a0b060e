"""Entity resolution: blocks, pair scores, components, golden records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, ngrams, normalise, similarity, words

THRESHOLD, MAX_BLOCK, GROUP = 0.85, 500, 1000


def block_keys(column: str, how: str, n: int = 3) -> Column:
    """Keys of a row: key (the value), prefix (its first letters), phonetic (Soundex of each word), ngram."""
    c = F.col(column).cast("string")
    norm = normalise(c)
    some = {"key": lambda: F.array(c), "prefix": lambda: F.array(F.substring(norm, 1, n)), "phonetic": lambda: F.transform(words(c), lambda w: F.soundex(fold(w))), "ngram": lambda: ngrams(norm, n)}[how]()
    return F.array_distinct(F.filter(F.transform(some, lambda k: F.concat(F.lit(f"{how}:{column}:"), k)), lambda k: k.isNotNull() & (k != f"{how}:{column}:")))


def candidate_pairs(df: DataFrame, key: str, rules: list[tuple[str, str]], max_block: int | None = MAX_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b) that share a key in a block of at most max_block rows (None: any), and the blocks left out for their size.

    A pair is made in the least of the blocks that it shares, so pairs needn't be told apart afterwards. Rows of a large
    block are dealt into groups of about GROUP, and each two groups meet in a task of their own.
    """
    keyed = df.select(F.col(key).alias("id"), F.explode(F.array_distinct(F.concat(*[block_keys(c, how) for c, how in rules]))).alias("block")).distinct()
    sizes = keyed.groupBy("block").agg(F.count("*").alias("n"))
    used = keyed.join(sizes.where((F.col("n") > 1) & (F.col("n") <= max_block if max_block is not None else F.lit(True))), "block")
    used = used.withColumn("groups", F.ceil(F.col("n") / GROUP).cast("int")).drop("n")
    blocks = used.groupBy("id").agg(F.collect_list(F.struct("block", "groups")).alias("all"))
    rows = blocks.select("id", F.transform("all", lambda x: x["block"]).alias("blocks"), F.explode("all").alias("x")).select("id", "blocks", "x.block", "x.groups")
    own = F.pmod(F.xxhash64("id"), F.col("groups").cast("long")).cast("int")
    others = F.sequence(F.lit(0), F.col("groups") - 1)
    # a row goes to every pair of groups that its own is in; within the pair its group says which rows it has yet to meet
    meets = F.transform(others, lambda g: F.struct(F.least(own, g).alias("low"), F.greatest(own, g).alias("high")))
    dealt = rows.select("id", "blocks", "block", own.alias("own"), F.explode(meets).alias("m")).select("id", "blocks", "block", "own", "m.low", "m.high")
    a = dealt.select(F.col("id").alias("a"), F.col("blocks").alias("_a"), "block", "low", "high", F.col("own").alias("_g"))
    b = dealt.select(F.col("id").alias("b"), F.col("blocks").alias("_b"), "block", "low", "high", F.col("own").alias("_h"))
    once = (F.col("low") == F.col("high")) | (F.col("_g") != F.col("_h"))
    least = F.when((F.size("_a") == 1) | (F.size("_b") == 1), True).otherwise(F.array_min(F.array_intersect("_a", "_b")) == F.col("block"))
    pairs = a.join(b, ["block", "low", "high"]).where((F.col("a") < F.col("b")) & once & least).select("a", "b")
    return pairs, sizes.where(F.col("n") > max_block) if max_block is not None else sizes.where("false")


def score(df: DataFrame, key: str, pairs: DataFrame, fields: dict[str, tuple[str, float]]) -> DataFrame:
    """pairs with score: the weighted mean of similarities over fields that both have; 0 if none.

    Kinds: exact, tolerance:<t> (numbers), or a text similarity by name.
    """
    side = lambda s: df.select(F.col(key).alias(s), *[F.col(c).alias(f"{s}_{c}") for c in fields])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    top, weight = F.lit(0.0), F.lit(0.0)
    for c, (kind, w) in fields.items():
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        if kind == "exact":
            sim = (x == y).cast("double")
        elif kind.startswith("tolerance:"):
            t = float(kind.split(":")[1])
            sim = F.greatest(F.lit(0.0), 1 - F.abs(x - y) / t) if t > 0 else (x == y).cast("double")
        else:
            sim = similarity(kind, x, y)
        there = x.isNotNull() & y.isNotNull()
        top, weight = top + F.when(there, sim * w).otherwise(0.0), weight + F.when(there, w).otherwise(0.0)
    return both.select("a", "b", F.coalesce(F.try_divide(top, weight), F.lit(0.0)).alias("score"))


def written(df: DataFrame) -> DataFrame:
    """df as a table in the cluster's checkpoint folder: cuts the lineage of an iteration, and outlives executors."""
    top = df.sparkSession.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
    path = f"{top.rstrip('/')}/quillon-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of edges (a, b): the smallest id that can be reached.

    Alternates joining each node's larger neighbours to its least one, and its smaller ones to the least of them, until
    nothing changes; the rounds grow with the logarithm of a component's width.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = None
    while True:
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen == state or not seen[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        state = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(lowest.withColumnRenamed("m", "v")).where("u != v").distinct())


def clusters(df: DataFrame, key: str, scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every row's id and cluster (the smallest id of its component; its own if nothing matches)."""
    found = connected(scored.where(F.col("score") >= threshold))
    return df.select(F.col(key).alias("id")).join(found, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def pair_metrics(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Of pairs in common clusters: tp, fp, fn, precision, recall, from the contingency of (id, cluster) tables."""
    both = predicted.select("id", F.col("cluster").alias("p")).join(truth.select("id", F.col("cluster").alias("t")), "id")
    pairs = lambda n: F.sum(n * (n - 1) / 2)
    cells = both.groupBy("p", "t").agg(F.count("*").alias("n"))
    row = cells.agg(pairs(F.col("n")).alias("tp"))
    row = row.crossJoin(cells.groupBy("p").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("pp"))).crossJoin(cells.groupBy("t").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("tt")))
    return row.select("tp", (F.col("pp") - F.col("tp")).alias("fp"), (F.col("tt") - F.col("tp")).alias("fn"), F.coalesce(F.try_divide("tp", "pp"), F.lit(1.0)).alias("precision"), F.coalesce(F.try_divide("tp", "tt"), F.lit(1.0)).alias("recall"))


def most_similar(scored: DataFrame) -> DataFrame:
    """Each row's best partner."""
    both = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where("n = 1").drop("n")


def center_clusters(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, center): within each component pairs are taken by falling score; the first end of a pair becomes a centre.

    A row that isn't assigned joins its partner's centre. Components are worked through one by one.
    """
    import pandas as pd

    edges = scored.where(F.col("score") >= threshold)
    of = connected(edges).withColumnRenamed("id", "a")

    def assign(pairs: pd.DataFrame) -> pd.DataFrame:
        center: dict[int, int] = {}
        for a, b, _ in sorted(pairs[["a", "b", "score"]].itertuples(index=False), key=lambda p: (-p[2], p[0], p[1])):
            if a not in center and b not in center:
                center[a] = center[b] = a
            elif a in center and center[a] == a:
                center.setdefault(b, a)
            elif b in center and center[b] == b:
                center.setdefault(a, b)
        for x in {*pairs["a"], *pairs["b"]}:
            center.setdefault(x, x)
        return pd.DataFrame({"id": list(center), "center": list(center.values())})

    return edges.join(of, "a").groupBy("component").applyInPandas(assign, "id long, center long")
