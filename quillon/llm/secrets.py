"""Secrets in texts, told from widely copied examples by how many repositories and owners hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, plain

# The base kinds in the order of ties, as (kind, pattern). A run of 24+ hex digits and AKIA with 16+ more
# are what is left of the contract's matches once the shorter ones are dropped; assign is filtered by its second group.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN), ("access", r"AKIA[A-Z0-9]{16,}"), ("hex", r"[0-9a-f]{24,}")]
# Further credentials by their issuers' public prefixes, and key blocks.
ADDED = [
    ("issued", r"(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,})"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]+"),
]
KINDS = [k for k, _ in BASE + ADDED]
#: A value held by more owners or repositories than these is taken for a copied example.
MOST_OWNERS, MOST_REPOSITORIES = 1, 8
SALTS = 16


def matches(text: Column, kind: int, pattern: str, group: int = 0) -> Column:
    """Array of (start, kind, end, value) in code points: leftmost matches that don't overlap, from the gaps between them."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.transform(F.split(text, pattern, -1), F.length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("size")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    walked = F.aggregate(
        F.arrays_zip(F.slice(steps, 1, F.size(found)).alias("step"), values.alias("value")),
        F.struct(F.lit(0).alias("pos"), none.alias("out")),
        lambda a, x: F.struct(
            (a["pos"] + x["step"]["gap"] + x["step"]["size"]).alias("pos"),
            F.concat(
                a["out"],
                F.array(F.struct((a["pos"] + x["step"]["gap"]).alias("start"), F.lit(kind).alias("kind"), (a["pos"] + x["step"]["gap"] + x["step"]["size"]).alias("end"), x["value"].alias("value"))),
            ).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(none)


def told(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    Base spans stay whatever their frequency. Each candidate value's hash is counted over distinct repositories and
    owners of the whole corpus: values of few are live-looking (n_live counts them), values of many are examples
    (n_example). The added kinds give spans only where live-looking. Null text counts as empty; a null owner or
    repository is a value of its own; a repeated row is scanned for itself, with the same result.
    """
    text = F.col("text")
    rows = plain(docs, doc_id=id_col, text=F.coalesce(F.col(text_col), F.lit("")), owner=F.col(owner_col).cast("string"), repository=F.col(repository_col).cast("string"))
    base = [F.filter(matches(text, 0, ASSIGN, 1), lambda s: F.length(s["value"]) >= 6), *[matches(text, k, p) for k, (_, p) in enumerate(BASE) if k]]
    added = [matches(text, len(BASE) + k, p) for k, (_, p) in enumerate(ADDED)]
    hashed = lambda s: F.struct(s["start"], s["kind"], s["end"], F.xxhash64(s["value"]).alias("h"))
    found = cut(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "owner",
            "repository",
            F.sort_array(F.transform(F.concat(*base), hashed)).alias("base"),
            F.transform(F.concat(*added), hashed).alias("added"),
        )
    )
    each = found.where(F.size("base") + F.size("added") > 0).select("row", "owner", "repository", F.explode(F.concat("base", "added")).alias("s")).select("row", "owner", "repository", "s", F.col("s.h").alias("h"))
    # distinct (hash, owner, repository), then counts by owner, then by hash: every step combines before it shuffles
    by_owner = each.groupBy("h", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("h", "owner").agg(F.count("*").alias("repositories"))
    spread = by_owner.groupBy("h").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    verdict = spread.select("h", ((F.col("owners") <= MOST_OWNERS) & (F.col("repositories") <= MOST_REPOSITORIES)).alias("live"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # never broadcast: what is salted here grows with the corpus
    judged = each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(verdict.hint("merge"), ["h", "salt"])
    live = F.col("live")
    by_row = judged.groupBy("row").agg(
        F.collect_list(F.when(live & (F.col("s.kind") >= len(BASE)), F.col("s"))).alias("kept"),
        F.count_if(live).alias("n_live"),
        F.count_if(~live).alias("n_example"),
    )
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    spans = F.when(F.size("kept") > 0, F.sort_array(F.concat("base", "kept"))).otherwise(F.col("base"))
    return found.select("row", "doc_id", "base").join(by_row, "row", "left").select(
        "doc_id",
        *[n(k).alias(f"n_{kind}") for k, (kind, _) in enumerate(BASE)],
        F.sha2(told(F.col("base")), 256).alias("base_sha256"),
        told(spans).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )
