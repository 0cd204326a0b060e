"""URL rules and lists behind a blocked Bloom filter and an exact hash join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bloom_build, bloom_pass, bloom_size, plain, small

# The rules of the contract, and a list of canonical URLs that are blocked where no rule speaks.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
LISTED = ["ads-track.example.com/", "casino-win.example.com/", "cheap-pills.example.com/", "free-bets.example.com/"]
#: Default ports of schemes.
PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, listed: list[str] = LISTED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end; both
    empty for a null url or one without ://. A rule fits its host and all subdomains if the path starts with its own;
    the longest wins (of equal ones, the first in order of text). Where none fits, a url under a listed canonical URL
    is blocked and any other allowed; for that alone, user info, the scheme's default port and a final dot are taken
    off the host, and an empty path is /. Repeated, empty and null urls are judged alike, one row for each input row.

    Every host suffix and path prefix that a rule or listed URL could have is tried against the filter; what passes is
    joined exactly. Each distinct url is judged once, so a hot one costs one row.
    """
    spark = pages.sparkSession
    split = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = plain(pages, page_id=id_col, url=url_col).select(
        "page_id", "url", ascii_lower(F.regexp_extract(url, split, 1)).alias("host"), F.regexp_extract(url, split, 2).alias("path")
    )
    entries = [(rule, action, False) for action, rule in rules] + [(x, "block", True) for x in listed]
    parts = [(x[0].partition("/")[0], x[0][len(x[0].partition("/")[0]) :]) for x in entries]
    sizes = sorted({(len(host.split(".")), len(path), x[2]) for (host, path), x in zip(parts, entries, strict=True)})
    known = spark.createDataFrame(entries, "entry string, action string, listed boolean").withColumn("h", F.xxhash64("entry"))

    scheme = ascii_lower(F.regexp_extract("url", r"(?s)^.*?([A-Za-z0-9+.-]*)://", 1))
    port = F.coalesce(*[F.when(scheme == k, F.lit(n)) for k, n in PORTS.items()], F.lit(""))
    bare = F.regexp_replace("host", r"(?s)^.*@", "")
    said = F.regexp_extract(bare, r":0*([1-9][0-9]*|0)$", 1)  # empty if there is none
    bare = F.when((said == "") | (said == port), F.regexp_replace(bare, r":[0-9]*$", "")).otherwise(bare)
    canonical = {"host": F.regexp_replace(bare, r"\.$", ""), "path": F.when((F.col("path") == "") & (F.col("host") != ""), F.lit("/")).otherwise(F.col("path"))}
    urls = rows.select("url", "host", "path").distinct().select("*", canonical["host"].alias("listed_host"), canonical["path"].alias("listed_path"))

    def tried(k: int, n: int, of_list: bool):
        host, path = ("listed_host", "listed_path") if of_list else ("host", "path")
        labels = F.split(host, r"\.", -1)
        key = F.struct(F.concat(F.array_join(F.slice(labels, -k, k), "."), F.substring(path, 1, n)).alias("entry"), F.lit(of_list).alias("listed"))
        return F.when((F.size(labels) >= k) & (F.length(path) >= n), key)

    keys = urls.select("url", F.explode(F.array_compact(F.array(*[tried(*x) for x in sizes]))).alias("x")).select("url", "x.*").withColumn("h", F.xxhash64("entry"))
    blocks = bloom_size(len(entries))
    may = bloom_pass(keys, "h", bloom_build(known, "h", blocks), blocks)
    hits = may.join(small(known.drop("h")), ["entry", "listed"])
    rank = lambda keep: F.min(F.when(keep, F.struct((-F.length("entry")).alias("n"), "entry", "action")))
    judged = hits.groupBy("url").agg(rank(~F.col("listed")).alias("rule"), F.max("listed").alias("listed"))
    verdict = F.coalesce(F.col("rule.action"), F.when(F.col("listed"), F.lit("block")), F.lit("allow"))
    return rows.join(judged, "url", "left").select("page_id", "host", "path", F.col("rule.entry").alias("rule"), verdict.alias("verdict"))


def oracle(rules: list[tuple[str, str]] = RULES, listed: list[str] = LISTED) -> str:
    """The same in DuckDB's SQL, rule by rule."""

    def fits(entry: str) -> str:
        host, _, path = entry.partition("/")
        return f"((host = '{host}' or host like '%.{host}') and starts_with(path, '/{path}'))"

    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    case = lambda k: "case " + " ".join(f"when {fits(r[1])} then '{r[k]}'" for r in longest)
    block = reduce(lambda a, b: f"{a} or {b}", map(fits, listed))
    return f"""
with cut as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut)
select page_id, host, path, {case(1)} else null end as rule, {case(0)} when {block} then 'block' else 'allow' end as verdict from parts"""
