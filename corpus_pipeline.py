"""The corpus pipeline: language, exact and near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. A row is rejected by the first stage
if its text is null or has no letter, or if no language reaches LEAST_SCORE; of equal texts, and of each group of near
duplicates (five-word shingles, similarity 0.8), one row stays; rows with a benchmark passage go; the last stage packs.
Rows without an id take part in all of it; near-duplicate search leaves them alone. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontamination, exact_dedup, language_id, near_dedup, packing
from quillon.llm.common import cut, plain_reads, table

LEAST_SCORE = 0.3


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain_reads(spark)
    return language_id.keep_identified(docs, LEAST_SCORE)


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_exact_duplicates),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: Stages that SQL can't express: the trained language model, fingerprint windows and the tokenizer. tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
