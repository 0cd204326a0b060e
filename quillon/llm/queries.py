"""The queries over the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontamination, exact_dedup, language_id, licenses, near_dedup, packing, pii, secrets, toxicity, url_filter
from .common import table


def op1_secrets(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_licenses(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii(spark, sf_dir):
    return pii.scan_pii(table(spark, sf_dir, "documents"))


OP8_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents),
g as (select norm, max(doc_id) as keep_id, count(*) as group_size from d group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from d join g using (norm)"""


def queries():
    return {f.__name__: f for f in (op1_secrets, op2_decontamination, op3_language_id, op4_licenses, op5_near_dedup, op6_url_filter, op7_packing, op8_exact_dedup, op9_toxicity, op10_pii)}


def oracle_sql():
    return {"op6_url_filter": url_filter.oracle(), "op8_exact_dedup": OP8_SQL}
