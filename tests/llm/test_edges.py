"""Nulls, empty and long texts, ties and repeated rows, empty tables, clashing columns: every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import decontamination, near_dedup, queries

LONG = "lorem ipsum dolor sit amet " * 8000
ROWS = [
    (1, "The same text is here, twice over, in two rows of the table.", "en", "s1", 60),
    (1, "The same text is here, twice over, in two rows of the table.", "en", "s1", 60),
    (2, "the SAME text is here, twice over, in two rows of the table.", "en", None, 60),
    (3, None, None, None, None), (4, "", "en", "s1", 0), (5, "   \n\t ", "en", "s1", 6), (None, "A row without an id, but with some text of its own in it.", "en", "s2", 1),
    (None, None, None, None, None), (6, LONG, "en", "s1", len(LONG)), (7, "12345 67890 !!!", None, "s3", 15), (8, "x", "fr", "s1", 1), (9, "password=abcdefgh a@b.co 😀", "de", "s1", 1),
]
CLASH = ["norm", "h", "v", "rep", "row", "words", "block", "bloom_block", "_id", "_sha", "_n", "n", "score", "kept", "component_id", "item_id", "start", "length", "label"]
TABLES = ("documents", "pages", "benchmark", "labels")


def write(spark, where, rows, clash):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    pages = spark.createDataFrame([(k, t) for k, t in [(1, "http://a.com/en/"), (1, "http://a.com/en/"), (None, None), (3, "")]][: 4 if rows else 0], "page_id bigint, url string")
    bench = spark.createDataFrame([(1, "the same text is here twice over in two rows of the table"), (2, None), (3, "too short"), (4, "")][: 4 if rows else 0], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (8, None, None), (None, 1, 1), (9, 1, 0)][: 5 if rows else 0], "doc_id bigint, quality int, toxic int")
    for name, df in zip(TABLES, (docs, pages, bench, labels), strict=True):
        for c in CLASH if clash else []:
            if c not in df.columns:
                df = df.withColumn(c, F.lit("clash"))
        df.write.parquet(f"{where}/{name}.parquet")
    return str(where)


@pytest.fixture(scope="module")
def full(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("full"), ROWS, True)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], False)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", ["op1_secrets", "op3_language_id", "op5_near_dedup", "op8_exact_dedup", "op9_toxicity", "op10_pii"])
def test_one_row_each(spark, full, name):
    out = queries.queries()[name](spark, full)
    assert sorted((r["doc_id"] or -1) for r in out.collect()) == sorted((r[0] or -1) for r in ROWS)


def test_exact(spark, full):
    out = queries.op8_exact_dedup(spark, full).collect()
    same = [r for r in out if r["doc_id"] in (1, 2)]
    assert {r["keep_id"] for r in same} == {2} and {r["group_size"] for r in same} == {3} and sum(r["kept"] for r in same) == 1
    nothing = [r for r in out if r["text_sha256"].startswith("e3b0c442")]
    assert {r["keep_id"] for r in nothing} == {4} and len(nothing) == 3


def test_near(spark, full):
    out = {(r["doc_id"], r["n_shingles"]): r for r in queries.op5_near_dedup(spark, full).collect()}
    assert out[2, 11]["component_id"] == 1 and not out[2, 11]["kept"] and out[1, 11]["kept"]
    assert out[3, 0]["component_id"] == 3 and out[5, 0]["kept"] and out[8, 1]["component_id"] == 8
    assert out[6, 5]["component_id"] == 6 and all(r["component_id"] is None and r["kept"] for (d, _), r in out.items() if d is None)


def test_language(spark, full):
    out = queries.op3_language_id(spark, full).collect()
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (3, 4, 5, 7) or (r["doc_id"] is None and r["score"] == 0)) for r in out)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_decontamination(spark, full):
    assert sorted((r["doc_id"], r["item_id"]) for r in queries.op2_decontamination(spark, full).collect()) == [(1, 1), (2, 1)]


def test_packing(spark, full):
    out = queries.op7_packing(spark, full).collect()
    assert sum(r["piece"] == 0 for r in out) == len(ROWS) and max(r["length"] for r in out) == 1024


def test_urls(spark, full):
    assert sorted((r["page_id"] or -1, r["verdict"]) for r in queries.op6_url_filter(spark, full).collect()) == [(-1, "allow"), (1, "block"), (1, "block"), (3, "allow")]


def test_stages(spark, full, empty):
    docs = spark.read.parquet(f"{full}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, full)
        assert out.columns == docs.columns, name
    assert sorted(r["doc_id"] or -1 for r in corpus_pipeline.drop_exact_duplicates(spark, docs, full).collect()) == [-1, 2, 4, 5, 6, 7, 8, 9]
    assert {r["doc_id"] for r in corpus_pipeline.drop_benchmark_passages(spark, docs, full).collect()} == {None, 3, 4, 5, 6, 7, 8, 9}
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert corpus_pipeline.run(spark, full).where("piece = 0").count() == 4


def test_stages_judge_each_row_by_its_own_text(spark):
    """Rows that share an id, or have none, don't fall together."""
    words = lambda x, n: " ".join(f"{x}{k}" for k in range(n))
    near, passage = words("a", 40), words("p", 20)
    rows = [(0, near), (1, words("u", 40)), (1, near + " more"), (5, near + " once more"), (None, "before it " + passage), (None, words("v", 40)), (7, passage + " after"), (7, words("w", 40)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    told = lambda df: sorted(map(str, df.collect()))
    want = lambda *gone: told(spark.createDataFrame([r for k, r in enumerate(rows) if k not in gone], docs.schema))
    assert told(near_dedup.drop_near_duplicates(docs)) == want(2, 3, 4)  # rows without an id link too; of 4 and 6 the one with an id stays
    assert told(decontamination.drop_contaminated(docs, items)) == want(4, 6)
    assert sorted((r["doc_id"] or -1, r["start"]) for r in decontamination.contaminated(docs, items).collect()) == [(-1, 2), (7, 0)]
    alone = docs.where("doc_id is null or doc_id in (0, 5)")
    assert told(near_dedup.drop_near_duplicates(alone)) == want(1, 2, 3, 6, 7)
