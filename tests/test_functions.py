import math
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import dates, guards, numbers, text
from quillon.plans.formula import columns_in, compiled


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_jaro_known_answers():
    assert round(text.jaro("martha", "marhta"), 6) == 0.944444
    assert round(text.winkler("martha", "marhta"), 6) == 0.961111
    assert round(text.winkler("dixon", "dicksonx"), 6) == 0.813333
    assert text.jaro("", "a") == 0 and text.jaro("", "") == 1


@given(st.text(max_size=8), st.text(max_size=8))
@settings(max_examples=200, deadline=None)
def test_jaro_is_symmetric_and_bounded(a, b):
    assert 0 <= text.jaro(a, b) <= 1
    assert text.jaro(a, a) == 1
    assert text.winkler(a, b) >= text.jaro(a, b) - 1e-12


@pytest.mark.parametrize(("a", "b", "n"), [("kitten", "sitting", 3), ("flaw", "lawn", 2), ("ab", "ba", 2), ("müller", "muller", 1)])
def test_levenshtein(spark, a, b, n):
    assert one(spark, F.levenshtein(F.lit(a), F.lit(b))) == n


def test_text_forms(spark):
    assert one(spark, text.normalise(F.lit("  O'Brien,  Jörg-Peter "))) == "obrien jorg peter"
    assert one(spark, text.skeleton(F.lit("AB-12--x"))) == "A-D-A"
    assert one(spark, text.phonetic_key(F.lit("Robert Rupert Ashcraft"))) == "A261 R163"
    assert one(spark, text.name_words(F.lit("customerID_fooBar"))) == ["customer", "id", "foo", "bar"]
    assert one(spark, text.token_sort(F.lit("b a"), F.lit("A, B"))) == 1.0
    assert one(spark, text.ngram_jaccard(F.lit(""), F.lit(""))) == 1.0


@pytest.mark.parametrize(("value", "ok"), [("GB82 WEST 1234 5698 7654 32", True), ("DE89370400440532013000", True), ("DE89370400440532013001", False), ("XX00", False), ("", False)])
def test_iban(spark, value, ok):
    assert one(spark, text.is_iban(F.lit(value))) is ok


def test_full_match_refuses_backtracking(spark):
    with pytest.raises(ValueError):
        text.full_match(F.lit("a"), "(?=a)")
    assert one(spark, text.full_match(F.lit("ab1"), "[a-z]+")) is False


def test_numbers(spark):
    km = one(spark, numbers.haversine(F.lit(39.9612), F.lit(-82.9988), F.lit(40.0), F.lit(-83.0)))
    assert 4 < km < 5
    for p in (0.001, 0.2, 0.5, 0.9, 0.9999):
        z = one(spark, numbers.normal_quantile(F.lit(p)))
        assert abs(one(spark, numbers.normal_cdf(F.lit(z))) - p) < 1e-6
    assert one(spark, numbers.interpolate(F.lit(1.5), [0, 1, 2], [0, 10, 30])) == 20
    assert abs(numbers.chi2_sf(3.841459, 1) - 0.05) < 1e-6
    assert abs(numbers.chi2_sf(18.307038, 10) - 0.05) < 1e-6


def test_guards(spark):
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    assert one(spark, guards.finite(nan)) is None and one(spark, guards.finite(inf)) is None
    assert one(spark, guards.ieee_divide(F.lit(1), F.lit(0))) == math.inf
    assert math.isnan(one(spark, guards.ieee_divide(F.lit(0), F.lit(0))))
    assert one(spark, guards.round_cents(F.lit(1.015))) == 1.01
    constant = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert constant.agg(guards.pearson(F.col("a"), F.col("b"))).first()[0] is None


def test_dates(spark):
    assert dates.microseconds("500ms") == 500_000 and dates.microseconds("2w") == 14 * 86_400_000_000
    with pytest.raises(ValueError):
        dates.microseconds("5")
    assert one(spark, dates.date_key(F.lit("2024-02-29"))) == 20240229
    assert one(spark, dates.parse(F.lit("2/3/2024"))).date() == date(2024, 2, 3)
    assert one(spark, dates.parse(F.lit("no date"))) is None


def test_formula(spark):
    df = spark.createDataFrame([(4.0, 0.0)], "a double, b double")
    assert df.select(compiled("a * 2 + 1 if a > 3 and not b > 1 else 0").alias("x")).first()["x"] == 9
    assert df.select(compiled("a / b").alias("x")).first()["x"] == math.inf
    assert columns_in("clip(a, 0, b) + sqrt(a)") == ["a", "b"]
    for bad in ("__import__('os')", "a.b", "[x for x in a]", "open(a)", "lambda: 1"):
        with pytest.raises(ValueError):
            compiled(bad)


def test_canonical_hash(spark):
    row = spark.createDataFrame([(1, 1.0, 1.5)], "i bigint, d double, e double").select(*[text.canonical_hash(F.col(c), True).alias(c) for c in "ide"]).first()
    assert row["i"] == row["d"] != row["e"]
