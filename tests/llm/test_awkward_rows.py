"""Operators that return rows of their input: repeated rows and ids, nulls, ties, clashing column names, empty tables."""

import collections

import pytest
from pyspark.sql import functions as F

from factloom.llm import exact_dedup, near_dedup, quality, toxicity, url_filters

LONG = " ".join(f"w{i}" for i in range(40))
ROWS = [(1, ""), (1, ""), (2, None), (2, None), (3, LONG), (3, LONG), (3, "other words of its own"), (None, LONG.upper()), (4, LONG + " more"), (4, None)]


def frame(spark, rows=ROWS, extra=()):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in extra:
        df = df.withColumn(name, F.lit("own"))
    return df


def found(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


CLASH = ("_kept_id", "_kept_sha", "_sha", "_id", "row", "one", "every", "_text", "_row", "k_id", "sha", "n", "class", "uid", "score", "votes", "n_words", "host", "path", "verdict", "best", "a.b")


def test_near_duplicates_keep_each_row_without_shingles(spark):
    want = collections.Counter([(1, ""), (1, ""), (2, None), (2, None), (3, "other words of its own"), (4, None), (3, LONG)])
    assert found(near_dedup.drop_near_duplicates(frame(spark))) == want


def test_exact_duplicates_keep_one_row_of_each_text(spark):
    assert found(exact_dedup.drop_exact_duplicates(frame(spark))) == collections.Counter([(4, None), (3, LONG), (3, "other words of its own"), (4, LONG + " more")])


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, near_dedup.drop_near_duplicates, quality.filter_quality])
def test_columns_of_any_name_stay(spark, drop):
    df, plain = frame(spark, extra=CLASH), drop(frame(spark))
    out = drop(df)
    assert out.columns == df.columns and out.where(F.col("`a.b`") == "own").count() == plain.count()
    assert drop(frame(spark, [], CLASH)).count() == 0


def test_toxicity_filter_keeps_columns(spark):
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    rows = [(k, f"good kind words number {k}" if k % 2 == 0 else f"idiot scum trash number {k}") for k in range(40)]
    df = frame(spark, rows, CLASH)
    out = toxicity.drop_toxic(df, labels)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {k for k in range(40) if k % 2 == 0}
    assert toxicity.drop_toxic(frame(spark, [], CLASH), labels).count() == 0


def test_pages_are_judged_one_by_one(spark):
    rows = [(1, "http://a.com/en/x"), (1, "http://a.com/fr/x"), (1, "http://a.com/fr/x"), (2, None), (None, "http://b.net/de/1")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    for name in ("_page_id", *CLASH):
        df = df.withColumn(name, F.lit("own"))
    out = url_filters.filter_pages(df)
    assert out.columns == df.columns and sorted((r.page_id, r.url) for r in out.collect() if r.url) == [(1, "http://a.com/fr/x")] * 2
    assert out.count() == 3
