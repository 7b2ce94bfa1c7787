"""Very long texts through the operators that hold a text whole, and the pipeline on awkward and empty tables."""

import importlib
import zlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import language, lm, near_dedup, quality, tokens, toxicity, url_filters

LONG = "the quick brown fox jumps over a lazy dog number {} \n"


@pytest.fixture(scope="module")
def docs(spark):
    long_ = "".join(LONG.format(k) for k in range(40_000))  # 2 MB
    rows = [(1, long_), (2, long_.upper()), (3, long_[:-9]), (4, "x" * 3_000_000), (5, "z " * 500_000), (6, None), (7, "")]
    rows += [(k, LONG.format(k) * 5) for k in range(10, 30)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


def test_long_texts_are_scored_whole(spark, docs):
    got = {r.doc_id: r for r in lm.score_corpus(docs).collect()}
    assert len(got) == 27 and got[1].score == got[2].score and got[1].n_tokens == 40_000 * 11 + 1 and got[4].n_tokens == 2
    assert got[5].n_tokens == 500_001 and got[6].score == got[7].score


def test_long_texts_meet_their_copies(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got[1] == got[2] and got[3][1] == 1 and got[4] == (1, 4) and got[5] == (1, 5)


def test_long_texts_have_a_language_and_a_verdict(spark, docs):
    labelled = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("en"))
    assert {r.doc_id: r.lang_pred for r in language.identify(labelled).collect()}[6] == language.UNDETERMINED
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 7 == 0).cast("int").alias("toxic"))
    scores = toxicity.toxicity(docs, labels).collect()
    assert len(scores) == 27 and all(0 <= r.score <= 1 for r in scores)
    figures = {r.doc_id: r for r in quality.quality(docs, keep=("doc_id",)).collect()}
    assert figures[1].n_words == 400_000 + 40_000 and figures[5].n_repeat_words == 500_000 and figures[6].n_words == 0


def test_long_texts_are_counted_as_the_library_does(docs):
    from factloom.llm import bpe

    model = bpe.load(bpe.default_path())
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs.where("doc_id in (1, 5, 6)")).collect()}
    want = {r.doc_id: len(model.library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.where("doc_id in (1, 5, 6)").collect()}
    assert got == want


def test_ties_of_words_do_not_depend_on_how_rows_are_dealt(spark):
    rows = [(k, f"tie{k % 5}a tie{k % 5}b plain text of row {k % 3}") for k in range(200)]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(200)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = ({r.doc_id: round(r.score, 4) for r in toxicity.toxicity(docs.repartition(n), labels).collect()} for n in (1, 6))
    assert a == b


@pytest.mark.parametrize("n", [0, 40])
def test_pipeline_on_repeated_rows_and_on_none(spark, tmp_path, n):
    pipeline = importlib.import_module("corpus_pipeline")
    text = lambda k: " ".join(f"word{k}x{j}" for j in range(90))
    rows = [(k // 2, text(k // 2), "own") for k in range(n)] + ([(None, None, "own"), (None, None, "own")] if n else [])
    docs = spark.createDataFrame(rows, "doc_id long, text string, _sha string")
    docs.withColumn("row", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, 1, 0) for k in range(n // 2) if zlib.crc32(str(k).encode()) % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in got}) == list(range(n // 2)) and len([r for r in got if r.piece == 0]) == n // 2


def test_rules_that_share_no_token_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert [r.verdict for r in url_filters.url_verdicts(pages, ()).collect()] == ["allow"]
    assert url_filters.url_verdicts(pages.limit(0)).count() == 0 and url_filters.filter_pages(pages.limit(0)).count() == 0
