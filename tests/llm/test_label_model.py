"""The label model of the quality rules: rates it learns, documents it keeps against a bad vote, and the same in SQL."""

import collections
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import quality
from factloom.llm.quality import LabelModel


def votes(n, seed=1):
    """Documents of a good class and two bad ones, by rules of known rates; rule 5 votes bad on a tenth of all, by chance."""
    rng = np.random.default_rng(seed)
    kind = rng.choice(3, n, p=[0.85, 0.1, 0.05])
    bad = np.array([[0.01, 0.01, 0.01, 0.01, 0.0, 0.1], [0.9, 0.7, 0.01, 0.01, 0.0, 0.1], [0.01, 0.01, 0.9, 0.8, 0.0, 0.1]])[kind]
    return kind, np.where(rng.random((n, 6)) < bad, -1, np.where(rng.random((n, 6)) < 0.9, 1, 0))


def counted(v):
    return collections.Counter(map(tuple, v.tolist()))


def test_rates_and_shares_are_learnt():
    kind, v = votes(40_000)
    model = LabelModel.fit(counted(v))
    assert LabelModel.kinds(counted(v)) == [[0, 1], [2, 3]]
    assert np.allclose(model.prior, [0.85, 0.1, 0.05], atol=0.04)
    assert abs(model.rates[1][0][-1] - 0.9) < 0.15 and abs(model.rates[2][3][-1] - 0.8) < 0.15
    said = np.array([model.posterior(tuple(x)) >= 0.5 for x in v.tolist()])
    # Who knew all shares and rates could do no better than this by much.
    bad = np.array([[0.01, 0.01, 0.01, 0.01, 0.0, 0.1], [0.9, 0.7, 0.01, 0.01, 0.0, 0.1], [0.01, 0.01, 0.9, 0.8, 0.0, 0.1]])
    rates = np.where(v[:, None] < 0, bad, np.where(v[:, None] > 0, 0.9, 0.1) * (1 - bad))
    best = (np.array([0.85, 0.1, 0.05]) * rates.prod(2)).argmax(1) == 0
    assert (said == (kind == 0)).mean() > (best == (kind == 0)).mean() - 0.02


def test_documents_stay_against_the_bad_vote_of_a_rule_that_votes_at_random():
    kind, v = votes(40_000, 2)
    model = LabelModel.fit(counted(v))
    alone = (v[:, 5] < 0) & (v[:, :5] >= 0).all(1)
    assert alone.sum() > 2000 and all(model.posterior(p) >= 0.9 for p in {tuple(x) for x in v[alone].tolist()})
    assert abs(model.rates[0][5][-1] - 0.1) < 0.015
    # It also neither saves nor condemns: two bad votes of a group that agree still reject.
    assert model.posterior((-1, -1, 1, 1, 1, 1)) < 0.1 and model.posterior((-1, -1, 1, 1, 1, -1)) < 0.1


def test_results_are_alike_at_every_size():
    _, v = votes(20_000, 3)
    few = counted(v)
    a, b = LabelModel.fit(few), LabelModel.fit({p: 50 * n for p, n in few.items()})
    assert all(abs(a.posterior(p) - b.posterior(p)) < 1e-6 for p in few)


def test_posterior_is_bayes_rule():
    _, v = votes(5_000, 4)
    m = LabelModel.fit(counted(v))
    for p in itertools.islice(counted(v), 30):
        joint = [s * math.prod(row[r][x] for r, x in enumerate(p)) for s, row in zip(m.prior, m.rates, strict=True)]
        assert abs(m.posterior(p) - joint[0] / sum(joint)) < 1e-9


@pytest.mark.parametrize("patterns", [{}, {(1, 1, 1): 5}, {(-1, -1, -1): 4}, {(-1, 1): 1, (1, -1): 1}])
def test_few_patterns(patterns):
    m = LabelModel.fit(patterns)
    assert all(0 <= m.posterior(p) <= 1 for p in patterns)


def test_columns_say_what_the_model_says(spark):
    _, v = votes(3_000, 5)
    m = LabelModel.fit(counted(v))
    rows = [(list(p),) for p in counted(v)]
    got = spark.createDataFrame(rows, "votes array<int>").withColumn("p", m.column()).collect()
    assert all(abs(r.p - m.posterior(tuple(r.votes))) < 1e-9 for r in got)


def test_kept_is_the_verdict_of_posterior_and_base_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    got = quality.quality(docs, keep=("doc_id",)).join(labels, "doc_id", "left").collect()
    patterns = collections.Counter(tuple(r.votes) for r in got)
    m = LabelModel.fit(patterns)
    for r in got:
        assert abs(r.p_good - m.posterior(tuple(r.votes))) < 1e-9
        assert r.kept == (not (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.p_good >= 0.5)
    assert all(r.kept or r.base_failed for r in got if r.label == 1) and not any(r.kept for r in got if r.label == 0)
