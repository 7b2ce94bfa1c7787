"""The configuration program: patterns, bounds and plans against enumeration, best fit and the tokens themselves."""

import itertools

import numpy as np
import pyarrow.parquet as pq
import pytest

from factloom.llm import bpe, packing, tokens


def check(plan, need, capacity):
    got = np.zeros(capacity + 1, int)
    for p, k in plan.patterns:
        assert sum(x * c for x, c in p) <= capacity and k > 0
        for x, c in p:
            got[x] += c * k
    assert (got == need).all()
    assert plan.solved + plan.rest == sum(k for _, k in plan.patterns) >= plan.bound


@pytest.mark.parametrize(("n", "seed"), [(0, 0), (1, 1), (30, 2), (800, 3), (5000, 4), (200_000, 5)])
def test_plans_take_each_piece_once(n, seed):
    rng = np.random.default_rng(seed)
    need = np.bincount(np.clip(rng.lognormal(4, 1, n).astype(int), 1, 256), minlength=257)
    plan = packing.plan(need, 256)
    check(plan, need, 256)
    assert plan.solved + plan.rest <= 1.002 * sum(packing.best_fit(need, 256).values()) + 1


def test_the_program_makes_the_plan():
    """On the documents of a test table: no more sequences than best fit, many of them the program's own."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    n = np.array(tokens.count_tokens(bpe.load(bpe.default_path()), [t or "" for t in texts])) + 1
    need = np.bincount((n - 1) % 1024 + 1, minlength=1025)
    need[1024] += ((n - 1) // 1024).sum()
    plan = packing.plan(need, 1024)
    check(plan, need, 1024)
    assert plan.solved + plan.rest <= sum(packing.best_fit(need, 1024).values()) <= 964
    assert plan.bound >= 962 and plan.solved - need[1024] > 0.3 * (plan.solved + plan.rest - need[1024])
    assert packing.plan(100 * need, 1024).rest < 0.7 * 100 * (plan.solved + plan.rest - need[1024])


def test_bound_holds_and_fractions_cover():
    need = np.array([0, 0, 0, 5, 7, 0, 9, 4, 0, 0, 2])  # of at most 10
    found, bound = packing.fractional(need, 10)
    for x in np.flatnonzero(need):
        assert sum(t * dict(p).get(x, 0) for p, t in found.items()) >= need[x] - 1e-6
    assert bound <= sum(found.values()) + 1e-6 and bound <= sum(packing.best_fit(need, 10).values())
    # Pieces of 7 and of 6 and 10 each need a sequence of their own: 4 + 9 + 2.
    assert sum(packing.best_fit(need, 10).values()) >= 15


def test_knapsack_against_all_patterns():
    rng = np.random.default_rng(5)
    for _ in range(30):
        values, many = np.where(rng.random(11) < 0.6, rng.random(11), 0), rng.integers(0, 4, 11)
        values[0] = 0
        sack = packing.Knapsack(values, many, 10)
        brute = max(
            sum(v * k for v, k in zip(values, ks, strict=True))
            for ks in itertools.product(*(range(min(int(m), 10 // x) + 1 if x and values[x] else 1) for x, m in enumerate(many)))
            if sum(x * k for x, k in enumerate(ks)) <= 10
        )
        p = sack.pattern()
        assert abs(sack.best[10] - brute) < 1e-9 and abs(sum(values[x] * k for x, k in p) - brute) < 1e-9
        assert all(k <= many[x] for x, k in p) and sum(x * k for x, k in p) <= 10
