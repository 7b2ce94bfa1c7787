"""Proposals and similar names against all pairs, and how many pairs are compared."""

import itertools
import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.operators import identity

KINDS = "id string, name string, route string, side string, start_m long, end_m long, namespace string, external_id string"


def words(seed, alphabet, n, longest):
    r = random.Random(seed)
    found = ["".join(r.choices(alphabet, k=r.randint(1, longest))) for _ in range(n)]
    for w in found[: n // 2]:
        i, j = r.randrange(len(w) + 1), r.randrange(len(w))
        found += [w[:i] + r.choice(alphabet) + w[i:], w[:j] + w[j + 1 :], r.choice(alphabet) + w[1:-1] + r.choice(alphabet)]
    return [w for w in found if w]


@pytest.mark.parametrize("alphabet, longest, similar", [("ab", 6, 0.8), ("abcdefgh", 14, 0.8), ("abc😀坡é", 9, 0.8), ("abcd", 8, 0.5), ("ab", 200, 0.9), ("abc", 5, 1.0)])
def test_similar_names_are_all_pairs(spark, alphabet, longest, similar):
    a, b = words(1, alphabet, 40, longest), words(2, alphabet, 40, longest)
    b += a[:5] + [w + alphabet[0] for w in a[5:25]] + ["abcdefghij" * 30, ""]
    a += ["abcdefghi" * 30, "", "abcdefghij" * 29]
    got = identity.similar_names(spark.createDataFrame([(w,) for w in a], "s_name string"), spark.createDataFrame([(w,) for w in b], "m_name string"), similar).collect()
    want = {(x, y) for x, y in itertools.product(a, b) if x and y and x != y and SequenceMatcher(None, x, y).ratio() >= similar}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert want or similar == 1


def scored(s, m):
    """Score and conflicts of one pair, as the docstring says."""
    (_, name, route, side, a, b, space, key), (_, n2, r2, s2, c, d, sp2, k2) = s, m
    same = None not in (a, b, c, d) and (a, b) == (c, d)
    overlap = None not in (a, b, c, d) and max(a, c) <= min(b, d)
    on_route, alike = route is not None and route == r2, bool(name) and bool(n2)
    rules = [(100, space and key and (space, key) == (sp2, k2)), (90, same and on_route and side is not None and side == s2), (70, alike and name == n2), (60, same), (50, overlap and on_route), (25, alike and SequenceMatcher(None, name, n2).ratio() >= 0.8)]
    differ = [k for k, x, y in (("namespace", space, sp2), ("route", route, r2), ("side", side, s2)) if None not in (x, y) and x != y]
    return next((v for v, yes in rules if yes), 0), differ + (["range"] if None not in (a, b, c, d) and not same and not overlap else [])


def test_proposals_are_all_pairs(spark):
    r = random.Random(3)
    names = ["north slope 12", "north slope 21", "xorth slope 1y", "qorth slope 1z", "kay", "", None, "slope north 12"]

    def row(i, p):
        a = r.choice([None, 0, 500, 990, 1000, 2500])
        end = None if a is None or r.random() < 0.1 else a + r.choice([0, 10, 500, 2600, -100])
        return (f"{p}{i}", r.choice(names), r.choice([None, "", "G1", "G2"]), r.choice([None, "L", "R"]), a, end, r.choice([None, "", "n"]), r.choice([None, "", "1", "2"]))

    s, m = [row(i, "s") for i in range(60)], [row(i, "m") for i in range(60)]
    got = identity.proposals(spark.createDataFrame(s + s[:5], KINDS), spark.createDataFrame(m + m[:5], KINDS)).collect()
    want = []
    for x in s:
        found = [(y[0], *scored((x[0], x[1] and x[1].replace(" ", ""), *x[2:]), (y[0], y[1] and y[1].replace(" ", ""), *y[2:]))) for y in m]
        best = sorted((f for f in found if f[1]), key=lambda f: (bool(f[2]), -f[1], f[0]))
        want += [(x[0], y, score, conflicts, place + 1) for place, (y, score, conflicts) in enumerate(best)]
    assert sorted((g.source_id, g.master_id, g.score, g.conflicts, g.place) for g in got) == sorted(want)
    assert {w[2] for w in want} == {100, 90, 70, 60, 50, 25}


def test_names_that_cannot_be_similar_are_not_compared(spark, monkeypatch):
    compared, plain = spark.sparkContext.accumulator(0), identity.name_similarity.func

    @F.pandas_udf("double")
    def counting(a: pd.Series, b: pd.Series) -> pd.Series:
        compared.add(len(a))
        return plain(a, b)

    monkeypatch.setattr(identity, "name_similarity", counting)
    none = [F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in KINDS.split(", ")[2:]]
    side = lambda p: spark.range(400).select(F.concat(F.lit(p), "id").alias("id"), F.format_string(f"{p}#%09d", "id").alias("name"), *none)
    assert identity.proposals(side("Supplier"), side("Customer")).count() == 0
    assert compared.value == 0
