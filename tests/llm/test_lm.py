"""The language model: seating against enumerated seatings, and scores against plain recounts, however rows are dealt."""

import collections
import itertools
import math
import zlib

import numpy as np
import pytest

from factloom.llm import lm, wordblocks
from factloom.llm.wordblocks import unsqueeze

SCHEMA = "doc_id long, text string"


def corpus(n=60):
    rng = np.random.default_rng(4)
    words = [f"W{k}" for k in range(80)]
    rows = [(k, " ".join(words[int(x)] for x in np.minimum(rng.zipf(1.4, 5 + 11 * k % 97), 80) - 1)) for k in range(n)]
    return [*rows, (60, None), (61, ""), (62, " \t\x0b"), (None, "W1 w2 new"), (3, rows[3][1]), (3, "W1"), (63, "é\x1cx  É\nw0"), (64, " ".join(["hot pair"] * 3000))]


def tokens(t):
    return [x.lower() for x in (t or "").encode().split()] + [b"\n"]


def partitions(c):
    """All seatings of c customers, as lists of tables."""
    if c == 1:
        yield [[0]]
        return
    for rest in partitions(c - 1):
        yield [*rest, [c - 1]]
        for k in range(len(rest)):
            yield [[*t, c - 1] if i == k else t for i, t in enumerate(rest)]


@pytest.mark.parametrize("d", [0.3, 0.8])
def test_tables_are_drawn_as_enumerated_seatings_have_them(d):
    c, theta, p, n = 6, 1.5, 0.3, 60_000
    want = np.zeros(c + 1)
    for tables in partitions(c):
        w = math.prod((theta + d * k) * p for k in range(len(tables)))
        want[len(tables)] += w * math.prod(math.prod(m - d for m in range(1, len(t))) for t in tables)
    got = np.bincount(lm.Tables(d, 16).draw(np.random.default_rng(1), np.full(n, c), np.full(n, theta), np.full(n, p)), minlength=c + 1) / n
    assert np.abs(got - want / want.sum()).max() < 0.01


@pytest.mark.parametrize("d", [0.3, 0.6, 0.85])
def test_scaling_law_beyond_exact_numbers(d):
    c, n = 6000, 3000
    exact = np.full(c + 1, -np.inf)
    exact[1] = 0.0
    k = np.arange(1, c + 1)
    for x in range(1, c):
        stay = exact[1:] + np.log(np.maximum(x - d * k, 1e-300))
        exact = np.r_[-np.inf, np.logaddexp(np.where(k <= x, stay, -np.inf), exact[:-1])]
    for theta, p in ((1.0, 0.5), (500.0, 0.01), (5000.0, 0.05), (300.0, 0.9)):
        w = exact[1:] + np.cumsum(np.log(theta + d * (k - 1))) + k * math.log(p)
        w = np.exp(w - w.max())
        w /= w.sum()
        mean, sd = (w * k).sum(), math.sqrt((w * k**2).sum() - (w * k).sum() ** 2)
        got = lm.tables_of(d).draw(np.random.default_rng(2), np.full(n, c), np.full(n, theta), np.full(n, p))
        assert abs(got.mean() - mean) < 0.02 * mean + 0.1 * sd and abs(got.std() / max(sd, 0.1) - 1) < 0.1


def test_tables_of_many_customers():
    """Of ever more customers the number of tables tends to a negative binomial variable, whose mean is known."""
    n, theta, p, d = 400, 2000.0, 0.5, 0.8
    few = lm.tables_of(d).draw(np.random.default_rng(0), np.array([0, 1, 2, 1000]), np.full(4, theta), np.full(4, p))
    assert few[0] == 0 and few[1] == 1 and 1 <= few[2] <= 2 and 300 < few[3] < 1000
    many = lm.tables_of(d).draw(np.random.default_rng(0), np.full(n, 10**9), np.full(n, theta), np.full(n, p))
    assert abs(many.mean() / (theta / d * p / (1 - p)) - 1) < 0.02


def collected(df):
    return sorted(((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.held_out, r.score, round(r.base_score, 9)) for r in df.collect()))


@pytest.mark.parametrize("cell_tokens", [lm.CELL_TOKENS, 700])
def test_scores_do_not_depend_on_how_rows_are_dealt(spark, cell_tokens):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    got = [collected(lm.score_corpus(docs.repartition(n), cell_tokens=cell_tokens, block_bytes=size)) for n, size in ((1, 8_000_000), (7, 500))]
    assert got[0] == got[1]
    train = collections.Counter()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    for i, t in corpus():
        if not held(i):
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    want = sorted((-1 if i is None else i, len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, held(i), round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in corpus())
    assert sorted((*r[:5], round(r[6], 6)) for r in got[0]) == want


@pytest.mark.parametrize("cell_tokens", [lm.CELL_TOKENS, 700])
def test_scores_are_those_of_the_seatings(spark, cell_tokens):
    """Predictions recomputed in plain arithmetic, from customers and tables of all cells."""
    docs = spark.createDataFrame(corpus(), SCHEMA)
    model = lm.learn(docs, lm.fold("doc_id", 7) != 2, cell_tokens=cell_tokens)
    assert (len(model.cells.hot) > 0) == (cell_tokens == 700)
    names = {}
    rows = docs.select(lm.F.col("doc_id"), lm.F.lit(True), lm.F.coalesce("text", lm.F.lit("")))
    shards = wordblocks.shards_for(docs, "text")
    words = wordblocks.blocks(rows, lm._split, shards).where("shard >= 0")
    for r in words.groupBy("shard").applyInArrow(keep_words(lm._names(shards, cell_tokens)), "words array<binary>, ids array<long>").collect():
        names |= dict(zip(map(bytes, r.words), r.ids, strict=True))
    cells = {r.cell: lm.Cell(r.pairs) for r in model.built.read().where("cell >= 0").collect()}
    means = collections.defaultdict(float)
    for parent, state, totals in model.kept:
        d, theta, t2, c2, t0 = parent.d, parent.strength, {}, {}, {}
        for r in state.read().where("shard = -1").collect():
            cell, (tables, root) = cells[r.cell], lm.wide(unsqueeze(r.data))
            t2 |= {(w, u): t for w, u, t in zip(cell.w.tolist(), cell.u.tolist(), tables.tolist(), strict=True)}
            c2 |= {(w, u): c for w, u, c in zip(cell.w.tolist(), cell.u.tolist(), cell.c.tolist(), strict=True)}
            t0 |= dict(zip(cell.words.tolist(), root.tolist(), strict=True))
        t0 |= dict(zip(model.cells.hot.tolist(), parent.t.tolist(), strict=True))
        c0, cu, tu = collections.Counter(), collections.Counter(), collections.Counter()
        for (w, u), t in t2.items():
            c0[w] += t
            tu[u] += t
            cu[u] += c2[w, u]
            assert (t == 0) == (c2[w, u] == 0) and t <= c2[w, u]
        assert all(1 <= t0[w] <= c for w, c in c0.items() if c)
        big_c, big_t = sum(c0.values()), sum(t0.values())
        assert (big_c, big_t) == (parent.customers, parent.tables)

        def p0(w, c0=c0, t0=t0, big_c=big_c, big_t=big_t, d=d, theta=theta):
            return (max(c0[w] - d[0] * t0.get(w, 0), 0) + (theta[0] + d[0] * big_t) / (model.n_words + 1)) / (theta[0] + big_c)

        def p2(w, u, c2=c2, t2=t2, cu=cu, tu=tu, d=d, theta=theta, p0=p0):
            own = max(c2.get((w, u), 0) - d[1] * t2.get((w, u), 0), 0)
            return (own + (theta[1] + d[1] * tu[u]) * p0(w)) / (theta[1] + cu[u])

        seen = [w for w in c0 if c0[w]]
        for u in itertools.islice(cu, 20):  # over all words and one unknown, probabilities sum to one
            assert abs(sum(p2(w, u) for w in seen) + p2(-1, u) - 1) < 1e-9
        for w, u in c2:
            means[w, u] += p2(w, u) / len(model.kept)
    want = []
    for _, t in corpus():
        ids = [names[w] for w in tokens(t)[:-1]]
        want.append(sum(math.log10(means[w, u]) for w, u in zip([*ids, lm.END], [lm.START, *ids], strict=True)))
    got = sorted(r.score for r in lm.scores(model).collect())
    assert np.abs(np.array(got) - np.array(sorted(want))).max() < 1e-3


def keep_words(name):
    import pyarrow as pa

    def run(key, rows):
        out = name(key, rows).slice(0, rows.num_rows)
        ids = [unsqueeze(x)[0].tolist() for x in out.column("ids").to_pylist()]
        return pa.table({"words": pa.array([wordblocks.unpack_words(x).to_pylist() for x in rows.column("words").to_pylist()], pa.list_(pa.binary())), "ids": pa.array(ids, pa.list_(pa.int64()))})

    return run


def test_model_learns(spark):
    """Held-out texts in which each word foretells the next score far better than word counts say."""
    chain = [f"c{k}" for k in range(50)]
    rows = [(k, " ".join(chain[(k * 7 + j) % 50] for j in range(40))) for k in range(80)]
    got = lm.score_corpus(spark.createDataFrame(rows, SCHEMA)).where("held_out").collect()
    assert got and all(r.score > 0.4 * r.base_score for r in got)


def test_empty_tables_and_nothing_to_learn(spark):
    assert lm.score_corpus(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    (r,) = lm.score_corpus(spark.createDataFrame([(alone, "a b a")], SCHEMA)).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 4, 0, 0, 0.0, 0.0)


def test_columns_pack():
    rng = np.random.default_rng(1)
    cols = [rng.integers(0, 1 << 62, 500), rng.integers(0, 3, 50).astype(np.uint8), np.zeros(0, np.int64), np.arange(9), np.array([1 << 32])]
    assert all((a == b).all() for a, b in zip(wordblocks.unsqueeze(wordblocks.squeeze(*cols)), cols, strict=True))
