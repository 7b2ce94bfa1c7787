"""Operators on a small fixture with awkward rows, against plain re-computations."""

import collections
import hashlib
import importlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import bpe, exact_dedup, language, lm, near_dedup, packing, quality, tokens, toxicity, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, 20, n), rng.integers(0, 30, n), strict=True))


def corpus():
    rows = [(i, prose(i, 60 + 7 * i), "en" if i % 2 else "de", "s", 0) for i in range(24)]
    base = prose(100, 300).split()
    for k in range(12):
        w = list(base)
        w[5 + 20 * k] = f"changed{k}"
        rows.append((200 + k, " ".join(w), "en", "hot", 0))
    rows += [(300 + k, rows[3][1].upper(), "en", "hot", 0) for k in range(5)]
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0), (402, " \n\t ", "en", "s", 0), (403, "two words", "en", "s", 0), (404, "Two  WORDS", "en", "s", 0), (None, prose(9, 80), "en", "s", 0), (405, "漢字 é 😀 <|endoftext|> " + prose(77, 90), "en", "s", 0)]
    rows += [(406, " ".join([prose(5, 40)] * 300), "en", "s", 0), (7, rows[7][1], "en", "s", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(24)], "doc_id long, quality int, toxic int")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_token_counts(docs, empty):
    model = bpe.load(bpe.default_path())
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs).collect())
    want = collections.Counter()
    for i, t, *_ in corpus():
        n = len(model.library.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 512)] += 1
    assert got == want and tokens.token_counts(empty).count() == 0


def test_round_trip(docs, empty):
    model = bpe.load(bpe.default_path())
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokens.round_trip_digests(docs).collect())
    want = []
    for i, t, *_ in corpus():
        ids = model.library.encode(t or "", add_special_tokens=False).ids
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want) and tokens.round_trip_digests(empty).count() == 0


def test_exact_dedup(docs, empty):
    groups = collections.defaultdict(list)
    for i, t, *_ in corpus():
        groups[(t or "").encode().lower()].append(i)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(corpus())
    by = {hashlib.sha256(k).hexdigest(): v for k, v in groups.items()}
    kept = collections.Counter()
    for r in got:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((x for x in ids if x is not None), default=None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns and out.count() == len(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_names_of_long_texts(spark):
    long_ = "".join(chr(97 + i % 26) for i in range(5 * exact_dedup.BLOCK_BYTES + 7))
    rows = [(1, long_), (2, long_.upper()), (3, long_ + "x"), (4, long_[:-1]), (5, long_[: 4 * exact_dedup.BLOCK_BYTES]), (6, long_[exact_dedup.BLOCK_BYTES :])]
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 2, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}


def test_near_duplicates(docs, empty):
    sets, parent = [], {}
    for i, t, *_ in corpus():
        w = [x.encode().lower() for x in words(t)]
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    want = collections.Counter((i, len(s), min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, s) in enumerate(sets))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect())
    assert got == want
    out = near_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert len(kept) == len(least) and 200 in kept and 201 not in kept
    assert near_dedup.near_duplicates(empty).count() == 0


def test_divide_skip_against_counts():
    rng = np.random.default_rng(1)
    for _ in range(300):
        lists = [sorted(rng.choice(40, rng.integers(1, 30), replace=False).tolist()) for _ in range(rng.integers(1, 15))]
        least = int(rng.integers(1, len(lists) + 2))
        n = collections.Counter(x for at in lists for x in at)
        assert near_dedup.divide_skip(lists, least) == {x: k for x, k in n.items() if k >= least}


def test_quality_figures(docs, empty):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs, keep=("doc_id",)).collect())
    want = collections.Counter()
    for i, t, *_ in corpus():
        w, t = words(t), t or ""
        tri = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        marked = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked), len(w) < 50 or 100 * len(marked) > 50 * len(w))] += 1
    assert got == want
    assert quality.quality(empty).count() == 0 and quality.filter_quality(empty).columns == empty.columns


def test_quality_repeats(spark):
    rows = [(k, t) for k, t in enumerate(["a b c a b c", "a a a a", "a b c d", "x y", "", "a b c x b c a b c", "l\nl\nm\n\n\nl"])]
    out = {r.doc_id: (r.n_repeat_words, r.n_dup_lines) for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), keep=("doc_id",)).collect()}
    assert out == {0: (6, 0), 1: (4, 0), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (6, 0), 6: (0, 2)}


def test_toxicity(spark, docs, labels, empty):
    rows = [(i, prose(i, 80) + (" you idiot scum" if i % 4 == 0 else ""), "en", "s", 0) for i in range(400)]
    d = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(d, marks).collect()}
    held = [r for r in out.values() if r.held_out]
    assert held and all(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.values())
    awkward = toxicity.toxicity(docs, labels).collect()
    assert len(awkward) == len(corpus()) and all(0 <= r.score <= 1 for r in awkward)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).count() == len(corpus())
    assert toxicity.drop_toxic(d, marks).columns == d.columns


def test_vote_model_finds_copied_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    v = np.stack([np.where(rng.random(4000) < a, y, ~y).astype(np.int8) for a in (0.9, 0.85, 0.8)], 1)
    v = np.concatenate([v, v[:, :1]], 1)
    model = toxicity.VoteModel.fit(v, v.mean(1))
    assert 3 in (model.parent[0], *[j for j, p in enumerate(model.parent) if p == 0]) or model.parent[3] == 0
    assert ((model.posterior(v) > 0.5) == y).mean() > 0.88


def test_language(spark, docs, empty):
    texts = {"en": "the quick brown fox jumps over the lazy dog and then", "de": "der schnelle braune fuchs springt ueber den faulen hund", "es": "el rapido zorro marron salta sobre el perro perezoso"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(texts[k].split())), k, "s", 0) for i, k in enumerate([*texts] * 30)]
    out = language.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] and 0 <= r.score <= 1 for r in out) and any(r.held_out for r in out)
    got = language.identify(docs).collect()
    assert len(got) == len(corpus()) and {r.lang_pred for r in got if r.doc_id in (400, 401, 402)} == {"und"}
    assert language.identify(empty).count() == 0


def test_language_scores_against_counts(spark):
    rows = [(i, t, k, "s", 0) for i, (t, k) in enumerate([("aab", "x"), ("abb", "y"), ("aa", "x"), ("bb", "y"), ("ab", "x")])]
    d = spark.createDataFrame(rows, SCHEMA)
    langs, matrix = language.train(d)
    assert langs == ["x", "y"] and matrix.shape == (language.FEATURES, 2)
    p = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(d, (langs, matrix)).collect()}
    for i, t, *_ in rows:
        s = matrix[language.features([t])[0]].sum(0)
        e = np.exp(s - s.max())
        assert p[i][0] == langs[int(s.argmax())] and abs(p[i][1] - e.max() / e.sum()) < 1e-5


def test_packing(docs, empty):
    model = bpe.load(bpe.default_path())
    rows = packing.pack(docs).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for part in by.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    texts = collections.Counter()
    for i, t, *_ in corpus():
        own = np.array(model.library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(own) % 1024 or 1024
        for k, a in enumerate([0, *range(first, len(own), 1024)]):
            part = own[a : first if not k else a + 1024]
            texts[(i, k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == texts
    assert packing.pack(empty).count() == 0
    assert "ids" in packing.pack(docs, with_ids=True).columns


def test_lm(docs, empty):
    rows = corpus()
    train = collections.Counter()
    token = lambda t: [x.encode().lower() for x in words(t)] + [b"\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    for i, t, *_ in rows:
        if not held(i):
            train.update(token(t))
    n, v = sum(train.values()), len(train)
    want = sorted((-1 if i is None else i, held(i), len(token(t)), sum(train[w] > 0 for w in token(t)), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in token(t)), 5)) for i, t, *_ in rows)
    got = lm.score_corpus(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got) and lm.score_corpus(empty).count() == 0


URLS = ["http://A.Example.COM/en/7x?q#f", "https://example.com/en/8", "http://x.net/de/1", "http://example.net/de/8", "ftp://q.org/es/", "http://q.org/es", "nothing", None, "", "http://b.com", "http://netx/de/", "http://u@example.com/en/7", "http://shop.io/cart/2", "a://b://c/en/", "http://evil.com#/en/", "http://x.com/EN/"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "", "x") for i, u in enumerate(URLS)] + [(None, URLS[2], "", "x"), (0, URLS[0], "", "x")], "page_id long, url string, html string, host string")
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else None

    got = url_filters.url_verdicts(pages).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, rule, verdict = judge(URLS[2] if r.page_id is None else URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if "/cart/" in path else "allow"))
    assert url_filters.url_verdicts(pages.limit(0)).count() == 0
    assert url_filters.filter_pages(pages).columns == pages.columns


def test_rule_tokens_are_whole():
    assert url_filters.host_path_rule("allow", "example.com/en/7").tokens == ("example", "com", "en")


def test_pipeline(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rows = corpus() + [(500 + i, prose(500 + i, 90) + (" you idiot scum trash" if i % 3 == 0 else ""), "en", "s", 0) for i in range(90)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(500 + i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "toxicity", "exact dedup", "near dedup", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == names and docs.count() > 0
        if k == 1:
            assert not docs.where(F.col("text").contains("idiot scum trash")).count()
    left = {r.doc_id for r in docs.collect()}
    got = {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert got == left and 300 not in left and len(left & {200 + k for k in range(12)}) == 1 and 1 in left
