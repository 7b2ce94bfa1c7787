"""Toxicity by weak supervision (op 1).

Voters are words of a lexicon and patterns of writing; each votes toxic, clean or nothing. A generative model of the
votes, with a class for each document and a tree of dependencies between voters, is fitted by
expectation-maximisation: it estimates each voter's accuracy and the correlations of voters that repeat one another.
A linear classifier is trained on the posterior labels and scores every document, in one pass without a shuffle.

The model is fitted on a bounded sample of labelled rows (SAMPLE); only ids and labels of those travel to find them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, store, whole_rows

#: Labelled rows to fit on, at most; taken by a hash of the id, whatever their order.
SAMPLE = 20_000
#: Words that the classifier weighs, at most, and words that vote, at most.
WORDS, LEXICON = 512, 256
STEM = 5
#: A first lexicon, which the labelled rows extend or, where its words say nothing, leave without weight.
SEED = ("idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "worthless", "trash", "pathetic", "scum", "clown", "garbage", "disgusting", "hate", "kill", "ugly", "dumb", "filth", "vermin")
_WORD = regex.compile(r"\p{L}+")
_PATTERNS = (
    ("shouting", lambda t, w, n: sum(x.isupper() and len(x) > 2 for x in w) / n, 0.5),
    ("exclaiming", lambda t, w, n: t.count("!") / n, 0.4),
    ("address", lambda t, w, n: len(re.findall(r"(?i)\byou(?: are|'re)? (?:all |such )?an? \w+", t)) / n, 0.02),
    ("masked", lambda t, w, n: len(re.findall(r"\w[*@$#]{2,}\w?", t)) / n, 0.1),
)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def terms_of(words: list[str]) -> list[str]:
    """Words and, marked with a star, the first STEM letters of longer ones, which inflected forms share."""
    return words + [w[:STEM] + "*" for w in words if len(w) > STEM]


def voter_names(lexicon: list[str]) -> list[str]:
    return [*lexicon, *(p[0] for p in _PATTERNS), "no_lexicon_word"]


def featurise(texts: list[str], words: list[str], lexicon: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features (words, rates of patterns, share of lexicon words) and votes of whole texts."""
    at, lex = {w: i for i, w in enumerate(words)}, {w: i for i, w in enumerate(lexicon)}
    x = np.zeros((len(texts), len(words) + len(_PATTERNS) + 2), np.float32)
    v = np.zeros((len(texts), len(lexicon) + len(_PATTERNS) + 1), np.int8)
    for i, t in enumerate(texts):
        found = words_of(t)
        n, hits = max(1, len(found)), 0
        for w in terms_of(found):
            if (k := at.get(w)) is not None:
                x[i, k] = 1
            if (k := lex.get(w)) is not None:
                v[i, k] = 1
                hits += 1
        raw = _WORD.findall(t)
        for k, (_, rate, most) in enumerate(_PATTERNS):
            r = rate(t, raw, n)
            x[i, len(words) + k] = min(1.0, r / most)
            v[i, len(lexicon) + k] = r >= most
        x[i, -2:] = min(1.0, hits / 4), min(1.0, 50 * hits / n)
        v[i, -1] = 0 if hits else -1
    return x, v


class VoteModel:
    """P(class) and, for each voter, P(vote | class, vote of its parent in the dependency tree)."""

    def __init__(self, prior: float, parent: list[int], table: np.ndarray):
        self.prior, self.parent, self.table = prior, parent, table

    @classmethod
    def fit(cls, votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> VoteModel:
        """votes (documents, voters) in -1, 0, 1. EM from the starting posteriors; the tree follows the voters'
        mutual information given the class, in each of the first rounds anew."""
        v, post = votes + np.int8(1), np.clip(start, 0.02, 0.98)
        model = None
        for k in range(rounds):
            parent = cls.tree(v, post) if k < 3 or model is None else model.parent
            model = cls(float(post.mean()) if len(post) else 0.5, parent, cls.estimate(v, post, parent))
            new = model.posterior(votes)
            done = np.abs(new - post).max(initial=0) < 1e-6
            post = new
            if done:
                break
        return model

    @staticmethod
    def tree(v: np.ndarray, post: np.ndarray) -> list[int]:
        """Maximum spanning tree of mutual information given the class; pairs that say nothing stay apart (-1)."""
        n, m = v.shape
        if n == 0:
            return [-1] * m
        info = np.zeros((m, m))
        for w in (post, 1 - post):
            total = w.sum() + 1e-9
            joint, single = np.zeros((3 * m, 3 * m)), np.zeros(3 * m)
            for at in range(0, n, 2000):  # in slices of rows, for the driver's memory
                part = v[at : at + 2000]
                one = np.concatenate([(part == s).astype(np.float32) for s in range(3)], 1)
                weighed = one * w[at : at + 2000, None].astype(np.float32)
                joint += weighed.T @ one
                single += weighed.sum(0)
            joint, single = joint.reshape(3, m, 3, m) / total, single.reshape(3, m) / total
            ratio = joint / np.maximum(single[:, :, None, None] * single[None, None], 1e-12)
            info += total / n * np.where(joint > 1e-12, joint * np.log(np.maximum(ratio, 1e-12)), 0).sum((0, 2))
        parent, best, left = [-1] * m, info[0].copy() if m else [], set(range(1, m))
        link = [0] * m
        while left:
            k = max(left, key=lambda i: best[i])
            left.discard(k)
            parent[k] = link[k] if best[k] > 3.0 / n else -1
            for i in left:
                if info[k, i] > best[i]:
                    best[i], link[i] = info[k, i], k
        return parent

    @staticmethod
    def estimate(v: np.ndarray, post: np.ndarray, parent: list[int]) -> np.ndarray:
        """log P of vote b of voter j, for class y and its parent's vote a: table[j, y, a, b]; smoothed to the
        voter's own rates."""
        m = v.shape[1]
        out = np.zeros((m, 2, 3, 3))
        for j in range(m):
            for y, w in enumerate((1 - post, post)):
                mine = v[:, j].astype(np.int64)
                own = np.bincount(mine, w, 3) + 0.1
                own /= own.sum()
                joint = np.bincount(v[:, parent[j]].astype(np.int64) * 3 + mine, w, 9).reshape(3, 3) if parent[j] >= 0 else np.tile(np.bincount(mine, w, 3), (3, 1))
                joint = joint + 5 * own
                out[j, y] = np.log(joint / joint.sum(1, keepdims=True))
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        v = votes + np.int8(1)
        s = np.full(len(v), np.log(max(self.prior, 1e-6)) - np.log(max(1 - self.prior, 1e-6)))
        for j, p in enumerate(self.parent):
            a, b = v[:, p].astype(np.int64) if p >= 0 else 0, v[:, j].astype(np.int64)
            s += self.table[j, 1, a, b] - self.table[j, 0, a, b]
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, *, penalty: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both classes weighing the same, by accelerated gradient steps."""
    n, d = x.shape
    w, b = np.zeros(d), 0.0
    if not n:
        return w, b
    weight = np.where(y >= 0.5, 1 / max(1.0, (y >= 0.5).sum()), 1 / max(1.0, (y < 0.5).sum())) / 2
    weight = weight.astype(np.float32)
    rate = 4 / (float(np.einsum("ij,ij->i", x, x).max()) + 1)
    vw, vb = w.copy(), b
    for k in range(rounds):
        e = weight * (1 / (1 + np.exp(-np.clip(x @ vw.astype(np.float32) + np.float32(vb), -30, 30))) - y).astype(np.float32)
        nw, nb = vw - rate * (x.T @ e + penalty / n * vw), vb - rate * e.sum()
        vw, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, b


class Scorer:
    def __init__(self, words: list[str], lexicon: list[str], weights: np.ndarray, bias: float, voters: VoteModel | None):
        self.words, self.lexicon, self.weights, self.bias, self.voters = words, lexicon, weights, bias, voters

    def __call__(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(featurise(texts, self.words, self.lexicon)[0] @ self.weights + self.bias, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Scorer:
    """Fit voters and classifier on labelled texts: rows of ``labels`` with a toxic value, at most ``sample`` of them.

    A document labelled twice counts as often as it is labelled. Without any labelled row, only the seed lexicon and
    the patterns vote, and the classifier learns from what the votes alone say.
    """
    chosen = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = store(rows.select("text", "toxic"), "labelled")

    def count(batches):
        n: dict[str, list[int]] = {}
        total = [0, 0]
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                y = int(y > 0)
                total[y] += 1
                for w in {*terms_of(words_of(t))}:
                    n.setdefault(w, [0, 0])[y] += 1
        n[""] = total
        yield pa.RecordBatch.from_arrays([pa.array([*n], pa.string()), pa.array([x[0] for x in n.values()], pa.int64()), pa.array([x[1] for x in n.values()], pa.int64())], names=["word", "clean", "toxic"])

    counted = store(rows.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "words")
    totals = counted.where("word = ''").first()
    clean, toxic = (totals.clean, totals.toxic) if totals else (0, 0)
    # How far a word's toxic documents are from their share of all: in standard deviations of chance.
    n, share = F.col("toxic") + F.col("clean"), (toxic + 1.0) / (toxic + clean + 2.0)
    z = (F.col("toxic") - n * share) / F.sqrt(n * share * (1 - share) + 1)
    scored = counted.where("word <> ''").select("word", z.alias("z"), "toxic")
    top = scored.orderBy(F.abs("z").desc(), "word").limit(WORDS).collect()
    words = sorted({*SEED, *(r.word for r in top)})
    lexicon = sorted({*SEED, *(r.word for r in sorted(top, key=lambda r: -r.z)[:LEXICON] if r.z > 4 and r.toxic >= 3)})

    def featured(batches):
        for b in batches:
            x, v = featurise(b.column(0).to_pylist(), words, lexicon)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in v], pa.binary()), b.column(1)], names=["x", "v", "y"])

    got = rows.mapInArrow(featured, "x binary, v binary, y int").toPandas()
    width, voters = len(words) + len(_PATTERNS) + 2, len(lexicon) + len(_PATTERNS) + 1
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, width)
    v = np.frombuffer(b"".join(got["v"]), np.int8).reshape(-1, voters)
    y = (got["y"].to_numpy() > 0).astype(float)
    del got
    if not len(y) or y.min() == y.max():
        y = 1 / (1 + np.exp(2.0 - 1.5 * v.astype(float).clip(0).sum(1)))
    model = VoteModel.fit(v, 0.05 + 0.9 * y) if len(y) else None
    if model is None:
        weights = np.zeros(width)
        weights[[words.index(w) for w in lexicon]] = 1.5
        return Scorer(words, lexicon, weights, -3.0, None)
    weights, bias = fit_linear(x, model.posterior(v))
    return Scorer(words, lexicon, weights, bias, model)


def _scores(scorer: Scorer, texts: pa.Array) -> np.ndarray:
    """Scores of texts, of which 500 at a time become Python strings."""
    done = [scorer([t or "" for t in texts.slice(i, 500).to_pylist()]) for i in range(0, len(texts), 500)]
    return np.concatenate(done).astype(float) if done else np.zeros(0)


def score(docs: DataFrame, scorer: Scorer, *, text: str = "text", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """doc_id, score in 0 to 1 and predicted of each row. Null text is scored as empty; ids may be null or repeat."""

    def run(batches):
        for b in batches:
            s = _scores(scorer, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows of ``docs``, learnt from labels of rows whose id's crc32 modulo 5 isn't 0."""
    scorer = train(docs, labels.where(fold("doc_id", 5) != 0))
    out = score(docs, scorer)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` not predicted toxic, with all their columns, whatever their names. A row's own text
    decides, so repeated rows and ids do no harm."""
    pairs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    scorer = train(pairs, labels.where(fold("doc_id", 5) != 0))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scores(scorer, b.column(1)) < threshold)).select(["row"])

    rows = whole_rows(docs, text=F.col(f"`{text}`"))
    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
