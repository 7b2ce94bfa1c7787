"""Language identification (op 8): multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language are summed over all training texts on the executors; the matrix of log probabilities
(features x languages, bounded by its parameters) is broadcast, and texts are scored in batches as sparse products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

ORDERS = (1, 2, 3)
FEATURES = 1 << 15
#: More languages than this in the training labels is an error, as the matrix is broadcast.
MOST_LANGUAGES = 1_000
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_PIECE = 1_000_000


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of lower-cased texts, in a row, and how many each text has. Runs of anything but letters count
    as one space; n-grams don't span texts."""
    joined = "\n".join(regex.sub(r"[^\p{L}]+", " ", t.lower()) for t in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    stops = codes == 10
    text_of = np.cumsum(stops) - stops
    found, owner = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1), np.uint64)
        broken = np.zeros(len(h), bool)
        for k in range(n):
            part = slice(k, k + len(h))
            h = (h ^ codes[part]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
            broken |= stops[part]
        found.append((h & np.uint64(FEATURES - 1)).astype(np.int64)[~broken])
        owner.append(text_of[: len(h)][~broken])
    order = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    return np.concatenate(found) if found else np.zeros(0, np.int64), order


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and the matrix (FEATURES, languages) of smoothed log probabilities.

    Rows without text or language teach nothing. Counts cover every whole text. Each task sends, for each language, one
    vector of FEATURES counts, which are summed by language and slice of features before they reach the driver.
    """
    slices = 64
    width = FEATURES // slices

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list[str]] = {}
            for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(x, []).append(t)
            for x, texts in by.items():
                for part in _batches(texts):
                    sums[x] = sums.get(x, 0) + np.bincount(features(texts[part])[0], minlength=FEATURES)
        rows = [(x, i, s[i * width : (i + 1) * width].tolist()) for x, s in sums.items() for i in range(slices)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["lang", "part", "counts"])

    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sums = rows.mapInArrow(run, "lang string, part int, counts array<long>")
    total = sums.select("lang", "part", F.posexplode("counts")).groupBy("lang", "part", "pos").agg(F.sum("col").alias("n")).where("n > 0")
    packed = total.groupBy("lang", "part").agg(F.collect_list(F.struct("pos", "n")).alias("at")).collect()
    langs = sorted({r["lang"] for r in packed})
    if len(langs) > MOST_LANGUAGES:
        raise ValueError("too many languages for a broadcast matrix")
    counts = np.zeros((FEATURES, len(langs)))
    for r in packed:
        for pos, n in r["at"]:
            counts[r["part"] * width + pos, langs.index(r["lang"])] = n
    smooth = counts + 0.5
    return langs, np.log(smooth / smooth.sum(0, keepdims=True)) if langs else smooth


def _batches(texts: list[str]):
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= _PIECE:
            yield slice(at, i + 1)
            at, total = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred and score of each row of ``docs``. The score is the posterior probability of the language
    with equal priors. Text that is null or has no letter is ``und`` with score 0, as is all text if there is no model."""
    langs, matrix = model
    held = docs.sparkSession.sparkContext.broadcast(matrix.astype(np.float32))

    def run(batches):
        table = held.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            name, score = [], []
            for part in _batches(texts):
                some = texts[part]
                f, owner = features(some)
                if langs:
                    logp = np.stack([np.bincount(owner, table[f, k], minlength=len(some)) for k in range(len(langs))], 1)
                    p = np.exp(logp - logp.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best = p.argmax(1)
                for i, t in enumerate(some):
                    known = langs and _LETTER.search(t)
                    name.append(langs[best[i]] if known else UNDETERMINED)
                    score.append(float(p[i, best[i]]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows of ``docs`` whose id's crc32 modulo 3 isn't 1, and predicts all rows."""
    model = train(docs.where(fold("doc_id", 3) != 1))
    return predict(docs, model).withColumn("held_out", fold("doc_id", 3) == 1)
