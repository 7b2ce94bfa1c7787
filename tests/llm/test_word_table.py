"""Encoding through the distinct-word table: the library's ids for all texts, however rows are dealt into blocks."""

import random

import numpy as np
import pytest
from test_bpe import MODEL, PARTS, library

from factloom.llm import tokens


def texts():
    rng = random.Random(3)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    return [*out, None, "", "x" * 5000, "the " * 20_000, "<|endoftext|>" * 50, "a\0b <|endoftext|>  c", "a\0b", "  <|endoftext|>  ", "$1 \\Q \\E $0"]


@pytest.mark.parametrize(("parts", "block"), [(1, 8_000_000), (3, 2_000)])
def test_ids_are_the_librarys(spark, parts, block):
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in tokens.decode(tokens.encode(docs, block_bytes=block)).collect())
    want = []
    for i, t in rows:
        ids = library(t or "")
        want.append((-1 if i is None else i, len(ids), np.array(ids, "<u4").tobytes(), MODEL.library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_words_are_encoded_once(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "same words in all of the texts") for k in range(400)], "doc_id long, text string").repartition(5)
    assert tokens.encode(docs, block_bytes=100).select("ids").distinct().count() == 1
    assert tokens.encode(docs.limit(0)).count() == 0
