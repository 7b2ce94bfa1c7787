"""Tokens: the fast paths against the library, on awkward strings."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import bpe, tokens

MODEL = bpe.load(bpe.default_path())
PARTS = [" ", "\n", "  ", "\t", "a", "b'", "'s", "The", " the", "é", "ñ", "1", "12", ".", "!!", "<|endoftext|>", "\u0558", "\u3000", "\x85", "\x1c", "\x00", "😀", "漢字", "ا", "\u0301", "\r\n", "'ll", "\u00a0", "½", "Ⅷ", "\U0001f9ff", "ẞ", " q", "\u200b"]


def library(text):
    return MODEL.library.encode(text, add_special_tokens=False).ids


def test_proofs_hold():
    assert MODEL.proven and len(MODEL.whole_tokens()) == 50256


def test_random_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    ids, at = MODEL.encode_block(texts)
    counts = tokens.count_tokens(MODEL, texts)
    for k, (t, a, b) in enumerate(zip(texts, at, at[1:], strict=False)):
        want = library(t)
        assert ids[a:b].tolist() == want and counts[k] == len(want)
        assert MODEL.decode(ids[a:b]) == MODEL.library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_any_text(text):
    assert MODEL.encode(text).tolist() == library(text)


def test_empty_block():
    ids, at = MODEL.encode_block([])
    assert len(ids) == 0 and at.tolist() == [0]
    ids, at = MODEL.encode_block(["", ""])
    assert at.tolist() == [0, 0, 0]


def test_blocks_cover_all():
    texts = ["x" * 10, None, "y" * (2 * bpe.BLOCK_CHARS), "z", ""]
    assert [x for s in bpe.blocks(texts) for x in texts[s]] == texts
