"""Byte-level BPE: exact splitting, merging and a bounded cache of encoded text chunks.

The tokenizer is given as a ``tokenizers`` JSON file. Loading proves what the fast path needs: the merges are
numbered in the order of their ids (so merging by the smallest id of a pair is the file's own merging), no
normaliser, no post-processor and the usual byte-level splitter. Files for which a proof fails, and text with
characters that Unicode assigned after version 3.2 (on which splitters may disagree), go through the library.
"""

from __future__ import annotations

import array
import functools
import itertools
import json
import re
import unicodedata

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text (in characters) that share a table of distinct words: bounds the memory of a task.
BLOCK_CHARS = 1_500_000
_PIECES = regex.compile(SPLIT)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


@functools.cache
def settled(char: str) -> bool:
    """Whether splitters of any Unicode version put this character in the same class."""
    return unicodedata.ucd_3_2_0.category(char) not in ("Cn", "Co") and unicodedata.category(char)[0] == unicodedata.ucd_3_2_0.category(char)[0]


def _pieces(vocab: dict[str, int], special: dict[str, int]) -> dict[int, bytes]:
    """The bytes of each id."""
    back = {c: b for b, c in byte_letters().items()}
    plain = {i: bytes(back[c] for c in s) for s, i in vocab.items() if s not in special and all(c in back for c in s)}
    return plain | {i: s.encode() for s, i in special.items()}


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> dict[int, bytes]:
    """The id-to-piece table of a tokenizer file: all that decoding needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return _pieces(spec["model"]["vocab"], {a["content"]: a["id"] for a in spec.get("added_tokens", [])})


class ByteBpe:
    """A loaded tokenizer. It takes whole texts; special strings in them are special tokens, as the library has it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        vocab = spec["model"]["vocab"]
        special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.special = special
        self.pieces = _pieces(vocab, special)
        self.proven = self._prove(spec, vocab, special) and self._reached(vocab, special)
        self._cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        if self.proven:
            ranks = {self.pieces[i]: i for s, i in vocab.items() if s not in special}
            self._core = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})._core_bpe
            self._ranks = ranks
            self._bytes = np.zeros(max(self.pieces) + 1, np.int64)
            self._bytes[[*self.pieces]] = [len(p) for p in self.pieces.values()]

    @functools.cached_property
    def library(self) -> Tokenizer:
        """The library's own tokenizer, loaded once a text needs it."""
        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    @staticmethod
    def _prove(spec: dict, vocab: dict[str, int], special: dict[str, int]) -> bool:
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        return (
            model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not spec.get("normalizer")
            and not spec.get("post_processor")
            and split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space")
            and split.get("use_regex", True)
            and all(not a["single_word"] and not a["lstrip"] and not a["rstrip"] and not a["normalized"] for a in spec.get("added_tokens", []))
            and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))
            and len({*vocab} - {*special}) == 256 + len(pairs)
        )

    def _reached(self, vocab: dict[str, int], special: dict[str, int]) -> bool:
        """Whether the file's own merges, with no look-up of whole strings, make each vocabulary string of its bytes."""
        merge = Tokenizer.from_file(self.path).model.tokenize
        return all([t.id for t in merge(s)] == [i] for s, i in vocab.items() if s not in special)

    def whole_tokens(self) -> dict[bytes, int]:
        """The vocabulary strings, each proven at load to encode alone, as one pre-token, to its own single id."""
        return dict(self._ranks) if self.proven else {}

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special strings, as little-endian unsigned 32-bit integers."""
        if self.proven and (text.isascii() or all(map(settled, set(text)))):
            return array.array("I", self._core.encode_ordinary(text)).tobytes()
        return array.array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def words(self, text: str) -> list[str] | None:
        """The words of a text in which all white space is single spaces and line ends, else None. A word after a
        line end keeps it; each other but the first stands for itself with a space before. Words encode alone."""
        plain = text.replace("\n", " ").split(" ") == text.split() and not any(s in text for s in self.special)
        return text.replace("\n", " \n").split(" ") if plain else None

    def parts(self, text: str) -> list[str]:
        """Texts between special strings, at even places, and those strings themselves, at odd places."""
        return self._cut.split(text) if self._cut and any(s in text for s in self.special) else [text]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, in a row, and how many each has: one merging pass over their concatenation."""
        spaced = [w if w[:1] == "\n" else " " + w for w in words]
        text = "".join(spaced)
        if not self.proven or not (text.isascii() or all(map(settled, set(text)))):
            each = [self._plain(w) for w in spaced]
            return np.frombuffer(b"".join(each), "<u4"), np.array([len(x) // 4 for x in each], np.int64)
        ids = np.array(self._core.encode_ordinary(text), "<u4")
        lengths = [*map(len, spaced)] if text.isascii() else [len(w.encode()) for w in spaced]
        ends = np.searchsorted(np.cumsum(self._bytes[ids]), np.cumsum(lengths)) + 1 if words else np.zeros(0, np.int64)
        return ids, np.diff(ends, prepend=0)

    def encode_distinct(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, in a row, and how many each has. A special string is its own id."""
        names = {s.encode(): [i] for s, i in self.special.items()}
        if self.proven:
            get, merge = self._ranks.get, self._core.encode_single_piece
            each = [[i] if (i := get(w)) is not None else names.get(w) or merge(w) for w in words]
        else:
            each = [names.get(w) or self.library.encode(w.decode(), add_special_tokens=False).ids for w in words]
        return np.array(list(itertools.chain.from_iterable(each)), np.int64), np.array([*map(len, each)], np.int64)

    def encode_odd(self, text: str) -> bytes:
        """A text that ``words`` refuses: special strings, or runs of white space."""
        if not self.proven:
            return self._plain(text)
        return b"".join(self.special[p].to_bytes(4, "little") if k % 2 else self._plain(p) for k, p in enumerate(self.parts(text)) if p)

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, in a row, and the n + 1 offsets of the texts in it.

        A table of the block's distinct words is encoded, each word once, and joined back by position. The first
        word of a text has no space before it and is encoded by itself, as is a whole text that ``words`` refuses.
        """
        split = [self.words(t) if t else [] for t in texts]
        table = dict.fromkeys(w for s in split if s for w in itertools.islice(s, 1, None))
        ids, sizes = self.encode_words([*table])
        code = dict(zip(table, range(len(table)), strict=True))
        alone, codes, counts, get = [], [], [], code.__getitem__
        for t, s in zip(texts, split, strict=True):
            if s is None or s:
                codes.append(len(table) + len(alone))
                alone.append(self.encode_odd(t) if s is None else self._plain(s[0]))
                codes += map(get, s[1:]) if s else ()
            counts.append(0 if t == "" else len(s or "1"))
        ids = np.concatenate([ids, np.frombuffer(b"".join(alone), "<u4")])
        sizes = np.concatenate([sizes, np.array([len(x) // 4 for x in alone], np.int64)])
        return gather(ids, sizes, np.array(codes, np.int64), np.array(counts, np.int64))

    def encode(self, text: str) -> np.ndarray:
        """The ids of one whole text."""
        return self.encode_block([text])[0]

    def decode(self, ids) -> str:
        """The library's decoding, special tokens kept: an id-to-piece join, then UTF-8."""
        get = self.pieces.__getitem__
        return b"".join(map(get, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")


def gather(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join a ragged table to a sequence of its rows: the rows' values in the sequence's order, and where each of
    the sequence's runs (of ``counts`` codes) begins and ends in them."""
    starts = np.cumsum(sizes) - sizes
    size = sizes[codes]
    ends = np.cumsum(size)
    at = np.repeat(starts[codes] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    return flat[at], np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]


def blocks(texts: list[str | None]):
    """Slices of a list of texts of about BLOCK_CHARS each; a longer text is a slice of its own."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= BLOCK_CHARS:
            yield slice(at, i + 1)
            at, total = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One tokenizer per Python worker and file."""
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
