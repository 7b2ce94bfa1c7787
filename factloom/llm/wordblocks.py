"""Texts as places in tables of distinct words.

A task cuts its rows into blocks and holds of each block its distinct words and, for each place in a text, which of
them stands there. Words are dealt to shards by their content, so that equal words of all blocks meet in one task,
once for each block and not once for each occurrence; what the shard finds for a word goes back to the blocks by
position. Nothing depends on how rows are dealt but the blocks' own names.

Whole-number columns travel as byte planes of the least width, compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text whose words share a block's table: bounds the memory of a task. Results don't depend on it.
BLOCK_BYTES = 18_000_000
#: Bytes of text for each shard of words.
SHARD_BYTES = 64_000_000
#: Rows of ``blocks``: the words of a block in one shard (shard >= 0; n: counts of them, one for each weight), or
#: its texts (shard -1; places: words by text, words by place, shards by word; rows: columns of its rows). kind: words or texts.
BLOCKS = "block long, shard int, words binary, n binary, places binary, rows binary, n_places long, kind string"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers from 0, of any lengths."""
    head, raw = [len(columns).to_bytes(1, "little")], []
    for c in columns:
        c = np.ascontiguousarray(c)
        if c.dtype != np.uint8:
            c = c.astype("<u8")
            width = max(1, -(-int(c.max()).bit_length() // 8)) if len(c) else 1
            c = np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, :width].T)
        else:
            width = 1
        head += [(c.size // width).to_bytes(8, "little"), width.to_bytes(1, "little")]
        raw.append(c.tobytes())
    return b"".join(head) + zstandard.ZstdCompressor(level=3).compress(b"".join(raw))


def unsqueeze(data: bytes) -> list[np.ndarray]:
    """What ``squeeze`` got, as 64-bit integers, or as bytes where one byte is enough."""
    n, at, shape = data[0], 1, []
    for _ in range(n):
        shape.append((int.from_bytes(data[at : at + 8], "little"), data[at + 8]))
        at += 9
    total = sum(size * width for size, width in shape)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at:], max_output_size=max(1, total)), np.uint8)
    out, at = [], 0
    for size, width in shape:
        part = raw[at : at + size * width]
        at += size * width
        if width > 1:
            whole = np.zeros((size, 8), np.uint8)
            whole[:, :width] = part.reshape(width, size).T
            part = whole.view("<i8").ravel()
        out.append(part)
    return out


def wide(columns: list[np.ndarray]) -> list[np.ndarray]:
    return [c.astype(np.int64) for c in columns]


def offsets(words: pa.Array) -> np.ndarray:
    """Where values of strings, binaries or lists begin, and the last ends."""
    return np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)


def lengths_and_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each string or binary, and all bytes in a row."""
    at = offsets(words)
    data = words.buffers()[2] if len(words) else None
    return np.diff(at).astype(np.int64), np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)


def binaries(lengths: np.ndarray, raw: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw.tobytes())])


def pack_words(words: pa.Array) -> bytes:
    return squeeze(*lengths_and_bytes(words))


def unpack_words(data: bytes) -> pa.Array:
    return binaries(*unsqueeze(data))


def spread(words: pa.Array, n: int) -> np.ndarray:
    """A shard for each word, by its bytes."""
    size, raw = lengths_and_bytes(words)
    out = size.astype(np.uint64)
    filled = np.flatnonzero(size)
    if len(filled):
        starts = np.cumsum(size) - size
        place = (np.arange(len(raw)) - np.repeat(starts, size)).astype(np.uint64)
        mixed = (raw.astype(np.uint64) + np.uint64(1)) * (_MIX ^ (place * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)))
        out[filled] += np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), starts[filled])
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return ((out >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def cuts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows of about even size, ``most`` or a little more; a larger row makes a slice larger."""
    ends = np.cumsum(sizes)
    n = max(1, -(-int(ends[-1]) // most)) if len(ends) else 0
    at = np.unique(np.r_[0, np.searchsorted(ends, np.arange(1, n) * (int(ends[-1]) / n)) + 1, len(sizes)]) if n else []
    for a, b in zip(at, at[1:], strict=False):
        yield slice(int(a), int(b))


def shards_for(docs: DataFrame, text: str) -> int:
    """How many shards a table's words need: by the bytes of its texts."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    return max(8, -(-size // SHARD_BYTES))


def blocks(docs: DataFrame, split: Callable, shards: int, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of ``docs``, whose last column holds texts or lists of words (BLOCKS).

    ``split`` takes a record batch and returns the words of its rows in a row (an Arrow array), how many each row has,
    weights of the rows (a list of columns; ``n`` sums each by word) and columns of whole numbers to keep of the rows.
    """

    def run(batches):
        name = TaskContext.get().partitionId() << 32
        for b in batches:
            last = b.column(b.num_columns - 1)
            if pa.types.is_list(last.type):
                size = np.diff(offsets(last.values)[offsets(last)])
            else:
                size = np.diff(offsets(last))
            for part in cuts(size, block_bytes):
                words, counts, weights, kept = split(b.slice(part.start, part.stop - part.start))
                coded = words.dictionary_encode()
                table = coded.dictionary.cast(pa.binary())
                # Codes by falling frequency: small numbers, which compress.
                codes = coded.indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
                order = np.argsort(-np.bincount(codes, minlength=len(table)), kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                codes, table = rank[codes], table.take(pa.array(order))
                by_word = [np.bincount(codes, np.repeat(w, counts), len(order)).astype(np.int64) for w in weights]
                shard = spread(table, shards)
                out = [(name, -1, None, None, squeeze(counts, codes, shard), squeeze(*kept), len(codes), "texts")]
                for s in np.unique(shard).tolist():
                    at = np.flatnonzero(shard == s)
                    out.append((name, s, pack_words(table.take(pa.array(at))), squeeze(*[w[at] for w in by_word]), None, None, 0, "words"))
                name += 1
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    return docs.mapInArrow(run, BLOCKS)


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``starts`` and have ``sizes``, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def by_code(shard: np.ndarray, found: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """What shards found for a block's words, in the order of the words' codes."""
    out = np.zeros(len(shard), np.int64)
    for s, x in found:
        out[shard == s] = x
    return out
