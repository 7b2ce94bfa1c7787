"""Token counts (op 2) and BPE encoding and decoding (op 5)."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, wordblocks
from .common import Stored, release, store

ENCODED = "doc_id long, n_tokens long, ids binary"


class _WholeTokens(dict):
    """Tokens of each pre-token: 1 for a string proven whole; the rest is merged, and kept within a bound."""

    LIMIT = 200_000

    def __init__(self, model: bpe.ByteBpe):
        self.model = model
        self.whole = {p.decode() for p in model.whole_tokens() if _utf8(p)}
        super().__init__(dict.fromkeys(self.whole, 1))

    def __missing__(self, piece: str) -> int:
        n = len(self.model._core.encode_single_piece(piece.encode()))
        if len(self) < self.LIMIT + len(self.whole) and len(piece) <= 64:
            self[piece] = n
        return n


@functools.lru_cache(maxsize=2)
def _whole_counts(model: bpe.ByteBpe) -> _WholeTokens:
    return _WholeTokens(model)


def _utf8(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


def count_tokens(model: bpe.ByteBpe, texts: list[str]) -> list[int]:
    """Tokens of whole texts: pre-tokens that are whole tokens count as one by a look-up; only others are merged.

    Text on which splitters may disagree, and files without the proofs, are encoded by the library.
    """
    if not model.proven:
        return [len(e.ids) for e in model.library.encode_batch(texts, add_special_tokens=False)]
    get, out = _whole_counts(model).__getitem__, []
    for text in texts:
        n = 0
        for k, part in enumerate(model.parts(text)):
            if k % 2:
                n += 1
            elif part.isascii() or all(map(bpe.settled, set(part))):
                n += sum(map(get, bpe._PIECES.findall(part)))
            else:
                n += len(model.library.encode(part, add_special_tokens=False).ids)
        out.append(n)
    return out


def token_counts(docs: DataFrame, *, tokenizer: str | None = None, limit: int = 512, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Exact token counts of whole texts, one row per row of ``docs``, in no particular order.

    Null text counts as empty: 0 bytes, 0 tokens, not over the limit. Null and repeated ids are carried through. Other
    columns of ``docs`` are not read. No shuffle; a task's memory is bounded by one batch of texts.
    """
    path = tokenizer or bpe.default_path()

    def run(batches):
        model = bpe.load(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = np.array(count_tokens(model, texts), np.int64)
            size = np.array([len(t.encode()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def split_words(text, special: list[str]):
    """Column of the words (pre-tokens) of a text column, in order; special strings are words of their own. Words in a
    row are the text. Null text has none."""
    words = lambda t: F.regexp_extract_all(t, F.lit("(?U)" + bpe.SPLIT), F.lit(0))
    plain = words(F.coalesce(text, F.lit("")))
    if not special:
        return plain
    either = "|".join(r"\Q" + s + r"\E" for s in sorted(special, key=len, reverse=True))
    cut = F.split(F.regexp_replace(text, f"({either})", "\0$1\0"), "\0")  # texts that hold a NUL themselves go to the library
    parts = F.transform(cut, lambda t: F.when(t.isin(special), F.array(t)).otherwise(words(t)))
    some = functools.reduce(lambda x, y: x | y, [F.contains(text, F.lit(s)) for s in special])
    return F.when(some & F.contains(text, F.lit("\0")), F.array(text)).when(some, F.flatten(parts)).otherwise(plain)


def _block_words(path: str):
    """For ``wordblocks.blocks``: words of texts, with doc_id and, of texts on which splitters of different Unicode
    versions may disagree, the library's ids; such texts give no words."""

    def run(b: pa.RecordBatch):
        model, lists = bpe.load(path), b.column(1)
        words = lists.flatten()
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = words.filter(pc.invert(pc.string_is_ascii(words))).unique().to_pylist()
        odd_words = [w for w in distinct if not all(map(bpe.settled, set(w)))] if model.proven else []
        bad = pc.is_in(words, pa.array(odd_words, words.type)).to_numpy(zero_copy_only=False) if odd_words else np.zeros(len(words), bool)
        if not model.proven:
            bad = np.ones(len(words), bool)
        elif model.special and counts.size:
            # A text that holds both a NUL and a special string came whole.
            whole = pc.and_(pc.match_substring(words, "\0"), pc.invert(pc.is_in(words, pa.array([*model.special], words.type)))).to_numpy(zero_copy_only=False)
            bad = bad | whole
        ends = np.cumsum(counts)
        odd = np.flatnonzero(np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(bad)])[ends]])) > 0)
        found = [np.frombuffer(model.encode_odd("".join(words.slice(int(ends[i] - counts[i]), int(counts[i])).to_pylist())), "<u4") for i in odd.tolist()]
        if len(odd):
            keep = np.ones(len(words), bool)
            for i in odd.tolist():
                keep[ends[i] - counts[i] : ends[i]] = False
            words = words.filter(pa.array(keep))
            counts[odd] = 0
        ids = b.column(0)
        kept = [pc.fill_null(ids, 0).to_numpy().view(np.uint64), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), odd, np.array([len(x) for x in found], np.int64), np.concatenate([*found, np.zeros(0, "<u4")])]
        return words, counts, [], kept

    return run


def encode_block(path: str, b: pa.RecordBatch) -> list[np.ndarray]:
    """Ids of each text of a batch whose column 1 has the texts' words: each distinct word of the batch is encoded once."""
    words, counts, _, (_, _, odd, odd_sizes, odd_ids) = _block_words(path)(b)
    coded = words.dictionary_encode()
    flat, sizes = bpe.load(path).encode_distinct(coded.dictionary.cast(pa.binary()).to_pylist())
    codes = coded.indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    each = sizes[codes]
    ids = flat[wordblocks.gather((np.cumsum(sizes) - sizes)[codes], each)].astype("<u4")
    at = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
    out = [ids[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    for i, x in zip(odd.tolist(), np.split(odd_ids.astype("<u4"), np.cumsum(odd_sizes)[:-1]), strict=False):
        out[i] = x
    return out


def _encode_table(path: str):
    """A shard's table of distinct words: each is encoded once; its ids go to all blocks that have it."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        model, parts = bpe.load(path), [wordblocks.unpack_words(x) for x in rows.column("words").to_pylist()]
        coded = pa.concat_arrays(parts).dictionary_encode()
        flat, sizes = model.encode_distinct(coded.dictionary.to_pylist())
        starts = np.cumsum(sizes) - sizes
        out = []
        for at in np.split(coded.indices.to_numpy().astype(np.int64), np.cumsum([len(p) for p in parts])[:-1]):
            out.append(wordblocks.squeeze(sizes[at], flat[wordblocks.gather(starts[at], sizes[at])]))
        return pa.table([rows.column("block"), rows.column("shard"), pa.array(out, pa.binary())], names=["block", "shard", "ids"])

    return run


def _join_ids(finish):
    """Ids of a block's texts: the words' ids by position. ``finish`` makes columns of all texts' ids."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        counts, codes, shard = wordblocks.wide(wordblocks.unsqueeze(left.column("places")[0].as_py()))
        doc_id, known, odd, odd_sizes, odd_ids = wordblocks.unsqueeze(left.column("rows")[0].as_py())
        found = [(k, *wordblocks.unsqueeze(x)) for k, x in zip(right.column("shard").to_pylist(), right.column("ids").to_pylist(), strict=True)]
        flat = np.concatenate([*(x for _, _, x in found), np.zeros(0, np.uint8)]).astype("<u4")
        sizes = wordblocks.by_code(shard, [(k, n) for k, n, _ in found])
        shift = np.cumsum([0, *(len(x) for _, _, x in found)])
        starts = wordblocks.by_code(shard, [(k, a + np.cumsum(n, dtype=np.int64) - n) for (k, n, _), a in zip(found, shift[:-1], strict=True)])
        each = sizes[codes]
        ids = flat[wordblocks.gather(starts[codes], each)]
        at = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
        out = [ids[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for i, x in zip(odd.tolist(), np.split(odd_ids.astype("<u4"), np.cumsum(odd_sizes.astype(np.int64))[:-1]), strict=False):
            out[i] = x
        names = pa.array(doc_id.astype(np.uint64).view(np.int64), pa.int64(), mask=known == 0)
        return pa.table({"doc_id": names, "n_tokens": pa.array([len(x) for x in out], pa.int64()), **finish(out)})

    return run


def _joined(docs: DataFrame, finish, schema: str, *, tokenizer: str | None, text: str, id_col: str, block_bytes: int) -> DataFrame:
    path = tokenizer or bpe.default_path()
    special = [*bpe.load(path).special]
    shards = wordblocks.shards_for(docs, text)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(split_words(F.col(f"`{text}`"), special), F.array().cast("array<string>")).alias("words"))
    blocks = Stored(wordblocks.blocks(rows, _block_words(path), shards, block_bytes=block_bytes), "blocks", by="kind")
    words = blocks.read().where("kind = 'words'").select("block", "shard", "words")
    table = store(words.groupBy("shard").applyInArrow(_encode_table(path), "block long, shard int, ids binary"), "ids")
    blocks.drop("kind=words")
    release(docs.sparkSession)
    texts = blocks.read().where("kind = 'texts'").select("block", "places", "rows")
    return texts.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(_join_ids(finish), schema)


def encode(docs: DataFrame, *, tokenizer: str | None = None, text: str = "text", id_col: str = "doc_id", block_bytes: int = wordblocks.BLOCK_BYTES) -> DataFrame:
    """Whole texts as token ids: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), one row per row.

    Spark's expressions split texts into words; a table of the distinct words of all texts encodes each word once; ids
    join back by position. Null text encodes as empty, null and repeated ids are carried through, an empty table gives no
    rows, and other columns aren't read. Memory is bounded by a block of texts, or by the longest text.
    """
    out = lambda ids: {"ids": pa.array([x.tobytes() for x in ids], pa.binary())}
    return _joined(docs, out, ENCODED, tokenizer=tokenizer, text=text, id_col=id_col, block_bytes=block_bytes)


@functools.lru_cache(maxsize=2)
def decoder(path: str):
    """A function from ids of a text to the text: each id is joined to its piece, in place order. Ids without a piece
    are an error. The table of pieces is bounded by the tokenizer's file."""
    pieces = bpe.pieces_of(path)
    size = np.zeros(max(pieces) + 1, np.int64)
    size[[*pieces]] = [len(p) for p in pieces.values()]
    there = np.zeros(len(size), bool)
    there[[*pieces]] = True
    table = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(len(size))), np.uint8)

    def run(ids: np.ndarray) -> str:
        if ids.size and (int(ids.max()) >= len(size) or not there[ids].all()):
            raise ValueError("an id has no piece in the vocabulary")
        return bpe.gather(table, size, ids, np.array([len(ids)]))[0].tobytes().decode("utf-8", "replace")

    return run


def decode(encoded: DataFrame, *, tokenizer: str | None = None, keep: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """Adds ``text``: ids joined to the table of pieces by id, in place order. Ids without a piece are an error;
    null ids decode as null."""
    path = tokenizer or bpe.default_path()
    names = [*dict.fromkeys([*keep, "ids"])]

    def run(batches):
        text_of = decoder(path)
        for b in batches:
            out = [text_of(np.frombuffer(raw.as_buffer(), "<u4").astype(np.int64)) if raw.is_valid else None for raw in b.column(names.index("ids"))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(out, pa.string())], names=[*names, "text"])

    kinds = dict(encoded.dtypes)
    return encoded.select(*names).mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", text string")


def round_trip_digests(docs: DataFrame, *, tokenizer: str | None = None, text: str = "text", id_col: str = "doc_id", block_bytes: int = wordblocks.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens and the digests of a text's ids and of what they decode to: ``encode``, then ``decode``, in one
    task. Null text has no ids and decodes as empty."""
    path = tokenizer or bpe.default_path()

    def digests(ids):
        text_of = decoder(path)
        decoded = [hashlib.sha256(text_of(x.astype(np.int64)).encode()).hexdigest() for x in ids]
        return {"ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _joined(docs, digests, schema, tokenizer=path, text=text, id_col=id_col, block_bytes=block_bytes)
