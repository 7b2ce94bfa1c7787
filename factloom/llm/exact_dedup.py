"""Exact duplicates by deterministic block naming (op 9).

A normalised text is cut into blocks of fixed size. Equal blocks get one integer name, different blocks different
ones: blocks are sorted, and each change of content in the sorted order counts the name up. Then names of adjacent
blocks are paired, pairs are sorted and named in the same way, and so on until a document has a single name. A name
stands for a content and never for two, as contents, not hashes, are compared.

Equal blocks (or pairs) of a task meet in one row before the shuffle, with the list of their places, so that a block
which a third of all rows share travels once for each task and not once for each row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, join_groups, keep_rows, parts, store

BLOCK_BYTES = 16_384
#: Places of one content that a row may list; beyond that a further row begins.
PLACES = 4_096
_PLACE = "uid long, doc_id long, idx int, n int, sha binary"
_PLACE_ARROW = pa.struct([("uid", pa.int64()), ("doc_id", pa.int64()), ("idx", pa.int32()), ("n", pa.int32()), ("sha", pa.binary())])
_GATHERED = f"content binary, places array<struct<{_PLACE.replace(' ', ':')}>>".replace(",:", ", ")


def _gather(found: dict[bytes, list[tuple]]):
    content, places = [], []
    for key, at in found.items():
        for i in range(0, len(at), PLACES):
            content.append(key)
            places.append([dict(zip(("uid", "doc_id", "idx", "n", "sha"), p, strict=True)) for p in at[i : i + PLACES]])
    return pa.RecordBatch.from_arrays([pa.array(content, pa.binary()), pa.array(places, pa.list_(_PLACE_ARROW))], names=["content", "places"])


def _blocks(batches):
    """Blocks of ASCII-lower-cased UTF-8 texts; equal ones of a batch of rows in one row."""
    row = TaskContext.get().partitionId() << 40
    for b in batches:
        found: dict[bytes, list[tuple]] = {}
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            data = (text or "").encode().lower()
            sha, n = hashlib.sha256(data).digest(), max(1, -(-len(data) // BLOCK_BYTES))
            for i in range(n):
                found.setdefault(data[i * BLOCK_BYTES : (i + 1) * BLOCK_BYTES], []).append((row, doc_id, i, n, sha))
            row += 1
        yield _gather(found)


def _pairs(batches):
    """Pairs of names as contents; equal ones of a batch of rows in one row."""
    for b in batches:
        found: dict[bytes, list[tuple]] = {}
        for uid, doc_id, idx, n, sha, left, right in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found.setdefault(left.to_bytes(8, "big") + (b"" if right is None else right.to_bytes(8, "big")), []).append((uid, doc_id, idx, n, sha))
        yield _gather(found)


def _names(batches):
    """Integer names of contents that come sorted: one more at each change. Names of partitions don't overlap."""
    name, last = (TaskContext.get().partitionId() << 40) - 1, None
    for b in batches:
        names, places = [], []
        for content, at in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if content != last:
                name, last = name + 1, content
            names += [name] * len(at)
            places.append(at.values)
        flat = pa.concat_arrays(places) if places else pa.array([], _PLACE_ARROW)
        yield pa.RecordBatch.from_arrays([*flat.flatten(), pa.array(names, pa.int64())], names=["uid", "doc_id", "idx", "n", "sha", "name"])


def _named(gathered: DataFrame) -> DataFrame:
    at = gathered.repartition(parts(gathered.sparkSession), "content").sortWithinPartitions("content")
    return at.mapInArrow(_names, f"{_PLACE}, name long")


def identities(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """uid (of the row), doc_id, sha (of the normalised text) and level and name, equal exactly for equal texts."""
    named = store(_named(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_blocks, _GATHERED)), "names")
    keep = ["uid", "doc_id", "sha", "level", "name"]
    done, level = [named.where("n = 1").withColumn("level", F.lit(0)).select(*keep)], 0
    longest = named.agg(F.max("n")).first()[0] or 1
    rest = named.where("n > 1")
    while longest > 1:
        level, longest = level + 1, -(-longest // 2)
        even = F.col("idx") % 2 == 0
        pairs = rest.groupBy("uid", F.expr("idx div 2").cast("int").alias("idx")).agg(
            F.first("doc_id").alias("doc_id"), F.expr("cast(ceil(first(n) / 2) as int)").alias("n"), F.first("sha").alias("sha"), F.max(F.when(even, F.col("name"))).alias("l"), F.max(F.when(~even, F.col("name"))).alias("r")
        )
        named = store(_named(pairs.select("uid", "doc_id", "idx", "n", "sha", "l", "r").mapInArrow(_pairs, _GATHERED)), "names")
        done.append(named.where("n = 1").withColumn("level", F.lit(level)).select(*keep))
        rest = named.where("n > 1")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_duplicates(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null text counts as empty. The row with the largest id of
    a group stays; a null id is less than any other, and of rows with the same id one stays, whichever. An empty
    table gives no rows. Columns besides id and text are not read.
    """
    rows = identities(docs, text=text, id_col=id_col)
    groups = store(rows.groupBy("level", "name").agg(F.max(F.struct("doc_id", "uid")).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    joined = join_groups(rows, groups, ["level", "name"])
    return joined.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; one of each group of equal texts,
    also where a row repeats. An empty table gives no rows."""
    kept = exact_duplicates(docs, text=text, id_col=id_col).where("kept").select("doc_id", F.unhex("text_sha256").alias("sha"), F.lit(False).alias("every"))
    return keep_rows(docs, kept, content=F.translate(F.col(f"`{text}`"), ASCII_UPPER, ASCII_LOWER), id_col=id_col)
