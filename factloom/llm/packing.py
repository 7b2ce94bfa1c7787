"""Packing documents into sequences (op 6): a configuration linear program over the length histogram.

Documents longer than a sequence are cut; what is left is a histogram of piece lengths, whose size depends on the
sequence length only. The program's columns are patterns (multisets of lengths that fit in a sequence); its
covering constraints ask that each length is taken as often as it occurs. Multiplicative weights solve it: prices of
lengths fall as they are covered, and the best pattern at current prices is a knapsack, found by dynamic programming.
The fractional answer is rounded, what is left is solved again, and best fit, largest first, packs the rest, on the
histogram too. Pieces then find their places by their rank within their length, so no group of pieces is ever gathered.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, tokens, wordblocks
from .common import store

SEQUENCE, END = 1024, 2
#: Rounds of multiplicative weights at most, lengths served in each, the part of what a pattern could use that it gets
#: in a step, and how fast prices fall with cover.
ROUNDS, WIDTH, STEP, RATE = 400, 32, 0.1, 5.0
#: Roundings at most, the share of what is left that each takes, and the part of a sequence that it may leave empty.
ROUNDINGS, SHARE, WASTE = 4, 0.3, 256
#: Bytes of text whose words are encoded together.
BLOCK_BYTES = 4_000_000
#: Pieces of one length are ranked within so many slices of them.
SLICES = 64

Pattern = tuple[tuple[int, int], ...]  # (length, how often), lengths falling


class Knapsack:
    """The most valuable patterns that fit: of each length x at most ``many[x]`` pieces, each worth ``values[x]``."""

    def __init__(self, values: np.ndarray, many: np.ndarray, capacity: int):
        self.capacity, self.items = capacity, []
        best = np.zeros(capacity + 1)
        taken = []
        for x in range(capacity, 0, -1):
            left, k = min(int(many[x]), capacity // x) if values[x] > 0 else 0, 1
            while left > 0:  # counts are written as sums of 1, 2, 4, ... and a rest
                k = min(k, left)
                more = best[: capacity + 1 - k * x] + k * values[x]
                took = np.zeros(capacity + 1, bool)
                took[k * x :] = more > best[k * x :] + 1e-12
                best[k * x :] = np.maximum(best[k * x :], more)
                self.items.append((x, k))
                taken.append(took)
                left, k = left - k, 2 * k
        self.best, self.taken = best, taken

    def pattern(self, first: int = 0) -> Pattern:
        """The best pattern, or the best that holds a piece of length ``first`` beside what fits with it."""
        found, room = Counter([first] if first else []), self.capacity - first
        for (x, k), took in zip(reversed(self.items), reversed(self.taken), strict=True):
            if took[room]:
                found[x] += k
                room -= k * x
        return tuple(sorted(found.items(), reverse=True))


def fractional(need: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP, rate: float = RATE, width: int = WIDTH) -> tuple[dict[Pattern, float], float]:
    """Patterns and how often to use each, in fractions, so that each length is covered as often as it is needed, and a
    bound: no solution uses fewer sequences.

    Multiplicative weights: a length's price is its size times exp(-rate * cover), where cover is the share of it that is
    covered, in units of the least step. A round prices patterns by one knapsack and gives the best that holds each of
    the ``width`` lengths that lag most the part ``step`` of what it could use; so cover grows evenly. Prices divided by
    the value of the best pattern are a solution of the dual, whose worth bounds all solutions.
    """
    lengths = np.flatnonzero(need)
    used: Counter[Pattern] = Counter()
    cover, bound = np.zeros(capacity + 1), 0.0
    if not len(lengths):
        return {}, 0.0
    for _ in range(rounds):
        low = cover[lengths].min()
        if low >= 1:
            break
        price = np.zeros(capacity + 1)
        price[lengths] = lengths * np.exp(-rate * (cover[lengths] - low))
        sack = Knapsack(price, need, capacity)
        bound = max(bound, float((need * price).sum() / sack.best[capacity]))
        for x in lengths[np.lexsort((-lengths, cover[lengths]))][:width].tolist():
            p = sack.pattern(x)
            if any(k > need[y] for y, k in p):
                p = tuple((y, min(k, int(need[y]))) for y, k in p)
            times = step * min(need[y] / k for y, k in p)
            used[p] += times
            for y, k in p:
                cover[y] += k * times / need[y]
    low = max(cover[lengths].min(), step)
    return {p: times / max(1.0, low) for p, times in used.items()}, bound


def best_fit(need: np.ndarray, capacity: int) -> dict[Pattern, int]:
    """Best fit, largest first, on a histogram: equal pieces go together into bins with equal room."""
    room: dict[int, Counter[Pattern]] = {}
    for x in range(capacity, 0, -1):
        left = int(need[x])
        # Full copies of x alone first, then the tightest open bins.
        for r in sorted(r for r in room if r >= x):
            while left and r in room and room[r]:
                p, n = room[r].popitem()
                fits = r // x
                take = min(n, -(-left // fits) if fits else 0)
                whole = min(take, left // fits)
                if whole:
                    _put(room, r - fits * x, p + ((x, fits),), whole)
                    left -= whole * fits
                if take > whole and left:
                    _put(room, r - left * x, p + ((x, left),), 1)
                    left, whole = 0, whole + 1
                if n > whole:
                    room[r][p] += n - whole
                    break
            if r in room and not room[r]:
                del room[r]
            if not left:
                break
        fits = capacity // x
        if left // fits:
            _put(room, capacity - fits * x, ((x, fits),), left // fits)
        if left % fits:
            _put(room, capacity - left % fits * x, ((x, left % fits),), 1)
    out: Counter[Pattern] = Counter()
    for held in room.values():
        out.update(held)
    return dict(out)


def _put(room: dict[int, Counter[Pattern]], left: int, p: Pattern, n: int) -> None:
    room.setdefault(left, Counter())[p] += n


@dataclass
class Plan:
    """``patterns`` with whole counts that take each length exactly as often as it occurs. ``solved`` of the sequences
    are the program's, ``rest`` hold what rounding left; no plan has fewer than ``bound``."""

    patterns: list[tuple[Pattern, int]]
    solved: int
    rest: int
    bound: int


def plan(need: np.ndarray, capacity: int) -> Plan:
    """The configuration program solved in fractions, of which a rounding takes a share in whole sequences; then what is
    left is solved and rounded again. After each rounding, best fit packs the rest; of these plans (all with at least one
    rounding) one with the fewest sequences is taken, and of several the one that the program made most of.

    A rounding skips patterns that leave over 1 / WASTE of a sequence empty, so pieces without good partners stay for
    best fit. Pieces as long as a sequence fill one each. The work depends on ``capacity``, not on how many pieces
    there are.
    """
    size = np.arange(capacity + 1)
    left, whole = need.astype(np.int64).copy(), int(need[capacity])
    taken: Counter[Pattern] = Counter({((capacity, 1),): whole} if whole else {})
    left[capacity] = 0
    now = int((left * size).sum())
    best, bound = (whole, whole, dict(taken), {}) if not now else None, whole + now / capacity
    for k in range(ROUNDINGS if now else 0):
        before, running = now, 0.0
        found, least = fractional(left, capacity)
        bound = bound if k else max(bound, whole + least)
        share = SHARE * now / sum(t * sum(y * k for y, k in p) for p, t in found.items())
        for p, times in sorted(found.items()):
            # Fractions are rounded so that their running sum is: lengths stay covered evenly.
            running, n = running + share * times, int(running + share * times) - int(running)
            n = min([n, *(int(left[x]) // k for x, k in p)])
            filled = sum(y * k for y, k in p)
            if n > 0 and (capacity - filled) * WASTE <= capacity:
                taken[p] += n
                for x, k in p:
                    left[x] -= n * k
                now -= n * filled
        rest, solved = best_fit(left, capacity), sum(taken.values())
        total = solved + sum(rest.values())
        if not best or (total, -solved) < (best[0], -best[1]):
            best = (total, solved, dict(taken), rest)
        if now in (0, before):
            break
    total, solved, taken, rest = best
    patterns = Counter(taken)
    patterns.update(rest)
    return Plan(sorted(patterns.items(), reverse=True), solved, total - solved, math.ceil(bound - 1e-6))


def slots(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Where pieces go, by length and rank: runs of ranks with the sequence of the first, how many of that length
    each sequence takes, and their first offset. Sorted by length, then first rank."""
    rows, ranks, sequence = [], Counter(), 0
    for p, n in patterns:
        offset = 0
        for x, k in p:
            rows.append((x, ranks[x], sequence, k, offset))
            ranks[x] += n * k
            offset += x * k
        sequence += n
    rows.sort()
    names = ("length", "rank", "sequence", "each", "offset")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def pieces(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = SEQUENCE, end: int = END, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pieces of tokenized documents with an end token: doc_id, row (of the document), piece, start, length, ids.
    Only documents of over ``capacity`` tokens are cut; their first piece takes what isn't a whole sequence."""
    path = tokenizer or bpe.default_path()

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            lists = b.column(1)
            at = wordblocks.offsets(lists)
            for part in wordblocks.cuts(np.diff(wordblocks.offsets(lists.values)[at]), BLOCK_BYTES):
                ids = tokens.encode_block(path, b.slice(part.start, part.stop - part.start))
                out = [[] for _ in range(6)]
                for i, doc in enumerate(b.column(0).slice(part.start, part.stop - part.start).to_pylist()):
                    own = np.append(ids[i], np.array([end], "<u4"))
                    first = len(own) % capacity or capacity
                    cuts = [0, *range(first, len(own) + 1, capacity)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for column, value in zip(out, (doc, row, k, x, y - x, own[x:y].astype("<u4").tobytes()), strict=True):
                            column.append(value)
                    row += 1
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids"])

    words = tokens.split_words(F.col(f"`{text}`"), [*bpe.load(path).special])
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    return rows.mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids binary")


def place(cut: DataFrame, *, capacity: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to rows with ``row``, ``piece`` and ``length`` (1 to ``capacity``)."""
    cut = cut.withColumn("_slice", F.pmod(F.xxhash64("row", "piece"), F.lit(SLICES)))
    counts = {(r.length, r._slice): r.n for r in cut.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("n")).collect()}
    need, first = np.zeros(capacity + 1, np.int64), np.zeros((capacity + 1, SLICES), np.int64)
    for (x, s), n in sorted(counts.items()):
        first[x, s] = need[x]
        need[x] += n
    table = slots(plan(need, capacity).patterns)
    held = cut.sparkSession.sparkContext.broadcast((first, table))
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_slice").orderBy("row", "piece")) - 1)
    names = [c for c in cut.columns if c != "_slice"]

    def run(batches):
        first, table = held.value
        key = table["length"] * (1 << 40) + table["rank"]
        for b in batches:
            x, s, r = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            rank = first[x, s] + r
            at = np.searchsorted(key, x * (1 << 40) + rank, "right") - 1
            within = rank - table["rank"][at]
            sequence = table["sequence"][at] + within // table["each"][at]
            offset = table["offset"][at] + within % table["each"][at] * x
            yield pa.RecordBatch.from_arrays([*b.columns[3:], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {k}" for n, k in cut.select(*names).dtypes)
    return ranked.select(F.col("length").alias("_l"), "_slice", F.col("_rank").cast("long").alias("_r"), *names).mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = SEQUENCE, end: int = END, text: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    Null or empty text is a piece of the end token alone. Repeated or null ids are packed like others. An empty table
    gives no rows. Pieces are written to the shared folder once; the histogram and the plan are bounded by
    ``capacity``.
    """
    cut = pieces(docs, tokenizer=tokenizer, capacity=capacity, end=end, text=text, id_col=id_col).withColumn("ids_crc32", F.crc32("ids"))
    placed = place(store(cut if with_ids else cut.drop("ids"), "pieces"), capacity=capacity)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
