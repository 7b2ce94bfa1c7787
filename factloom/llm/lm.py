"""Language-model scoring by a hierarchical Pitman-Yor model of word pairs (op 3).

Each word is the context of a restaurant, in which the words that followed it sit; all context restaurants share one
parent, the restaurant of words without context, whose base is uniform over the vocabulary and one unknown word. A
customer who opens a table is a customer of the parent.

Seating is sampled by Gibbs. A step takes all customers of one dish out of a restaurant and seats them anew, given
all others. Table sizes matter to nothing else (a prediction needs customers and tables by dish only), so they are
summed out, and the step draws the number of tables t of the c customers from its conditional distribution, in
proportion to S_d(c, t) * (theta + d T)(theta + d (T + 1)) ... (t factors) * p ** t, where S_d are generalised Stirling
numbers, T the restaurant's other tables and p the parent's probability of the dish to a customer who left it. It is
exact for up to MOST customers; beyond, ratios of S_d are their saddle-point values, corrected by scaling (``Tables``). Restaurants
and dishes are drawn at once, each given the others' last state. Probabilities are averaged over the sweeps kept.

Layout: words get integer ids by content (``wordblocks``: exact names, no hashes), the same under any partitioning. A
word's pairs are in one cell, in which its customers of the parent are counted; a word of more than CELL_TOKENS
occurrences is dealt over several cells by context, and its parent's tables are drawn on the driver (at most as many
such words as cells). Totals of contexts, a table that grows with the vocabulary, are summed by shards after each
sweep and return to the cells that have the context, by position. Documents are scored where their pairs are, in
whole units of 2 ** -24, so that sums don't depend on order either.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordblocks
from .common import Stored, fold, release
from .wordblocks import gather, squeeze, unsqueeze, wide

#: Ids of the start of a text (a context only) and of its end; words follow.
START, END = 0, 1
#: Occurrences of words for each cell.
CELL_TOKENS = 2_000_000
#: Sweeps, and how many of the last of them predictions average over.
SWEEPS, KEPT = 3, 2
#: Strength of the parent and of contexts. Discounts are estimated from counts of counts.
STRENGTH = (50.0, 0.5)
#: Customers of a dish up to which Stirling numbers are exact.
MOST = 1024
UNIT = 2.0**24


class Tables:
    """The distribution of the number of tables, for a discount d."""

    def __init__(self, d: float, most: int = MOST):
        self.d, self.most = d, most
        k = np.arange(most + 2, dtype=float)
        log = np.full((most + 1, most + 1), -np.inf)
        log[1, 1] = 0.0
        with np.errstate(divide="ignore"):
            for c in range(1, most):
                stay = np.log(np.maximum(c - d * k[1 : c + 1], 0))
                log[c + 1, 1 : c + 2] = np.logaddexp(np.r_[log[c, 1 : c + 1] + stay, -np.inf], log[c, : c + 1])
        self.log = log
        self._saddle_grid()
        t = np.arange(1.0, most)
        row = np.diff(log[most, 1:])
        self.few = np.r_[0.0, t * (row + np.log(d * t))]
        self.rest = np.r_[0.0, t * (row - self._saddle(float(most), t))]

    def _saddle_grid(self) -> None:
        """For mean table sizes m: log g and d log var / d log m of the tilted table sizes, where g(z) = (1 - (1 - z) ** d) / d
        generates S_d: S_d(c, t) = c! / t! [z ** c] g(z) ** t."""
        v, d = np.linspace(-18, 60, 6001), self.d
        logy, z = -np.logaddexp(0, v), 1 / (1 + np.exp(-v))
        g = -np.expm1(d * logy) / d
        m = z * np.exp((d - 1) * logy) / g
        var = m * np.maximum(1 + (1 - d) * np.exp(v) - m, 1e-300)
        ok = (m > 1 + 1e-6) & (var > 1e-12)
        self.m = np.log(m[ok] - 1)
        self.log_g, self.bend = np.log(g[ok]), np.gradient(np.log(var[ok]), np.log(m[ok]))

    def _saddle(self, c: float, t: np.ndarray) -> np.ndarray:
        """log S(c, t + 1) - log S(c, t) by the saddle point."""
        at = np.log(np.maximum(c / (t + 0.5) - 1, 1e-12))
        return np.interp(at, self.m, self.log_g) - np.log(t + 1) - (1 - np.interp(at, self.m, self.bend)) / (2 * t + 1)

    def ratio(self, c: int, t: np.ndarray) -> np.ndarray:
        """log S(c, t + 1) - log S(c, t) for c > MOST. Where t / c ** d is small, t * log(d t S(c, t + 1) / S(c, t)) is a
        function of it; elsewhere t times what the saddle point leaves is. Both functions are read off row MOST."""
        k = t * (self.most / c) ** self.d
        few = np.interp(k, np.arange(self.most), self.few) / t - np.log(self.d * t)
        return np.where(k < 64, few, self._saddle(c, t) + np.interp(k, np.arange(self.most), self.rest, right=0.0) / t)

    def draw(self, rng, c: np.ndarray, theta: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Tables of c customers each: ``theta`` is the restaurant's strength with d for each table of other dishes."""
        t = np.minimum(c, 1)
        some = np.flatnonzero((c > 1) & (c <= self.most))
        order = some[np.argsort(c[some], kind="stable")]
        sizes, at = c[order], 0
        logp = np.log(p)
        while at < len(order):
            low = int(sizes[at])
            high = min(self.most, low if low < 32 else int(low * 1.1))
            stop = min(int(np.searchsorted(sizes, high, "right")), at + max(1, 1_000_000 // high))
            i = order[at:stop]
            k = np.arange(high)
            x = np.cumsum(np.log(theta[i, None] + self.d * k), 1) + logp[i, None] * (k + 1.0) + self.log[c[i], 1 : high + 1]
            x = np.cumsum(np.exp(x - x.max(1, keepdims=True)), 1)
            t[i] = np.minimum((x < rng.random(len(i))[:, None] * x[:, -1:]).sum(1) + 1, c[i])
            at = stop
        for i in np.flatnonzero(c > self.most).tolist():
            t[i] = self._draw_many(rng, int(c[i]), float(theta[i]), float(logp[i]))
        return t

    def _draw_many(self, rng, c: int, theta: float, logp: float) -> int:
        d = self.d

        def rise(t):  # log of the weight of t + 1 tables over that of t
            return self.ratio(c, t) + np.log(theta + d * t) + logp

        low, high = 1, c
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if rise(np.array(float(mid))) > 0 else (low, mid)
        steep = float(rise(np.array(float(low))) - rise(np.array(low + 1.0)))
        width = int(12 / math.sqrt(max(steep, 1e-12))) + 20
        t = np.arange(max(1, low - width), min(c, low + width) + 1, dtype=float)
        x = np.r_[0.0, np.cumsum(rise(t[:-1]))]
        x = np.cumsum(np.exp(x - x.max()))
        return int(t[min(int(np.searchsorted(x, rng.random() * x[-1])), len(t) - 1)])


@functools.lru_cache(maxsize=4)
def tables_of(d: float) -> Tables:
    return Tables(d)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts in a row, A-Z lower-cased, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten()
    some = pc.not_equal(words, "")
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))])
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[at]
    return words.filter(some), np.diff(before)


def _split(b: pa.RecordBatch):
    """``doc_id``, ``train`` and text rows for ``wordblocks.blocks``: all occurrences and those to learn from."""
    words, counts = words_of(b.column(2))
    train = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = b.column(0)
    return words, counts, [np.ones(len(counts)), train], [pc.fill_null(ids, 0).to_numpy().view(np.uint64), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), train]


_NAMED = "block long, shard int, ids binary, hot binary, n_words long, n_tokens long"


def _names(shards: int, cell_tokens: int):
    """Ids of a shard's words, most frequent first, for each block that has them; words of more than a cell's share."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        s, parts = key[0].as_py(), [wordblocks.unpack_words(x) for x in rows.column("words").to_pylist()]
        n, train = (np.concatenate(x).astype(np.int64) for x in zip(*map(unsqueeze, rows.column("n").to_pylist()), strict=True))
        coded = pa.concat_arrays(parts).dictionary_encode()
        at, size = coded.indices.to_numpy(), len(coded.dictionary)
        n, train = np.bincount(at, n, size).astype(np.int64), np.bincount(at, train, size).astype(np.int64)
        by_content = np.empty(size, np.int64)
        by_content[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(size)
        rank = np.empty(size, np.int64)
        rank[np.lexsort((by_content, -n))] = np.arange(size)
        ids = 2 + s + shards * rank
        ends = np.cumsum([len(p) for p in parts])
        each = [squeeze(i, c) for i, c in zip(np.split(ids[at], ends[:-1]), np.split(train[at], ends[:-1]), strict=True)]
        hot = np.flatnonzero(n > cell_tokens)
        hot = hot[np.argsort(ids[hot])]
        blocks = rows.column("block").to_pylist()
        stats = (-1, s, None, squeeze(ids[hot], n[hot], train[hot]), int((train > 0).sum()), int(train.sum()))
        out = [*((b, s, e, None, 0, 0) for b, e in zip(blocks, each, strict=True)), stats]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _NAMED.split(", ")])

    return run


class Cells:
    """Where pairs go: by word, and words of more than a cell's share by context too."""

    def __init__(self, cells: int, hot: list[tuple[int, int, int]], cell_tokens: int):
        self.cells = cells
        self.hot = np.array([w for w, _, _ in hot], np.int64)
        self.train = np.array([n for _, _, n in hot], np.int64)
        self.wide = np.array([-(-n // cell_tokens) for _, n, _ in hot], np.int64)
        #: Ends of texts to learn from.
        self.ends = 0
        self.first = cells + np.cumsum(self.wide) - self.wide

    def find(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of words among the hot ones, and whether they are."""
        if not len(self.hot):
            return np.zeros(len(w), np.int64), np.zeros(len(w), bool)
        i = np.minimum(np.searchsorted(self.hot, w), len(self.hot) - 1)
        return i, self.hot[i] == w

    def of(self, w: np.ndarray, u: np.ndarray) -> np.ndarray:
        def mix(x):
            return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64)

        i, hot = self.find(w)
        out = mix(w) % self.cells
        return np.where(hot, self.first[i] + mix(u) % self.wide[i], out) if hot.any() else out


def _deltas(w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs sorted by both, as differences."""
    dw = np.diff(w, prepend=0)
    return dw, np.where(np.r_[True, dw[1:] != 0], u, np.diff(u, prepend=0)) if len(w) else u


def _undeltas(dw: np.ndarray, du: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dw, du = dw.astype(np.int64), du.astype(np.int64)
    if not len(dw):
        return dw, du
    total, starts = np.cumsum(du), np.flatnonzero(np.r_[True, dw[1:] != 0])
    before = np.r_[0, total[starts[1:] - 1]]
    return np.cumsum(dw), total - np.repeat(before, np.diff(np.r_[starts, len(dw)]))


_POSTED = "cell long, block long, data binary"


def _post(cells: Cells, n_train: int, n_words: int):
    """A block's pairs by cell, with the places of their documents; and, as cell -1 - block, its documents with what
    needs no context: doc_id, whether it is null, n_tokens, n_known and base score."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.column("block")[0].as_py()
        counts, codes, shard = wide(unsqueeze(left.column("places")[0].as_py()))
        doc_id, known_id, train = unsqueeze(left.column("rows")[0].as_py())
        found = [(k, unsqueeze(x)) for k, x in zip(right.column("shard").to_pylist(), right.column("ids").to_pylist(), strict=True)]
        ids, seen = (wordblocks.by_code(shard, [(k, x[i]) for k, x in found]) for i in (0, 1))
        n_words_here = len(ids)
        id_of = np.r_[ids, END, START]
        seen = np.r_[seen, cells.ends]
        size = counts + 1
        ends = np.cumsum(size) - 1
        total = int(size.sum())
        w = np.full(total, n_words_here)
        inner = np.ones(total, bool)
        inner[ends] = False
        w[inner] = codes
        u = np.r_[n_words_here + 1, w[:-1]]
        u[ends - counts] = n_words_here + 1
        doc = np.repeat(np.arange(len(counts)), size)
        base = np.bincount(doc, np.log10((seen[w] + 1) / (n_train + n_words + 1)), len(counts))
        known = np.bincount(doc, seen[w] > 0, len(counts)).astype(np.int64)
        key = w * (n_words_here + 2) + u
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        new_pair = np.r_[True, key[1:] != key[:-1]]
        at = np.flatnonzero(new_pair | np.r_[True, doc[1:] != doc[:-1]])
        n, pdoc = np.diff(np.r_[at, total]), doc[at]
        first = np.flatnonzero(new_pair[at])
        posts = np.diff(np.r_[first, len(at)])
        pair = key[at[first]]
        pw, pu = id_of[pair // (n_words_here + 2)], id_of[pair % (n_words_here + 2)]
        learnt = np.add.reduceat(n * (train[pdoc] > 0), first)
        cell = cells.of(pw, pu)
        order = np.lexsort((pu, pw, cell))
        cell, pw, pu, learnt, posts_by = cell[order], pw[order], pu[order], learnt[order], posts[order]
        places = gather(first[order], posts_by)
        n, pdoc = n[places], pdoc[places]
        lo = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        hi, post_at = np.r_[lo[1:], len(cell)], np.r_[0, np.cumsum(posts_by)]
        out = [(-1 - block, block, squeeze(doc_id, known_id, size, known, base.view(np.uint64)))]
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            x, y = post_at[a], post_at[b]
            out.append((int(cell[a]), block, squeeze(*_deltas(pw[a:b], pu[a:b]), learnt[a:b], posts_by[a:b], pdoc[x:y], n[x:y])))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["cell", "block", "data"])

    return run


_CELL = "cell long, pairs binary, posts binary, once long, twice long, root_once long, root_twice long"


def _build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """All pairs of a cell, sorted, with counts to learn from; its postings by block; counts of counts."""
    cell = key[0].as_py()
    if cell < 0:
        row = (cell, None, rows.column("data")[0].as_py(), 0, 0, 0, 0)
    else:
        blocks, parts = rows.column("block").to_numpy(), [unsqueeze(x) for x in rows.column("data").to_pylist()]
        found = [(*_undeltas(p[0], p[1]), p[2].astype(np.int64)) for p in parts]
        w, u, c = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((u, w))
        sw, su = w[order], u[order]
        new = np.r_[True, (sw[1:] != sw[:-1]) | (su[1:] != su[:-1])]
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        sw, su = sw[new], su[new]
        c = np.bincount(at, c, len(sw)).astype(np.int64)
        sizes = np.array([len(p[2]) for p in parts], np.int64)
        starts = np.cumsum(sizes) - sizes
        step = np.diff(at, prepend=0)
        step[starts] = at[starts]
        posts = squeeze(blocks.view(np.uint64), sizes, step, *(np.concatenate([p[i] for p in parts]) for i in (3, 4, 5)))
        contexts = np.bincount(np.cumsum(np.r_[False, sw[1:] != sw[:-1]])[c > 0])
        row = (cell, squeeze(*_deltas(sw, su), c), posts, *(int((x == k).sum()) for x in (c, contexts) for k in (1, 2)))
    kinds = (pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4)
    return pa.table([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _CELL.split(", ")])


class Cell:
    """Pairs of a cell, sorted by word, then context: words, the pairs' places among them and among contexts."""

    def __init__(self, pairs: bytes):
        dw, du, c = unsqueeze(pairs)
        self.w, self.u = _undeltas(dw, du)
        self.c = c.astype(np.int64)
        new = np.r_[True, self.w[1:] != self.w[:-1]]
        self.words, self.word_of = self.w[new], np.cumsum(new) - 1
        self.contexts, self.context_of = np.unique(self.u, return_inverse=True)

    def customers(self, t: np.ndarray) -> np.ndarray:
        """The words' customers in the parent."""
        return np.bincount(self.word_of, t, len(self.words)).astype(np.int64)


class Parent:
    """What cells need of the parent: its totals, and the customers and tables of hot words."""

    def __init__(self, d: tuple[float, float], strength: tuple[float, float], n_words: int, customers: int, tables: int, c: np.ndarray, t: np.ndarray):
        self.d, self.strength, self.base = d, strength, 1.0 / (n_words + 1)
        self.customers, self.tables, self.c, self.t = customers, tables, c, t

    def of(self, c: np.ndarray, t: np.ndarray, gone: int = 0) -> np.ndarray:
        """The probability of dishes of c customers at t tables, to one of ``gone`` customers who left."""
        c = c - np.minimum(gone, c)
        own = np.maximum(c - self.d[0] * np.minimum(t, c), 0.0)
        return (own + (self.strength[0] + self.d[0] * self.tables) * self.base) / (self.strength[0] + self.customers - gone)

    def dishes(self, cell: Cell, cells: Cells, t2: np.ndarray, t0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of a cell's words in the parent."""
        i, hot = cells.find(cell.words)
        c0 = cell.customers(t2)
        return (np.where(hot, self.c[i], c0), np.where(hot, self.t[i], t0)) if hot.any() else (c0, t0)


_STATE = "cell long, shard int, data binary, customers long, tables long, hot binary"


def _state(cell_id: int, cell: Cell, cells: Cells, t2: np.ndarray, t0: np.ndarray, shards: int) -> pa.Table:
    """Tables of a cell (shard -1); its share of customers and tables of each context, for the shards that sum them."""
    _, hot = cells.find(cell.words)
    c0 = cell.customers(t2)
    rows = [(cell_id, -1, squeeze(t2, t0), int(c0.sum()), int(t0[~hot].sum()), squeeze(cell.words[hot], c0[hot]) if hot.any() else None)]
    n = len(cell.contexts)
    c, t = (np.bincount(cell.context_of, x, n).astype(np.int64) for x in (cell.c, t2))
    shard = cell.contexts % shards
    for s in range(shards):
        own = shard == s
        if own.any():
            rows.append((cell_id, s, squeeze(np.diff(cell.contexts[own], prepend=0), c[own], t[own]), 0, 0, None))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _STATE.split(", ")])


def _totals(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Customers and tables of a shard's contexts, over all cells, for each cell in its order."""
    parts = [unsqueeze(x) for x in rows.column("data").to_pylist()]
    u = [np.cumsum(p[0].astype(np.int64)) for p in parts]
    _, at = np.unique(np.concatenate(u), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([p[i] for p in parts])).astype(np.int64)[at] for i in (1, 2)]
    ends = np.cumsum([len(x) for x in u])[:-1]
    data = [squeeze(c, t) for c, t in zip(np.split(sums[0], ends), np.split(sums[1], ends), strict=True)]
    return pa.table([rows.column("cell"), pa.array([key[0].as_py()] * len(data), pa.int32()), pa.array(data, pa.binary())], names=["cell", "shard", "data"])


def _context_totals(cell: Cell, found: dict[int, bytes], shards: int) -> tuple[np.ndarray, np.ndarray]:
    c, t = np.zeros(len(cell.contexts), np.int64), np.zeros(len(cell.contexts), np.int64)
    shard = cell.contexts % shards
    for s, data in found.items():
        c[shard == s], t[shard == s] = unsqueeze(data)
    return c, t


def _by_shard(rows: pa.Table, sweep: int) -> dict[int, bytes]:
    return {s: d for k, s, d in zip(*(rows.column(x).to_pylist() for x in ("sweep", "shard", "data")), strict=True) if k == sweep}


def sweep_cell(rng, cell: Cell, cells: Cells, parent: Parent, t2, t0, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A Gibbs sweep over a cell: each dish of each context, then each dish of the parent. ``tables``: by context."""
    (d0, d2), (strength0, strength2) = parent.d, parent.strength
    c0, own0 = parent.dishes(cell, cells, t2, t0)
    p = parent.of(c0, own0, gone=1)[cell.word_of]
    t2 = tables_of(d2).draw(rng, cell.c, strength2 + d2 * np.maximum(tables[cell.context_of] - t2, 0), p)
    c0 = cell.customers(t2)
    t0 = tables_of(d0).draw(rng, c0, strength0 + d0 * np.maximum(parent.tables - t0, 0).astype(float), np.full(len(c0), parent.base))
    return t2, t0


def predict(cell: Cell, cells: Cells, kept: list[tuple]) -> np.ndarray:
    """The mean probability of each pair over sweeps kept: (parent, t2, t0, customers and tables by context)."""
    total = np.zeros(len(cell.w))
    for parent, t2, t0, c, t in kept:
        d, strength = parent.d[1], parent.strength[1]
        p = parent.of(*parent.dishes(cell, cells, t2, t0))[cell.word_of]
        own, room = np.maximum(cell.c - d * t2, 0), (strength + d * t) / (strength + c)
        total += own / (strength + c[cell.context_of]) + room[cell.context_of] * p
    return total / len(kept)


def _partial(posts: bytes, logp: np.ndarray) -> pa.Table:
    blocks, sizes, step, n_posts, doc, n = wide(unsqueeze(posts))
    owner = np.repeat(np.arange(len(blocks)), sizes)
    total = np.cumsum(step)
    starts = np.cumsum(sizes) - sizes
    at = total - np.repeat(np.r_[0, total[starts[1:] - 1]], sizes)
    units = np.rint(-logp * UNIT).astype(np.int64)
    amount = np.repeat(units[at], n_posts) * n
    block = np.repeat(owner, n_posts)
    key = block * (int(doc.max()) + 1) + doc
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sums, doc, block = np.add.reduceat(amount[order], new), doc[order][new], block[order][new]
    ends = np.searchsorted(block, np.arange(len(blocks) + 1))
    data = [squeeze(np.diff(doc[a:b], prepend=0), sums[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return pa.table({"block": pa.array(blocks, pa.int64()), "data": pa.array(data, pa.binary())})


_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    doc_id, known_id, size, known, base = unsqueeze(left.column("posts")[0].as_py())
    score = np.zeros(len(size), np.int64)
    for data in right.column("data").to_pylist():
        at, sums = wide(unsqueeze(data))
        score[np.cumsum(at)] += sums
    ids = pa.array(doc_id.astype(np.uint64).view(np.int64), pa.int64(), mask=known_id == 0)
    return pa.table([ids, pa.array(size.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base.astype(np.uint64).view(np.float64)), pa.array(score / -UNIT)], names=[x.split()[0] for x in _SCORED.split(", ")])


class Model:
    """Cells of ``learn`` with the seatings kept."""

    def __init__(self, cells: Cells, built: Stored, n_train: int, n_words: int, shards: int):
        self.cells, self.built, self.n_train, self.n_words, self.shards = cells, built, n_train, n_words, shards
        self.kept: list[tuple[Parent, Stored, Stored]] = []

    def parent(self, state: Stored, d, strength, sweep: int) -> Parent:
        """The parent's totals of a sweep's state; hot words' tables are drawn here, as their customers are in
        several cells."""
        rows = state.read().where("shard = -1")
        customers, tables = rows.agg(F.sum("customers"), F.sum("tables")).first()
        c = np.zeros(len(self.cells.hot), np.int64)
        for r in rows.where("hot is not null").select("hot").collect():
            w, n = wide(unsqueeze(r.hot))
            np.add.at(c, np.searchsorted(self.cells.hot, w), n)
        theta = strength[0] + d[0] * float(tables or 0)
        t = tables_of(d[0]).draw(np.random.default_rng([sweep, 1]), c, np.full(len(c), theta), np.full(len(c), 1.0 / (self.n_words + 1)))
        return Parent(d, strength, self.n_words, int(customers or 0), int(tables or 0) + int(t.sum()), c, t)


def learn(docs: DataFrame, train, *, text: str = "text", id_col: str = "doc_id", cell_tokens: int = CELL_TOKENS, block_bytes: int = 8_000_000, sweeps: int = SWEEPS, kept: int = KEPT, strength=STRENGTH) -> Model:
    """Pairs of all texts of ``docs``, and seatings sampled of those of rows for which ``train`` (a column) holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    shards = wordblocks.shards_for(docs, text)
    blocks = Stored(wordblocks.blocks(rows, _split, shards, block_bytes=block_bytes), "blocks")
    words = blocks.read().where("shard >= 0").select("block", "shard", "words", "n")
    named = Stored(words.groupBy("shard").applyInArrow(_names(shards, cell_tokens), _NAMED), "names")
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("train").alias("learnt")).first()
    all_tokens = (blocks.read().agg(F.sum("n_places")).first()[0] or 0) + ends.n
    stats = named.read().where("block = -1").select("hot", "n_words", "n_tokens").collect()
    hot = [(END, ends.n, ends.learnt)] if ends.n > cell_tokens else []
    hot += [h for r in stats for h in zip(*(x.tolist() for x in wide(unsqueeze(r.hot))), strict=True)]
    n_words, n_train = sum(r.n_words for r in stats) + (ends.learnt > 0), sum(r.n_tokens for r in stats) + ends.learnt
    cells = Cells(max(8, -(-all_tokens // cell_tokens)), sorted(hot), cell_tokens)
    cells.ends = ends.learnt

    texts = blocks.read().where("shard = -1").select("block", "places", "rows")
    ids = named.read().where("block >= 0").select("block", "shard", "ids")
    posted = texts.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_post(cells, n_train, n_words), _POSTED)
    built = Stored(posted.groupBy("cell").applyInArrow(_build, _CELL), "cells")
    blocks.drop()
    named.drop()
    release(spark)

    context_shards = max(1, cells.cells // 8)
    model = Model(cells, built, n_train, n_words, context_shards)
    once, twice, root_once, root_twice = (x or 0 for x in built.read().agg(*map(F.sum, ("once", "twice", "root_once", "root_twice"))).first())
    d = tuple(min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5 for a, b in ((root_once, root_twice), (once, twice)))
    some = built.read().where("cell >= 0").select("cell", "pairs")

    def start(batches):
        for b in batches:
            for name, pairs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cell = Cell(pairs)
                t2 = np.minimum(cell.c, 1)
                yield from _state(name, cell, cells, t2, np.minimum(cell.customers(t2), 1), context_shards).to_batches()

    def summed(state: Stored) -> Stored:
        sums = state.read().where("shard >= 0").select("cell", "shard", "data").groupBy("shard").applyInArrow(_totals, "cell long, shard int, data binary")
        return Stored(sums, "totals")

    state = Stored(some.mapInArrow(start, _STATE), "seats")
    for k in range(sweeps + 1):
        parent, totals = model.parent(state, d, strength, k), summed(state)
        if k > sweeps - kept or k == sweeps:
            model.kept.append((parent, state, totals))
        if k == sweeps:
            break

        held = _held(state, totals, k)
        new = Stored(some.groupBy("cell").cogroup(held.groupBy("cell")).applyInArrow(_again(parent, k, cells, context_shards), _STATE), "seats")
        if not model.kept or model.kept[-1][1] is not state:
            state.drop()
            totals.drop()
        state = new
        release(spark)
    return model


def _again(parent: Parent, k: int, cells: Cells, shards: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        name, cell = left.column("cell")[0].as_py(), Cell(left.column("pairs")[0].as_py())
        found = _by_shard(right, k)
        t2, t0 = wide(unsqueeze(found.pop(-1)))
        _, tables = _context_totals(cell, found, shards)
        return _state(name, cell, cells, *sweep_cell(np.random.default_rng([k, name]), cell, cells, parent, t2, t0, tables), shards)

    return run


def _held(state: Stored, totals: Stored, sweep: int) -> DataFrame:
    rows = state.read().where("shard = -1").select("cell", "shard", "data").unionByName(totals.read())
    return rows.withColumn("sweep", F.lit(sweep))


def scores(model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and train_tokens of each row that ``learn`` took."""
    cells, shards, parents = model.cells, model.shards, [p for p, _, _ in model.kept]
    held = functools.reduce(DataFrame.unionByName, [_held(s, t, i) for i, (_, s, t) in enumerate(model.kept)])

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        cell, kept = Cell(left.column("pairs")[0].as_py()), []
        for i, parent in enumerate(parents):
            found = _by_shard(right, i)
            t2, t0 = wide(unsqueeze(found.pop(-1)))
            kept.append((parent, t2, t0, *_context_totals(cell, found, shards)))
        return _partial(left.column("posts")[0].as_py(), np.log10(predict(cell, cells, kept)))

    built = model.built.read()
    some = built.where("cell >= 0").select("cell", "pairs", "posts")
    partial = some.groupBy("cell").cogroup(held.groupBy("cell")).applyInArrow(judge, "block long, data binary")
    docs = built.where("cell < 0").select((-1 - F.col("cell")).alias("block"), "posts")
    out = docs.groupBy("block").cogroup(partial.groupBy("block")).applyInArrow(_finish, _SCORED)
    return out.withColumn("train_tokens", F.lit(model.n_train).cast("long"))


def score_corpus(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """Learns from rows whose id's crc32 modulo 7 isn't 2, and scores all rows, one row out per row.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null text is an end after a start. Ids may be
    null or repeat; an empty table gives no rows; other columns aren't read. Without training rows each token has the
    unknown word's probability, 1.
    """
    out = scores(learn(docs, fold(id_col, 7) != 2, text=text, id_col=id_col, **options))
    return out.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
