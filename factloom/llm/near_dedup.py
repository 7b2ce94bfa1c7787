"""Near duplicates: documents linked by the Jaccard similarity of their word shingles (op 7).

Equal shingle sets are one vertex, so copies are never paired. What cannot have a partner leaves early, exactly:

* A set of n shingles shares at least T = ceil(0.75 n) with any partner. In the order of shingle hashes, a partner
  shares several of the first n - T + l; sets whose first shingles are mostly their own leave.
* Of what is left, all shingles are listed; sets with fewer than T shared shingles leave. What stays is ordered from
  the shortest list to the longest, and a partner shares one of the n - T + 1 first. Long lists (boilerplate that many
  documents share) thus never make candidates unless a document holds little else. Where two sets' first common
  shingle stands bounds their overlap, and pairs that it rules out aren't made.

Components, not pairs, are asked for. In two rounds each set is searched against one pivot of the lists it is in,
first the most central set (of an original and its edited copies, the original), which joins large groups in linear
work. Then each pair of sets that share a list and still are in different
components is searched, so no link is lost. Searches are T-occurrence searches: short lists are heap-merged, and
candidates that appear in them often enough are probed in the long ones by binary search.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, join_groups, keep_rows, parts, release, store

WIDTH = 5
#: Jaccard similarity of a link, in hundredths.
LINK = 75
#: Share of a set that its prefix has beyond the least, and that must be shared in it for each partner.
EXTRA = 0.10
PIVOT_ROUNDS = 2
#: Candidates of one search.
SHARD = 512
#: DivideSkip sets aside T / (MU * log2(longest list) + 1) lists.
MU = 0.01
BLOOM_BITS = 1 << 26
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; of fewer words, the whole sequence is one."""
    memo: dict[bytes, int] = {}
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([memo[w] if w in memo else memo.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], np.uint64)
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + len(out)]) * _MULTIPLY
        out ^= out >> np.uint64(29)
    return np.unique(out)


def least_overlap(n, link: int = LINK):
    """The least number of shared shingles of a set of n with any partner."""
    return -(-n * link // 100)


def _sid(s: np.ndarray) -> int:
    """The name of a shingle set: 63 bits of its digest."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little") >> 1


def divide_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """Ids that occur in at least ``least`` of the sorted lists, with how often.

    The longest lists are set aside; an id that reaches ``least`` occurs in the others at least ``least`` less their
    number. Those are heap-merged, and only ids found often enough there are probed in the long lists.
    """
    if least < 1 or len(lists) < least:
        return {}
    lists = sorted(lists, key=len)
    aside = min(least - 1, int(least / (MU * math.log2(len(lists[-1]) + 1) + 1)))
    short, long_ = lists[: len(lists) - aside], lists[len(lists) - aside :]
    found: dict[int, int] = {}
    last, n = None, 0
    for x in [*heapq.merge(*short), None]:
        if x == last:
            n += 1
            continue
        if last is not None and n >= least - aside:
            found[last] = n
        last, n = x, 1
    out = {}
    for x, n in found.items():
        rest = aside
        for at in long_:
            if n + rest < least:
                break
            i = bisect_left(at, x)
            n += i < len(at) and at[i] == x
            rest -= 1
        if n >= least:
            out[x] = n
    return out


def search(query: np.ndarray, candidates: list[np.ndarray], link: int = LINK) -> list[int]:
    """Places of candidates linked to the query: 100 * intersection >= link * union."""
    n = len(query)
    sizes = np.array([len(c) for c in candidates], np.int64)
    able = np.flatnonzero((100 * np.minimum(sizes, n) >= link * np.maximum(sizes, n)) & (sizes > 0))
    if not len(able):
        return []
    flat = np.concatenate([candidates[i] for i in able])
    owner = np.repeat(able, sizes[able])
    at = np.searchsorted(query, flat)
    hit = (at < n) & (query[np.minimum(at, n - 1)] == flat)
    at, owner = at[hit], owner[hit]
    order = np.lexsort((owner, at))
    at, owner = at[order], owner[order]
    lists = [x.tolist() for x in np.split(owner, np.flatnonzero(np.diff(at)) + 1)] if len(at) else []
    return [x for x, c in divide_skip(lists, least_overlap(n, link)).items() if 100 * c >= link * (n + sizes[x] - c)]


def _sketch(batches):
    row = TaskContext.get().partitionId() << 40
    for b in batches:
        n, sid, sha = [], [], []
        for t in b.column(1).to_pylist():
            s = shingles(t or "")
            n.append(len(s))
            sid.append(_sid(s))
            sha.append(hashlib.sha256((t or "").encode()).digest())
        rows = pa.array(range(row, row + len(n)), pa.int64())
        row += len(n)
        yield pa.RecordBatch.from_arrays([b.column(0), rows, pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(sha, pa.binary())], names=["doc_id", "uid", "n", "sid", "sha"])


def _postings(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    h = np.concatenate([s for _, s in found]) if found else np.zeros(0, np.uint64)
    sid = np.repeat(np.array([x for x, _ in found], np.int64), [len(s) for _, s in found])
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(sid)], names=["h", "sid"])


def _prefixes(link: int):
    def run(batches):
        for b in batches:
            seen: set[int] = set()
            found = []
            for t in b.column(0).to_pylist():
                s = shingles(t)
                if len(s) and (sid := _sid(s)) not in seen:
                    seen.add(sid)
                    found.append((sid, s[: len(s) - int(least_overlap(len(s), link)) + max(1, -int(-EXTRA * len(s) // 1))]))
            yield _postings(found)

    return run


def _all_postings(batches):
    for b in batches:
        yield _postings([(sid, np.frombuffer(s, np.uint64)) for sid, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])


def _runs(batches):
    """Batches of (h, sid) sorted by both, cut between runs of equal h as far as memory allows: arrays, duplicates
    left out, and whether each row's list goes beyond it. A row is kept back to see its neighbours."""
    held_h, held_s, before = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for b in batches:
        h = np.concatenate([held_h, b.column(0).to_numpy(zero_copy_only=False)])
        s = np.concatenate([held_s, b.column(1).to_numpy(zero_copy_only=False)])
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        h, s = h[new], s[new]
        if len(h) > 1:
            yield h[:-1], s[:-1], before, h[-1]
            before = h[-2]
        held_h, held_s = h[-1:], s[-1:]
    if len(held_h):
        yield held_h, held_s, before, None


def _shared_counts(batches):
    """For each set, how many of its listed shingles are in another set's list too; partial counts."""
    for h, s, before, after in _runs(batches):
        same = h[1:] == h[:-1]
        live = np.zeros(len(h), bool)
        live[1:] |= same
        live[:-1] |= same
        live[0] |= before is not None and h[0] == before
        live[-1] |= after is not None and h[-1] == after
        sid, n = np.unique(s[live], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(n.astype(np.int64))], names=["sid", "shared"])


def _listed(df: DataFrame) -> DataFrame:
    return df.repartition(parts(df.sparkSession), "h").sortWithinPartitions("h", "sid")


def _bits(sids: np.ndarray) -> np.ndarray:
    """Three places in a Bloom filter for each set name."""
    x = sids.astype(np.uint64)
    return np.stack([((x ^ np.uint64(k)) * _MULTIPLY >> np.uint64(64 - BLOOM_BITS.bit_length() + 1)).astype(np.int64) for k in (0, 0x5BD1E995, 0x27D4EB2F165667)])


def _bloom(sids: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size (BLOOM_BITS) of set names: only its words, merged, reach the driver."""

    def run(batches):
        for b in batches:
            at = np.unique(_bits(b.column(0).to_numpy(zero_copy_only=False)))
            word, start = np.unique(at >> 6, return_index=True)
            mask = np.bitwise_or.reduceat(np.int64(1) << (at & 63), start) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask)], names=["word", "mask"])

    words = sids.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of each node with an edge (a, b). Labels spread along edges and jump to
    their label's label until nothing changes; each round is written, so none depends on the one before."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = store(both, "edges")
    label = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        spread = label.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        jump = label.select(F.col("node").alias("to"), F.col("component").alias("further"))
        new = store(spread.join(jump, "to", "left").select("node", "old", F.least("to", "further").alias("component")), "labels")
        if new.where("component <> old").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")


def _search_pairs(pairs: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """Links (a, b) among candidate pairs (q, c): searches of the sets q among sets c, in shards of candidates."""
    pairs = store(pairs.withColumn("shard", F.xxhash64("c")), "pairs")
    counted = pairs.groupBy("q").agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("shards"))
    ranked = Stored(pairs.join(counted, "q").select("q", "c", F.pmod("shard", "shards").alias("k")), "ranked")
    left = ranked.read().join(sets.select(F.col("sid").alias("c"), F.col("items").alias("items")), "c")
    right = ranked.read().select("q", "k").distinct().join(sets.select(F.col("sid").alias("q"), F.col("items").alias("own")), "q")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if right.num_rows and left.num_rows:
            q, own = right.column("q")[0].as_py(), np.frombuffer(right.column("own")[0].as_py(), np.uint64)
            at = left.column("c").to_pylist()
            for i in search(own, [np.frombuffer(x, np.uint64) for x in left.column("items").to_pylist()], link):
                a.append(q)
                b.append(at[i])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = left.groupBy("q", "k").cogroup(right.groupBy("q", "k")).applyInArrow(run, "a long, b long")
    out = store(found, "links")
    release(pairs.sparkSession)
    return out


def _merge(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (sid, component) after joining those that links connect."""
    of = comps.select(F.col("sid").alias("a"), F.col("component").alias("ca"))
    to = comps.select(F.col("sid").alias("b"), F.col("component").alias("cb"))
    edges = links.join(of, "a").join(to, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()
    merged = components(edges).select("node", F.col("component").alias("least"))
    out = comps.join(merged, F.col("component") == F.col("node"), "left").select("sid", F.coalesce("least", "component").alias("component"))
    return store(out, "components")


def _cross(link: int):
    """Of lists (h, sid, component, n, left) that come sorted by h and component: pairs of sets in different components
    that can be linked if this list is the first that they share. A linked pair's first common shingle always passes:
    the overlap is at most 1 and what is left of either set. Pairs within a component are not made."""

    def pairs(sid, comp, n, left):
        starts = np.flatnonzero(np.r_[True, comp[1:] != comp[:-1]])
        for i, at in enumerate(starts[1:], 1):
            end = starts[i + 1] if i + 1 < len(starts) else len(sid)
            for x in range(at, end):
                need = -(-(n[:at] + n[x]) * link // (100 + link))
                able = np.flatnonzero((1 + np.minimum(left[:at], left[x]) >= need) & (100 * np.minimum(n[:at], n[x]) >= link * np.maximum(n[:at], n[x])))
                if len(able):
                    yield np.minimum(sid[able], sid[x]), np.maximum(sid[able], sid[x])

    def flush(found):
        a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["q", "c"])

    def run(batches):
        found, size, hold = [], 0, [np.zeros(0, np.int64)] * 5
        for b in _then_none(batches):
            rows = hold if b is None else [np.concatenate([x, b.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(hold)]
            h = rows[0]
            end = len(h) if b is None or not len(h) else int(np.searchsorted(h, h[-1]))
            cuts = np.flatnonzero(np.r_[True, h[1:end] != h[: end - 1]]) if end else []
            for i, at in enumerate(cuts):
                stop = cuts[i + 1] if i + 1 < len(cuts) else end
                for p in pairs(*(x[at:stop] for x in rows[1:])):
                    found.append(p)
                    size += len(p[0])
                    if size > 500_000:
                        yield flush(found)
                        found, size = [], 0
            hold = [x[end:] for x in rows]
        if found:
            yield flush(found)

    return run


def _then_none(batches):
    yield from batches
    yield None


def classes(docs: DataFrame, *, link: int = LINK, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, uid (of the row), sha (of the text), n_shingles and class (null for a document without shingles, which
    links to nothing), one row per row of ``docs``. Rows with equal shingle sets are in one class."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = store(rows.mapInArrow(_sketch, "doc_id long, uid long, n long, sid long, sha binary"), "sketch")
    named = sketch.where("n > 0").select("sid", "n").distinct()
    texts = rows.where("text is not null").select("text")

    shared = store(_listed(texts.mapInArrow(_prefixes(link), "h long, sid long")).mapInArrow(_shared_counts, "sid long, shared long").groupBy("sid").agg(F.sum("shared").alias("shared")), "shared")
    few = F.greatest(F.lit(1), F.ceil(F.floor(F.col("n") * link / 100) * EXTRA))
    able = store(shared.join(named, "sid").where(F.col("shared") >= few).select("sid"), "able")
    release(spark)
    held = spark.sparkContext.broadcast(_bloom(able))

    def whole(batches):
        bloom = held.value
        for b in batches:
            found = {}
            for t in b.column(0).to_pylist():
                s = shingles(t)
                if len(s):
                    found.setdefault(_sid(s), s)
            at = _bits(np.array([*found], np.int64))
            keep = ((bloom[at >> 6] >> (at & 63)) & 1).all(0) if found else []
            some = [x for x, k in zip(found.items(), keep, strict=True) if k]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.int64()), pa.array([s.tobytes() for _, s in some], pa.binary())], names=["sid", "items"])

    sets = store(texts.mapInArrow(whole, "sid long, items binary").dropDuplicates(["sid"]), "sets")
    release(spark)

    postings = sets.mapInArrow(_all_postings, "h long, sid long")
    lengths = postings.groupBy("h").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    own = Window.partitionBy("sid")
    live = postings.join(lengths, "h").withColumn("place", F.row_number().over(own.orderBy("length", "h"))).withColumn("live", F.count(F.lit(1)).over(own))
    # Of a set's n - T + 1 first shingles, those that are its own come first and make no candidates. ``left``: how many
    # shingles of the set come after this one; ``own``: the share that no other set has.
    lists = live.join(named, "sid").where(F.col("place") <= F.col("live") - F.ceil(F.col("n") * link / 100) + 1)
    lists = store(lists.select("h", "sid", "n", (F.col("live") - F.col("place")).alias("left"), (1 - F.col("live") / F.col("n")).alias("own")), "lists")
    release(spark)

    comps = store(lists.select("sid").distinct().withColumn("component", F.col("sid")), "components")
    for k in range(PIVOT_ROUNDS):
        at = lists.join(comps, "sid")
        # The first pivot of a list is its most central set, as an original is among its edited copies.
        order = F.struct(F.lit(0.0) if k else F.col("own"), F.xxhash64("sid", F.lit(k)), "sid", "component")
        pivots = at.groupBy("h").agg(F.min(order).alias("pivot"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        met = at.join(pivots.where("lo <> hi").drop("lo", "hi"), "h").where("component <> pivot.component")
        votes = met.groupBy(F.col("sid").alias("c"), F.col("pivot.sid").alias("q")).agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("c").agg(F.max(F.struct("n", "q")).alias("best")).select(F.col("best.q").alias("q"), "c")
        comps = _merge(comps, _search_pairs(best, sets, link))
    at = lists.join(comps, "sid")
    split = at.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h")
    rest = at.join(split, "h", "left_semi").select("h", "sid", "component", "n", "left")
    rest = rest.repartition(parts(spark), "h").sortWithinPartitions("h", "component", "sid").mapInArrow(_cross(link), "q long, c long").distinct()
    comps = _merge(comps, _search_pairs(rest, sets, link))
    out = sketch.join(comps, "sid", "left")
    return out.select("doc_id", "uid", "sha", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "sid")).alias("class"))


def near_duplicates(docs: DataFrame, *, link: int = LINK, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the least id that links reach, itself included).

    Words are separated by ASCII white space, A-Z lower-cased. Null or empty text has no shingles and is alone, as is
    a row without id, unless its text links it to others; ids that repeat are rows like any other.
    """
    rows = store(classes(docs, link=link, text=text, id_col=id_col), "classes")
    groups = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("group_size"))
    some = join_groups(rows.where("class is not null"), store(groups, "groups"), ["class"])
    alone = rows.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.select("doc_id", "n_shingles", F.col("least").alias("component_id")).unionByName(alone)


def drop_near_duplicates(docs: DataFrame, *, link: int = LINK, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the row with the least id (a null id
    is the last to stay), and every row without shingles."""
    rows = store(classes(docs, link=link, text=text, id_col=id_col), "classes")
    first = rows.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid", "sha")).alias("r"))
    alone = rows.where("class is null").select("doc_id", "sha", F.lit(True).alias("every")).distinct()
    kept = first.select("r.doc_id", "r.sha", F.lit(False).alias("every")).unionByName(alone)
    return keep_rows(docs, kept, content=F.col(f"`{text}`"), id_col=id_col)
