"""First-wins, ranking, merging and versioning. Ties are always broken by a named order, so results don't depend on
how rows are dealt out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import is_present


def _ordered(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in a total order (deduplication, best record, latest version, top k)."""
    return _ordered(df, keys, order).where(F.col("_place") <= n).drop("_place")


def best_row(df: DataFrame, keys: Sequence[str], rank: Sequence[Column], *, least: bool = True) -> DataFrame:
    """The row of each key with the least (or greatest) rank. Aggregation is partial, so a hot key is reduced in each
    task before the shuffle; as whole rows are its buffers, the engine sorts each task's rows by key for it.
    ``rank`` must be total."""
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])
    pick = F.min_by if least else F.max_by
    return df.groupBy(*keys).agg(pick(row, rank).alias("_row")).select("_row.*")


def latest(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The newest row of each key."""
    return best_row(df, keys, [F.col(c) for c in version], least=False)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key (audit trails, recent jobs)."""
    return first_by(df, keys, [F.col(c).desc() for c in order], n)


def merge_by_priority(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, fields: Sequence[str] = (), lists: Sequence[str] = (), greatest: Sequence[str] = (), source: str | None = None) -> DataFrame:
    """One row per key: of each field the first present value in the order given, of list fields their union in that
    order, of ``greatest`` fields the maximum, and ``sources`` in order."""
    place = F.struct(*[F.col(c) for c in order])
    aggs = [F.min_by(F.when(is_present(c), F.col(c)), F.when(is_present(c), place)).alias(c) for c in fields]
    for c in lists:
        rows = F.array_sort(F.collect_list(F.when(F.size(c) > 0, F.struct(place.alias("p"), F.col(c).alias("v")))))
        aggs.append(F.array_distinct(F.flatten(F.transform(rows, lambda r: r["v"]))).alias(c))
    aggs += [F.max(c).alias(c) for c in greatest]
    if source:
        rows = F.array_sort(F.collect_set(F.struct(place.alias("p"), F.col(source).alias("v"))))
        aggs.append(F.array_distinct(F.transform(rows, lambda r: r["v"])).alias("sources"))
    return df.groupBy(*keys).agg(*aggs)


def disagreements(df: DataFrame, keys: Sequence[str], fields: Sequence[str], source: str) -> DataFrame:
    """Fields for which a key's sources give different present values: key, field, alternatives (value and its
    sources). Nothing is adjudicated."""
    shown = {f: F.when(is_present(f), F.col(f).cast("string")) for f in fields}
    # Most keys agree: those with two hashes of a field are found by numbers alone, and only their rows go on.
    ends = [x(F.xxhash64(F.lit(i), c)).alias(f"_{n}{i}") for i, c in enumerate(shown.values()) for n, x in (("lo", lambda h, c=c: F.min(F.when(c.isNotNull(), h))), ("hi", lambda h, c=c: F.max(F.when(c.isNotNull(), h))))]
    differ = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(*ends)
    some = differ.where(reduce(lambda a, b: a | b, [F.col(f"_lo{i}") != F.col(f"_hi{i}") for i in range(len(fields))]))
    df = df.join(some, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]), "left_semi")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")
    long = df.select(*keys, source, pairs).where(is_present("p.value")).select(*keys, F.col("p.field").alias("field"), F.col("p.value").alias("value"), source)
    by_value = long.groupBy(*keys, "field", "value").agg(F.array_sort(F.collect_set(source)).alias("sources"))
    return by_value.groupBy(*keys, "field").agg(F.array_sort(F.collect_list(F.struct("value", "sources"))).alias("alternatives")).where(F.size("alternatives") > 1)


def conflict_groups(df: DataFrame, keys: Sequence[str], *, value: str | None = None, status: str | None = None, spread: float = 0.0) -> DataFrame:
    """Keys with more than one status, or with values farther apart than ``spread``: statuses, values and rows."""
    statuses = F.array_sort(F.collect_set(status)) if status else F.array().cast("array<string>")
    values = F.array_sort(F.collect_set(value)) if value else F.array().cast("array<double>")
    out = df.groupBy(*keys).agg(statuses.alias("statuses"), values.alias("values"), F.count(F.lit(1)).alias("n_rows"))
    apart = (F.size("values") > 1) & (F.element_at("values", -1) - F.get("values", F.lit(0)) > spread)
    return out.where((F.size("statuses") > 1) | F.coalesce(apart, F.lit(False)))


def mark_conflicts(df: DataFrame, keys: Sequence[str], value: Sequence[str], *, status: str = "status") -> DataFrame:
    """Rows whose key has several values become pending, side by side, with a conflict id; no vote, no average."""
    w = Window.partitionBy(*keys)
    digest = F.sha2(F.to_json(F.struct(*value), {"ignoreNullFields": "false"}).cast("binary"), 256)
    several = F.min(digest).over(w) != F.max(digest).over(w)
    name = F.concat(F.lit("conflict_"), F.substring(F.sha1(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).cast("binary")), 1, 12))
    return df.withColumn("_several", several).withColumn("conflict_id", F.when(F.col("_several"), name)).withColumn(status, F.when(F.col("_several"), "pending").otherwise(F.col(status))).drop("_several")


def overlay(base: DataFrame, manual: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """A manual layer over a generated one: present manual values win field by field; the base isn't changed."""
    m = manual.select(F.col(key), *[F.col(f).alias(f"_m_{f}") for f in fields])
    joined = base.join(m, key, "left")
    out = joined.withColumns({f: F.when(is_present(f"_m_{f}"), F.col(f"_m_{f}")).otherwise(F.col(f)) for f in fields})
    used = F.array_compact(F.array(*[F.when(is_present(f"_m_{f}"), F.lit(f)) for f in fields]))
    return out.withColumn("overridden", used).select(*base.columns, "overridden")


def distinct_in_order(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Order-preserving distinct: first rows, with ``position`` in the order of first appearance within nothing but
    ``seq`` itself (no global sort)."""
    return best_row(df, keys, [F.col(seq)])


def carry_down(df: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str], *, reset: str | None = None) -> DataFrame:
    """Empty cells take the cell above, as merged cells do; a change of ``reset`` starts anew."""
    w = Window.partitionBy(*group, *([reset] if reset else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(F.when(is_present(c), F.col(c)), ignorenulls=True).over(w) for c in columns})


def within_budget(df: DataFrame, group: Sequence[str], order: Sequence[str], size: str, budget: int) -> DataFrame:
    """Adds ``selected``: whether the running size up to a row fits the budget; the rest is kept, unselected."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("selected", F.sum(size).over(w) <= budget)


def version_collisions(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Ids of an append-only table that were written with different payloads: an error of the writer."""
    return df.groupBy(key).agg(F.min(payload).alias("a"), F.max(payload).alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select(key)


def append_new(stored: DataFrame, incoming: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows to append: idempotent puts leave out what is stored; ``version_collisions`` of the union finds errors."""
    return incoming.dropDuplicates([key, payload]).join(stored.select(key, payload), [key, payload], "left_anti")


def superseded_out(df: DataFrame, key: str, supersedes: str) -> DataFrame:
    """Rows that no other row supersedes."""
    gone = df.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(key)).distinct()
    return df.join(gone, key, "left_anti")
