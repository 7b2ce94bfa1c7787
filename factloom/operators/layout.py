"""Joins on page geometry: neighbours, containment, wrapped labels, repaired links, independent readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import overlap_share, rectangle


def _side(box: str, i: int) -> Column:
    return F.get(rectangle(box), F.lit(i))


def reading_order(df: DataFrame, page: str, box: str, *, panel_width: float) -> DataFrame:
    """Adds panel, y and ``place`` keys; sort by page, panel, y."""
    return df.withColumn("panel", F.floor(_side(box, 0) / panel_width).cast("int")).withColumn("y", _side(box, 1))


def blocks_above(blocks: DataFrame, tables: DataFrame, key: Sequence[str], *, reach: float = 110.0) -> DataFrame:
    """Blocks whose lower edge is at most ``reach`` above a table in the same panel: table_id, block_id, distance. A
    bucketed equi-join on height, not a nested loop."""
    b = blocks.select(*key, F.col("id").alias("block_id"), _side("bbox", 3).alias("_low")).withColumn("_k", F.floor(F.col("_low") / reach).cast("long"))
    t = tables.select(*key, F.col("id").alias("table_id"), _side("bbox", 1).alias("_top"))
    t = t.withColumn("_k", F.explode(F.array(F.floor(F.col("_top") / reach).cast("long"), (F.floor(F.col("_top") / reach) - 1).cast("long"))))
    out = b.join(t, [*key, "_k"]).withColumn("distance", F.col("_top") - F.col("_low")).where(F.col("distance").between(0, reach))
    return out.select(*key, "table_id", "block_id", "distance")


def blocks_in_tables(blocks: DataFrame, tables: DataFrame, key: Sequence[str]) -> DataFrame:
    """Ids of blocks whose centre lies in some table of their page."""
    b = blocks.select(*key, F.col("id").alias("block_id"), ((_side("bbox", 0) + _side("bbox", 2)) / 2).alias("_x"), ((_side("bbox", 1) + _side("bbox", 3)) / 2).alias("_y"))
    t = tables.select(*key, *[_side("bbox", i).alias(f"_t{i}") for i in range(4)])
    return b.join(t, list(key)).where("_x between _t0 and _t2 and _y between _t1 and _t3").select("block_id").distinct()


def wrapped_labels(items: DataFrame, key: Sequence[str]) -> DataFrame:
    """Short labels that wrap onto one centred line below: first_id, second_id, text, bbox. Only the single fitting
    line joins; the pieces stay as they are. ``items``: key, id, text, bbox; a page's labels are few."""
    box = lambda p, i: F.get(F.col(f"{p}_box"), F.lit(i))
    rows = items.select(*key, "id", F.trim("text").alias("text"), rectangle("bbox").alias("box"))
    rows = rows.where(F.col("text").rlike(r"^[一-鿿]{2,12}$") & (F.get("box", F.lit(3)) > F.get("box", F.lit(1))))
    side = lambda p: rows.select(*key, *[F.col(c).alias(f"{p}_{c}") for c in ("id", "text", "box")])
    pairs = side("a").where(F.length("a_text") >= 4).join(side("b").where(F.length("b_text") <= 4), list(key))
    ha, hb = box("a", 3) - box("a", 1), box("b", 3) - box("b", 1)
    gap, small = box("b", 1) - box("a", 3), F.least(ha, hb)
    fits = (
        gap.between(-0.1 * small, 0.25 * small) & (ha / hb).between(0.65, 1.55) & (F.abs((box("a", 0) + box("a", 2) - box("b", 0) - box("b", 2)) / 2) <= 0.35 * small)
        & (box("b", 2) - box("b", 0) <= 0.75 * (box("a", 2) - box("a", 0))) & ~F.contains("a_text", "b_text")
    )
    out = pairs.where(fits).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key, "a_id"))).where("_n = 1")
    joined = F.array(F.least(box("a", 0), box("b", 0)), box("a", 1), F.greatest(box("a", 2), box("b", 2)), box("b", 3))
    return out.select(*key, F.col("a_id").alias("first_id"), F.col("b_id").alias("second_id"), F.concat("a_text", "b_text").alias("text"), joined.alias("bbox"))


def repaired_links(native: DataFrame, rebuilt: DataFrame, key: Sequence[str], *, least: float = 0.9) -> DataFrame:
    """Rebuilt text blocks with the native block that covers ``least`` of their area, if there is exactly one."""
    n = native.select(*key, F.col("id").alias("native_id"), F.col("bbox").alias("_nb"))
    r = rebuilt.select(*key, F.col("id").alias("rebuilt_id"), F.col("bbox").alias("_rb"))
    hits = r.join(n, list(key)).where(overlap_share("_rb", "_nb") >= least)
    hits = hits.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("rebuilt_id")))
    return hits.where("_n = 1").select("rebuilt_id", "native_id")


def independent_readings(first: DataFrame, second: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Two readings of the same facts: agree, differ, or only in one; repeated keys on a side are ambiguous."""

    def side(df, p):
        return df.groupBy(*key).agg(F.count(F.lit(1)).alias(f"{p}_n"), F.min(value).alias(f"{p}_value"))

    out = side(first, "a").join(side(second, "b"), list(key), "full_outer")
    state = F.when((F.col("a_n") > 1) | (F.col("b_n") > 1), "ambiguous").when(F.col("a_n").isNull(), "only_second").when(F.col("b_n").isNull(), "only_first").when(F.col("a_value").eqNullSafe(F.col("b_value")), "agree").otherwise("differ")
    return out.select(*key, "a_value", "b_value", state.alias("state"))


def overlap_clusters(items: DataFrame, key: Sequence[str], start: str, end: str, rank: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """Clusters of overlapping spans by a sweep (a span opens a cluster if it begins after all before it end), and the
    best item of each as ``chosen``."""
    w = Window.partitionBy(*key).orderBy(start, *order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = items.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    out = out.withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.row_number().over(Window.partitionBy(*key, "cluster").orderBy(*rank, *order)) == 1
    return out.withColumn("chosen", best).drop("_new")


def reverse_index(facts: DataFrame, fact_id: str, cells: str) -> DataFrame:
    """cell and the facts that use it."""
    return facts.select(fact_id, F.explode(cells).alias("cell")).groupBy("cell").agg(F.array_sort(F.collect_set(fact_id)).alias("facts"))


def related_sources(sources: DataFrame, links: DataFrame, page: str, *, within: int) -> DataFrame:
    """Pairs of sources (id, document_id, page) on one page, or on linked pages of a document within some pages."""
    a = sources.select(F.col("id").alias("a"), "document_id", F.col(page).alias("pa"))
    same = a.join(sources.select(F.col("id").alias("b"), "document_id", F.col(page).alias("pa")), ["document_id", "pa"]).where("a <> b").select("a", "b")
    far = links.where(F.abs(F.col("from_page") - F.col("to_page")) <= within)
    x = a.join(far, (a["document_id"] == far["document_id"]) & (a["pa"] == far["from_page"])).select("a", far["document_id"].alias("document_id"), "to_page")
    b = sources.select(F.col("id").alias("b"), "document_id", F.col(page).alias("to_page"))
    return same.unionByName(x.join(b, ["document_id", "to_page"]).where("a <> b").select("a", "b")).distinct()


def attribution_partition(units: DataFrame, claims: DataFrame) -> DataFrame:
    """Units (unit_id) with the owners that claim them: attributed (one), disputed (several, none picked), unassigned."""
    by = claims.groupBy("unit_id").agg(F.array_sort(F.collect_set("owner")).alias("owners"))
    out = units.join(by, "unit_id", "left").withColumn("owners", F.coalesce("owners", F.array().cast("array<string>")))
    n = F.size("owners")
    return out.withColumn("state", F.when(n == 1, "attributed").when(n > 1, "disputed").otherwise("unassigned"))
