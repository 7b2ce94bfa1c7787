"""Facts from table cells: every number with the labels above and before it.

Tables are arrays of rows of text. Cells become rows, header rows are found, labels are carried over merged cells,
and each number of the body meets the labels of its column and of its row. One grammar serves parameter-per-row,
parameter-per-column and two-level headers: a number counts if its labels name one condition and one measure, however
they are laid out; anything ambiguous is left out, with its reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import finite

# Names of working conditions; names of measures and their units, in lower case.
CONDITIONS = ("天然", "饱和", "饱水", "暴雨", "地震", "正常", "非正常", "现状")
MEASURES = (
    ("unit_weight", "重度|γ", "kn/m3"),
    ("cohesion", "内聚力|黏聚力|粘聚力|^c[/（(]", "kpa"),
    ("friction_angle", "内摩擦角|φ|ϕ", "°|º|度"),
    ("required_factor", "^(?:设计|要求)?安全系数$", ""),
    ("safety_factor", "^(?:危岩|浅层|整体)?(?:边坡)?稳定性?系数(?:f[s]?|k)?$|^fs?$", ""),
)


def cells(df: DataFrame, key: Sequence[str], rows: str) -> DataFrame:
    """key, r, c, cell (without white space) and number (null if it isn't one)."""
    e = df.select(*key, F.posexplode(rows).alias("r", "_row")).select(*key, "r", F.posexplode("_row").alias("c", "_cell"))
    e = e.withColumn("cell", F.regexp_replace(F.coalesce("_cell", F.lit("")), r"(?U)\s+", "")).drop("_cell")
    return e.withColumn("number", F.when(F.col("cell").rlike(r"^-?\d+(?:\.\d+)?$"), finite(F.col("cell").try_cast("double"))))


def header_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds ``header``: leading label rows of each table's cells. The first row with a number beside something else (or
    several numbers) begins the body; consecutive column numbers are labels; a table without body has one header row."""
    row = Window.partitionBy(*key, "r")
    filled, numbers = F.count_if(F.col("cell") != "").over(row), F.count("number").over(row)
    whole = F.count_if(F.col("number") == F.floor("number")).over(row)
    run = (F.max("number").over(row) - F.min("number").over(row) + 1 == numbers) & (whole == filled) & (numbers >= 3) & (filled < F.count(F.lit(1)).over(row)) & (F.col("r") > 0)
    out = df.withColumn("_body", ~F.coalesce(run, F.lit(False)) & ((numbers >= 2) | ((numbers > 0) & (filled > 1))))
    first = F.min(F.when(F.col("_body"), F.col("r"))).over(Window.partitionBy(*key))
    return out.withColumn("header", F.when(first.isNull(), F.col("r") == 0).otherwise(F.col("r") < first)).drop("_body")


def condition_of(labels) -> Column:
    """The one condition that labels name, else null."""
    text = F.array_join(labels, "|")
    plain = F.replace(text, F.lit("非正常"), F.lit("\u0001"))
    found = F.array_compact(F.array(*[F.when(F.contains(plain, F.lit("\u0001" if x == "非正常" else x)), F.lit(x)) for x in CONDITIONS]))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def measure_of(labels) -> Column:
    """The one measure that some label is, else null: the label holds one of its names and, anywhere, one of its units."""

    def like(name: str, unit: str) -> Column:
        def holds(x):
            x = F.replace(F.lower(x), F.lit("³"), F.lit("3"))
            return F.regexp_like(x, F.lit(name)) & F.regexp_like(x, F.lit(unit))

        return F.exists(labels, holds)

    found = F.array_compact(F.array(*[F.when(like(name, unit), F.lit(n)) for n, name, unit in MEASURES]))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def labelled_numbers(df: DataFrame, key: Sequence[str], rows: str) -> DataFrame:
    """Numbers of table bodies: key, r, c, value, subject, measure, condition and problem (null if all is named)."""
    c = header_rows(cells(df, key, rows), key)
    levels = F.max(F.when(F.col("header"), F.col("r"))).over(Window.partitionBy(*key))
    across = F.last(F.when(F.col("cell") != "", F.col("cell")), ignorenulls=True).over(Window.partitionBy(*key, "r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("_levels", levels).withColumn("_across", across)
    # Only a parent row above another header row stands for merged cells to its right.
    label = F.when(F.col("r") < F.col("_levels"), F.col("_across")).otherwise(F.col("cell"))
    above = c.where("header").withColumn("label", label).where("label <> ''").groupBy(*key, "c").agg(F.array_sort(F.collect_list(F.struct("r", "label"))).alias("_a"))
    above = above.select(*key, "c", F.transform("_a", lambda x: x["label"]).alias("above"))
    down = F.last(F.when((F.col("cell") != "") & F.col("number").isNull(), F.col("cell")), ignorenulls=True).over(Window.partitionBy(*key, "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    body = c.where("not header").withColumn("_down", F.when(F.col("c") == 0, down).otherwise(F.when(F.col("number").isNull(), F.col("cell"))))
    before = body.where(F.col("_down") != "").groupBy(*key, "r").agg(F.array_sort(F.collect_list(F.struct("c", "_down"))).alias("_b"))
    before = before.select(*key, "r", F.transform("_b", lambda x: x["_down"]).alias("before"), F.get("_b", F.lit(0))["_down"].alias("subject"))
    out = body.where("number is not null").join(above, [*key, "c"], "left").join(before, [*key, "r"], "left")
    empty = F.array().cast("array<string>")
    labels = F.concat(F.coalesce("above", empty), F.coalesce("before", empty))
    out = out.withColumn("measure", measure_of(labels)).withColumn("condition", condition_of(labels))
    implausible = F.col("measure").isin("safety_factor", "required_factor") & ~F.col("number").between(0, 100)
    problem = F.when(F.col("measure").isNull(), "no_single_measure").when(F.col("condition").isNull(), "no_single_condition").when(implausible, "implausible_factor")
    return out.select(*key, "r", "c", F.col("number").alias("value"), "subject", "measure", "condition", problem.alias("problem"))


def stitch_headers(df: DataFrame, key: Sequence[str], order: str, rows: str) -> DataFrame:
    """Adds ``header_from``: for a table that begins with numbers, the table right before it in reading order if that is
    a single row of labels of the same width."""
    w = Window.partitionBy(*key).orderBy(order)
    width = F.size(F.get(rows, F.lit(0)))
    numeric = F.exists(F.get(rows, F.lit(0)), lambda x: F.regexp_like(F.coalesce(x, F.lit("")), F.lit(r"^\s*-?\d+(?:\.\d+)?\s*$")))
    out = df.withColumn("_w", width).withColumn("_n", numeric).withColumn("_s", F.size(rows))
    ok = F.col("_n") & ~F.lag("_n").over(w) & (F.lag("_s").over(w) == 1) & (F.lag("_w").over(w) == F.col("_w"))
    return out.withColumn("header_from", F.when(ok, F.lag(order).over(w))).drop("_w", "_n", "_s")


def table_support(df: DataFrame, claimed: str, source: str, *, least: float = 0.8) -> DataFrame:
    """Adds ``support``: the share of claimed cells that the source text holds, and ``supported`` (at or above
    ``least``)."""
    squeeze = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    filled = F.filter(F.flatten(claimed), lambda x: squeeze(F.coalesce(x, F.lit(""))) != "")
    hits = F.filter(filled, lambda x: F.contains(squeeze(F.col(source)), squeeze(x)))
    out = df.withColumn("support", F.when(F.size(filled) > 0, F.size(hits) / F.size(filled)))
    return out.withColumn("supported", F.coalesce(F.col("support") >= least, F.lit(False)))
