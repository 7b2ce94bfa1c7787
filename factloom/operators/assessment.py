"""Typed facts, band tables, matrices and resolution of variables with explicit scopes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import interval_meets, is_present

# Names of the three grades of harm.
HARMS = ("危害小", "危害中等", "危害大")


def band_grades(low, high, low_closed, high_closed, a: float, b: float, names: Sequence[str] = HARMS) -> Column:
    """Grades whose band an interval meets: [0, a), [a, b], (b, ∞). A number is the closed interval of itself."""
    inf = float("inf")
    bands = [(names[0], 0.0, a, True, False), (names[1], a, b, True, True), (names[2], b, inf, False, False)]
    return F.array_compact(F.array(*[F.when(interval_meets(low, high, low_closed, high_closed, x, y, xc, yc), F.lit(n)) for n, x, y, xc, yc in bands]))


def table_grade(facts: DataFrame, bands: DataFrame, key: str) -> DataFrame:
    """Grades of an object's indicators (key, variable, low, high, low_closed, high_closed, unit) against ``bands``
    (variable, unit, low_boundary, high_boundary). Facts in another unit or without band are left out and counted;
    indicators that disagree keep all their grades and give none."""
    rows = facts.join(F.broadcast(bands.withColumnRenamed("unit", "_unit")), "variable", "left")
    usable = F.col("low_boundary").isNotNull() & (F.col("unit") == F.col("_unit"))
    lo, hi, a, b = F.coalesce("low", F.lit(float("-inf"))), F.coalesce("high", F.lit(float("inf"))), F.col("low_boundary"), F.col("high_boundary")
    small = (lo < a) & ((hi > 0) | ((hi == 0) & F.col("high_closed")))
    middle = ((lo < b) | ((lo == b) & F.col("low_closed"))) & ((hi > a) | ((hi == a) & F.col("high_closed")))
    grades = F.array_compact(F.array(F.when(small, F.lit(HARMS[0])), F.when(middle, F.lit(HARMS[1])), F.when(hi > b, F.lit(HARMS[2]))))
    rows = rows.withColumn("grades", F.when(F.coalesce(usable, F.lit(False)), grades))
    out = rows.groupBy(key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("grades")))).alias("possible"), F.count_distinct("grades").alias("_kinds"), F.count_if(F.col("grades").isNull()).alias("unusable"), F.count_distinct(F.when(F.col("grades").isNotNull(), F.col("variable"))).alias("indicators")
    )
    grade = F.when((F.size("possible") == 1) & (F.col("_kinds") == 1), F.get("possible", F.lit(0)))
    return out.withColumn("conflict", F.col("_kinds") > 1).withColumn("grade", grade).drop("_kinds")


def branch_product(objects: DataFrame, matrix: DataFrame, key: str) -> DataFrame:
    """Grades of all branches of an object's possible developments and harms (arrays) in ``matrix`` (development,
    harm, grade): the branches, the possible grades, and one grade if there is only one."""
    rows = objects.select(key, F.explode("developments").alias("development"), "harms").select(key, "development", F.explode("harms").alias("harm"))
    rows = rows.join(F.broadcast(matrix), ["development", "harm"], "left")
    out = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("development", "harm", "grade"))).alias("branches"), F.array_sort(F.collect_set("grade")).alias("possible"))
    return out.withColumn("grade", F.when(F.size("possible") == 1, F.get("possible", F.lit(0))))


def coefficient_axis(factor, required) -> Column:
    """Axis of a factor and its required value: at or below 1 it needs no other; without the other it is unknown."""
    return F.when(factor <= 1, "不稳定").when(required.isNull() | (required <= 1), None).when(factor <= required, "欠稳定").otherwise("稳定")


def fact_problems() -> Column:
    """Contract violations of a fact (kind, value, lower, upper, unit, role, support): reasons, empty if none."""
    numeric = F.col("kind").isin("number", "interval")
    bad = lambda c, t: F.when(F.coalesce(c, F.lit(False)), F.lit(t))
    return F.array_compact(
        F.array(
            bad(~is_present("fact_id"), "no_id"),
            bad(~is_present("variable"), "no_variable"),
            bad(~F.coalesce(F.col("kind").isin("number", "interval", "code", "text"), F.lit(False)), "unknown_kind"),
            bad((F.col("kind") == "number") & (F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))), "not_finite"),
            bad((F.col("kind") == "interval") & (F.col("lower") > F.col("upper")), "bounds_reversed"),
            bad((F.col("kind") == "interval") & F.col("lower").isNull() & F.col("upper").isNull(), "no_bounds"),
            bad(numeric & ~is_present("unit"), "no_unit"),
        )
    )


def applicability(dimensions: dict[str, Column]) -> Column:
    """Per dimension applicable, inapplicable or unknown (from a boolean or null), and the whole: one inapplicable
    makes it inapplicable, else one unknown makes it unknown."""
    states = {k: F.when(v.isNull(), "unknown").when(v, "applicable").otherwise("inapplicable") for k, v in dimensions.items()}
    every = F.array(*states.values())
    whole = F.when(F.array_contains(every, "inapplicable"), "inapplicable").when(F.array_contains(every, "unknown"), "unknown").otherwise("applicable")
    return F.struct(whole.alias("overall"), *[v.alias(k) for k, v in states.items()])


def scope_exclusions(checks: dict[str, Column]) -> Column:
    """Names of the scope checks that fail or are unknown."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))


def resolve_variables(facts: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """State of each wanted variable of each object: selected (one usable value), conflicted (several), candidates (only
    unusable ones) or missing. ``facts``: key, variable, value (text), usable, fact_id; ``wanted``: key, variable."""
    by = facts.groupBy(key, "variable").agg(
        F.count_distinct(F.when(F.col("usable"), F.col("value"))).alias("_values"), F.array_sort(F.collect_set(F.when(F.col("usable"), F.col("fact_id")))).alias("fact_ids"), F.min(F.when(F.col("usable"), F.col("value"))).alias("_value"), F.count(F.lit(1)).alias("_n")
    )
    out = wanted.join(by, [key, "variable"], "left")
    n = F.coalesce("_values", F.lit(0))
    state = F.when(n == 1, "selected").when(n > 1, "conflicted").when(F.col("_n") > 0, "candidates").otherwise("missing")
    return out.select(key, "variable", state.alias("state"), F.when(n == 1, F.col("_value")).alias("value"), F.coalesce("fact_ids", F.array().cast("array<string>")).alias("fact_ids"))


def derived_id(*inputs: str) -> Column:
    """The id of a derivation: a digest of its canonical inputs, so equal derivations are one."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(inputs)]), {"ignoreNullFields": "false"}).cast("binary"), 256)


def compose_problems(snapshots: DataFrame) -> DataFrame:
    """Paths with several digests, and cases that mix test and business data or periods: case_id, problem, item."""
    path = snapshots.groupBy("case_id", "path").agg(F.count_distinct("sha256").alias("n")).where("n > 1").select("case_id", F.lit("path_with_several_contents").alias("problem"), F.col("path").alias("item"))
    parts = [path]
    for c in ("purpose", "period", "scenario"):
        parts.append(snapshots.groupBy("case_id").agg(F.count_distinct(c).alias("n")).where("n > 1").select("case_id", F.lit(f"several_{c}s").alias("problem"), F.lit(c).alias("item")))
    return reduce(DataFrame.unionByName, parts)


def evidence_packet(rows: DataFrame, key: str, checks: dict[str, Column], order: Sequence[str], size: str, budget: int) -> DataFrame:
    """Rows with ``excluded`` (why, or null) and ``selected``: in order, each row that still fits the budget; larger ones
    are passed over, not cut. Packets are bounded by their object, which one Arrow group holds."""
    import pandas as pd

    reason = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()], F.lit(None).cast("string"))
    marked = rows.withColumn("excluded", reason).withColumn("selected", F.lit(False))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        left = budget
        pdf = pdf.sort_values(list(order), kind="stable").reset_index(drop=True)
        for i, (why, n) in enumerate(zip(pdf["excluded"], pdf[size], strict=True)):
            if why is None and n <= left:
                pdf.loc[i, "selected"] = True
                left -= n
        return pdf

    return marked.groupBy(key).applyInPandas(fill, marked.schema)
