"""Declarative conditions and rules compiled to columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import safe_float

OPERATORS = ("exists", "contains", "in", "gt", "gte", "lt", "lte", "eq", "neq")


def condition(field: str, operator: str, expected=None, *, kind: str = "text") -> Column:
    """A condition on a field as a boolean column that is never null.

    ``kind`` is text (any scalar; compared as text, or as numbers where both sides are finite) or list (array of
    text: any item may fit). A missing value fits nothing but makes ``exists`` false; ``neq`` of NaN or infinity is
    false. Unknown operators are refused here, when the plan is made.
    """
    if operator not in OPERATORS:
        raise ValueError(f"unsupported operator {operator}")
    c = F.col(field)
    if kind == "list":
        there = c.isNotNull() & (F.size(c) > 0)
        items = F.transform(c, lambda x: x.cast("string"))
        many = [str(x) for x in (expected if isinstance(expected, (list, tuple)) else [expected])]
        found = {
            "exists": F.lit(True),
            "contains": F.exists(items, lambda x: F.contains(x, F.lit(str(expected)))),
            "in": F.exists(items, lambda x: x.isin(many)),
            "eq": F.array_contains(items, str(expected)),
            "neq": ~F.array_contains(items, str(expected)),
        }.get(operator, F.lit(False))
        return F.coalesce(there & found, F.lit(False))
    text = c.cast("string")
    there = c.isNotNull() & (text != "")
    if operator == "exists":
        return F.coalesce(there, F.lit(False))
    number = safe_float(text)
    try:
        bound = float(expected) if not isinstance(expected, (list, tuple)) else None
        bound = bound if bound is not None and math.isfinite(bound) else None
    except (TypeError, ValueError):
        bound = None
    if operator == "contains":
        found = F.contains(text, F.lit(str(expected)))
    elif operator == "in":
        found = text.isin([str(x) for x in (expected if isinstance(expected, (list, tuple)) else [expected])])
    elif operator in ("gt", "gte", "lt", "lte"):
        if bound is None:
            return F.lit(False)
        found = {"gt": number > bound, "gte": number >= bound, "lt": number < bound, "lte": number <= bound}[operator]
    else:
        same = text == str(expected)
        if bound is not None:
            same = F.when(number.isNotNull(), number == bound).otherwise(same)
        wild = text.try_cast("double")
        found = same if operator == "eq" else ~same & ~F.coalesce(F.isnan(wild) | (F.abs(wild) == float("inf")), F.lit(False))
    return F.coalesce(there & found, F.lit(False))


def rule(spec: Mapping, kinds: Mapping[str, str] | None = None) -> Column:
    """All or any of a rule's conditions; false unless it is approved, enabled and executable and has conditions."""
    kinds = kinds or {}
    runs = spec.get("approval_status", "approved") == "approved" and spec.get("enabled", True) and spec.get("executable", True)
    parts = [condition(c["field"], c["operator"], c.get("value"), kind=kinds.get(c["field"], "text")) for c in spec.get("conditions", [])]
    if not runs or not parts:
        return F.lit(False)
    return reduce(lambda a, b: a | b if spec.get("match") == "any" else a & b, parts)


def evaluate_rules(df: DataFrame, rules: Sequence[Mapping], *, outputs: Sequence[str] = ("P1", "P2", "P3", "P4"), kinds: Mapping[str, str] | None = None) -> DataFrame:
    """Adds ``matched_rules`` (ids, in the rules' order) and ``rule_output`` (the first of ``outputs`` that a matched
    rule gives; null for none). Rules with any other output never run."""
    usable = [r for r in rules if r.get("output") in outputs]
    if not usable:
        return df.withColumn("matched_rules", F.array().cast("array<string>")).withColumn("rule_output", F.lit(None).cast("string"))
    hits = [(r, rule(r, kinds)) for r in usable]
    ids = F.array_compact(F.array(*[F.when(h, F.lit(str(r["id"]))) for r, h in hits]))
    rank = F.array_min(F.array_compact(F.array(*[F.when(h, F.lit(list(outputs).index(r["output"]))) for r, h in hits])))
    return df.withColumn("matched_rules", ids).withColumn("rule_output", F.get(F.array(*map(F.lit, outputs)), rank))


def normalise_rules(rules: DataFrame, fields: Sequence[str], *, outputs: Sequence[str] = ("P1", "P2", "P3", "P4")) -> DataFrame:
    """Rules with ``conditions array<struct<field,operator,value>>``: adds ``unsupported`` (reasons), ``executable``
    and ``enabled``. Rules that cannot run are kept, never dropped."""
    bad = lambda test, text: F.when(test, F.lit(text))
    reasons = F.array_compact(
        F.array(
            bad(F.coalesce(F.size("conditions"), F.lit(0)) < 1, "no_conditions"),
            bad(F.exists("conditions", lambda c: ~F.coalesce(c["field"].isin(list(fields)), F.lit(False))), "unknown_field"),
            bad(F.exists("conditions", lambda c: ~F.coalesce(c["operator"].isin(list(OPERATORS)), F.lit(False))), "unknown_operator"),
            bad(F.exists("conditions", lambda c: c["operator"].isin("gt", "gte", "lt", "lte") & safe_float(c["value"]).isNull()), "not_a_number"),
            bad(~F.coalesce(F.col("output").isin(list(outputs)), F.lit(False)), "unknown_output"),
        )
    )
    out = rules.withColumn("unsupported", F.coalesce(reasons, F.array(F.lit("no_conditions"))))
    out = out.withColumn("executable", F.size("unsupported") == 0)
    return out.withColumn("enabled", F.col("executable") & (F.col("approval_status") == "approved"))


def validate_values(values: DataFrame, specs: DataFrame) -> DataFrame:
    """Fields (field, value as text) against ``specs`` (field, type, minimum, maximum, options array, max_length): adds
    ``problem`` (null if fine). Booleans aren't numbers, and missing values aren't judged."""
    joined = values.join(F.broadcast(specs), "field", "left")
    number, text = safe_float("value"), F.col("value")
    problem = (
        F.when(~F.coalesce(text != "", F.lit(False)), None)
        .when(F.col("type").isNull(), "unknown_field")
        .when((F.col("type") == "number") & number.isNull(), "not_a_finite_number")
        .when((F.col("type") == "number") & (number < F.col("minimum")), "below_minimum")
        .when((F.col("type") == "number") & (number > F.col("maximum")), "above_maximum")
        .when((F.size("options") > 0) & ~F.array_contains("options", text), "not_an_option")
        .when(F.length(text) > F.col("max_length"), "too_long")
    )
    return joined.withColumn("problem", problem).select(*values.columns, "problem")


def search(df: DataFrame, *, words: str = "", over: Sequence[str] = (), equal: Mapping[str, object] | None = None, date: str | None = None, start=None, end=None, undated: bool = False) -> DataFrame:
    """Rows that fit all filters: equality, a date range (undated rows only when asked for) and a case-folded
    substring over concatenated fields."""
    out = df
    for k, v in (equal or {}).items():
        out = out.where(F.col(k) == v)
    if date and (start is not None or end is not None):
        inside = F.lit(True)
        inside = inside & (F.col(date) >= F.lit(start)) if start is not None else inside
        inside = inside & (F.col(date) <= F.lit(end)) if end is not None else inside
        out = out.where(F.coalesce(inside, F.lit(undated)))
    if words and over:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in over])), F.lit(words.lower())))
    return out


def page(df: DataFrame, order: Sequence, *, limit: int, offset: int = 0, most: int = 1000) -> DataFrame:
    """One page in a total order; bounds are checked."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 1 to {most} and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of each value of several columns, in one pass: field, value, n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return df.select(pairs).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))
