"""Screening of objects: priorities with reasons, matrices, gates, gaps and confidence. Unknown is never safe: what
is missing gives the lowest priority of knowledge or no judgement, not a low level."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import is_present
from .ordered import best_row

# The vocabulary and bounds of the screening rules.
UNSTABLE = ("不稳定", "欠稳定")
BASIC = "基本稳定"
STABLE = "稳定"
STATUS_ORDER = ("不稳定", "欠稳定", "基本稳定", "稳定", "满足要求")
FACTOR_UNSTABLE, FACTOR_WATCH = 1.05, 1.15
STEEP_DEGREES, HIGH_METRES = 60.0, 30.0
PRIORITIES = ("P1", "P2", "P3", "P4")
MATRIX = {
    ("较高", "高"): "高",
    ("较高", "中等"): "较高",
    ("较高", "低"): "中等",
    ("中等", "高"): "较高",
    ("中等", "中等"): "中等",
    ("中等", "低"): "较低",
    ("较低", "高"): "中等",
    ("较低", "中等"): "较低",
    ("较低", "低"): "低",
}
CONFIDENCE = ("低", "较低", "中等", "较高")


def canonical_condition(c) -> Column:
    """One name for a working condition's spellings."""
    c = F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), " ", "")
    return F.when(c.isin("天然", "天然状态", "天然工况"), "天然").when(c.isin("饱和", "饱和状态", "饱水", "饱水状态"), "饱和").otherwise(c)


def evidence_alignment(factor, status, text) -> Column:
    """exact, mismatch, page_only or missing: whether a quote holds the factor and the status it is evidence for."""
    from ..functions.values import numbers_in_text

    t = F.regexp_replace(F.col(text), " ", "")
    near = F.exists(numbers_in_text(t), lambda x: F.abs(x - F.col(factor)) < 1e-9)
    bad = (F.col(factor).isNotNull() & ~near) | (is_present(status) & ~F.contains(t, F.col(status)))
    return F.when(F.col(text).isNull(), "missing").when(t == "", "page_only").when(F.coalesce(bad, F.lit(False)), "mismatch").otherwise("exact")


def best_duplicates(rows: DataFrame, keys: Sequence[str], alignment: str, deterministic: str, evidence: str, seq: str) -> DataFrame:
    """Of records with the same scope and value, the one with the best evidence; first of equals."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in (("exact", 3), ("page_only", 2), ("missing", 1), ("mismatch", 0)) for x in p]), F.col(alignment)), F.lit(0))
    return best_row(rows, keys, [-rank, -F.col(deterministic).cast("int"), -is_present(evidence).cast("int"), F.col(seq)])


def worst_record(rows: DataFrame, key: Sequence[str], status: str, factor: str, seq: str, *, order: Sequence[str] = STATUS_ORDER) -> DataFrame:
    """The most adverse record of each object: by status, then factor (a missing one last), then sequence."""
    rank = F.coalesce(*[F.when(F.col(status) == s, i) for i, s in enumerate(order)], F.lit(9))
    return best_row(rows, key, [rank, F.coalesce(F.col(factor).cast("double"), F.lit(99.0)), F.col(seq)])


def _adverse(status: Column, factor: Column) -> Column:
    return F.coalesce(status.isin(*UNSTABLE) | (factor < FACTOR_UNSTABLE), status.isin(*UNSTABLE), F.lit(False))


def priority(status, factor, observed, *, marked, potential, rockfall, height, gradient, identified, reliable) -> Column:
    """P1 to P4 with reasons. Arguments are columns: status and factor of the worst record, ``observed`` (an anomaly was
    seen), ``marked`` (recorded as failing), ``potential`` (recorded as potentially unstable), ``rockfall``, height and
    gradient, ``identified`` (some hazard is named) and ``reliable`` (with evidence or context)."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    adverse = _adverse(status, factor)
    watch = yes(status == BASIC) | yes((factor >= FACTOR_UNSTABLE) & (factor < FACTOR_WATCH))
    high = yes(height >= HIGH_METRES) | yes(gradient >= STEEP_DEGREES)
    first = {"anomaly_observed": yes(observed), "adverse_stability": adverse, "marked_as_failing": yes(marked)}
    second = {"potentially_unstable": yes(potential), "watch_stability": watch, "rockfall_on_high_or_steep": yes(rockfall) & high}
    some = lambda d: F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in d.items()]))
    r1, r2 = some(first), some(second)
    known = yes(identified)
    level = F.when(F.size(r1) > 0, "P1").when(F.size(r2) > 0, "P2").when(known & yes(reliable), "P3").otherwise("P4")
    last = F.when(known & yes(reliable), F.array(F.lit("identified_without_recent_state"))).when(known, F.array(F.lit("identified_without_evidence"))).otherwise(F.array(F.lit("nothing_identified")))
    return F.struct(level.alias("priority"), F.when(F.size(r1) > 0, r1).when(F.size(r2) > 0, r2).otherwise(last).alias("reasons"))


def escalate(current, ruled) -> Column:
    """A rule's output may raise a priority, never lower it."""
    return F.least(F.col(current), F.coalesce(F.col(ruled), F.col(current)))


def likelihood(status, factor, observed) -> Column:
    """Level of concern from the worst record; null where nothing is known."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(observed) | _adverse(status, factor), "较高").when(yes(status == BASIC) | yes(factor < FACTOR_WATCH), "中等").when(yes(status == STABLE), "较低")


def consequence(text) -> Column:
    """Level of consequence from exposure text; null where it names none."""
    has = lambda *w: F.coalesce(text.rlike("|".join(w)), F.lit(False))
    return F.when(has("重大", "高", "大"), "高").when(has("中"), "中等").when(has("低", "小"), "低")


def matrix_table(spark, matrix: dict = MATRIX) -> DataFrame:
    return spark.createDataFrame([(*k, v) for k, v in matrix.items()], "likelihood string, consequence string, level string")


def apply_matrix(df: DataFrame, matrix: DataFrame) -> DataFrame:
    """Adds ``level``; null unless both axes are known."""
    return df.join(F.broadcast(matrix), ["likelihood", "consequence"], "left")


def susceptibility(status, factor, history, potential, identified, height, gradient) -> Column:
    """Static concern from historical records; it says nothing of the present."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    high = yes(height >= HIGH_METRES) | yes(gradient >= STEEP_DEGREES)
    return F.when(_adverse(status, factor) | yes(history) | yes(potential), "较高关注").when(yes(identified), "中等关注").when(high, "一般关注").otherwise("资料不足")


def dynamic_alert(observed, current, none_reported, validity) -> Column:
    """What recent evidence says; without it, nothing is judged."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(observed), "anomaly_found").when(yes(current) & yes(none_reported), "no_anomaly_reported").when(yes(current), "recent_data_without_threshold").when(validity == "stale", "unknown_stale").otherwise("cannot_judge")
    )


def gate(checks: dict[str, Column]) -> Column:
    """A conjunction that names what blocks it; a check that is null blocks."""
    blocking = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))
    return F.struct((F.size(blocking) == 0).alias("ready"), blocking.alias("blocking"))


def formal_gate(approved_rules, likelihood_level, consequence_level, current_evidence, rule_result, conflicts) -> Column:
    """The gate of a formal level. It never opens here: release isn't supported, and says so."""
    return gate(
        {
            "approved_rule_set": approved_rules,
            "hazard_or_likelihood_available": likelihood_level.isNotNull(),
            "consequence_available": consequence_level.isNotNull(),
            "current_dynamic_evidence": current_evidence,
            "approved_dynamic_rule_result": rule_result,
            "no_unresolved_stability_conflict": F.coalesce(conflicts, F.lit(0)) == 0,
            "formal_release_supported": F.lit(False),
        }
    )


def calculation_readiness(method, geometry, size, strength, surface, groundwater, seismic) -> Column:
    """Whether the inputs of an auditable calculation are recorded; no solver is, so it never is ready."""
    hard = gate({"method_formula_approved": method, "full_section_or_block_geometry": geometry, "material_strength_parameters": strength, "slip_surface_or_structural_model": surface, "solver_implemented": F.lit(False), "reference_case_verified": F.lit(False)})
    return F.struct(hard["ready"].alias("ready"), hard["blocking"].alias("blocking"), size.alias("basic_height_and_gradient"), groundwater.alias("groundwater_scenario"), seismic.alias("seismic_scenario_parameters"))


def confidence(stability, observed, exposure, gaps, conflicts, validity) -> Column:
    """How much a screening rests on, capped by conflicts and by stale or impossible dates."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    rank = F.when(yes(stability) & yes(observed) & yes(exposure) & (gaps <= 3), 3).when(yes(stability) & (gaps <= 8), 2).when(yes(stability) | yes(observed), 1).otherwise(0)
    cap = F.when(yes(conflicts) | validity.isin("stale", "invalid_date", "future_date"), 1).otherwise(3)
    return F.get(F.array(*map(F.lit, CONFIDENCE)), F.least(rank, cap))


def _holds_any(words: Sequence[str]):
    return lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words], F.lit(False))


def hazard_profiles(objects: DataFrame, profiles: DataFrame, key: str, labels: str, present: str) -> DataFrame:
    """Profiles whose alias an object's labels hold, with key inputs it lacks. ``profiles``: profile, aliases array,
    inputs array (a small dimension, which becomes a constant of the plan)."""
    from ..functions.values import constants

    hits = []
    for profile, aliases, inputs in constants(profiles, "profile", "aliases", "inputs"):
        fits = F.exists(labels, _holds_any(aliases))
        lacks = F.array_sort(F.array_except(F.array(*map(F.lit, inputs)).cast("array<string>"), F.col(present)))
        hits.append(F.when(fits, F.struct(F.lit(profile).alias("profile"), lacks.alias("missing_inputs"))))
    if not hits:
        return objects.select(key, F.lit(None).cast("string").alias("profile"), F.array().cast("array<string>").alias("missing_inputs")).limit(0)
    rows = objects.select(key, F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return rows.select(key, "h.profile", "h.missing_inputs").distinct()


def critical_gaps(fields: DataFrame, guidance: DataFrame, key: str, *, n: int | None = None) -> DataFrame:
    """Missing fields (key, code, label, status) that guidance (code, priority, preferred, why) names, in order of
    priority, preference and label; the first ``n`` if asked for."""
    rows = fields.where("status <> 'available'").join(F.broadcast(guidance), "code")
    scope = F.when(F.col("status") == "interface_reserved", "interface_pending").otherwise("slope_data_missing")
    place = F.row_number().over(Window.partitionBy(key).orderBy("priority", "preferred", "label", "code"))
    out = rows.withColumn("gap_scope", scope).withColumn("place", place)
    return out.where(F.col("place") <= n) if n else out


def rule_references(objects: DataFrame, rules: DataFrame, key: str, topic: str, *, most: int = 8) -> DataFrame:
    """Distinct rules for each object's topics, at most ``most``, by id."""
    hits = objects.join(F.broadcast(rules), topic).select(key, "rule_id", "title").distinct()
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("rule_id"))).where(F.col("_n") <= most).drop("_n")


def summary(screened: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """Counts by code with zero for codes that none has; other values count too."""
    counts = screened.groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    return codes.join(counts, code, "full_outer").select(code, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def by_priority(df: DataFrame, column: str, *then: str) -> DataFrame:
    """Sorted P1 to P4, then others, then by label."""
    rank = F.coalesce(*[F.when(F.col(column) == p, i) for i, p in enumerate(PRIORITIES)], F.lit(9))
    return df.orderBy(rank, *then)
