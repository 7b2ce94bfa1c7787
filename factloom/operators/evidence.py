"""Evidence of objects and of fields: what counts as current, what a review may change, and what proves a value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import col, is_present, maximum_number

# Scopes of an analysis that speak of the whole object, marks that may join the parts of a list, kinds of
# observations, and scopes in time that are current.
WHOLE_SCOPES = ("整体边坡", "现状边坡")
JOINERS = (";", "；", "、", ",", "，")
OBSERVATIONS = ("DeformationObservation", "MonitoringObservation", "InspectionRecord")
CURRENT_SCOPES = ("current", "recent_inspection", "real_time_monitoring")


def eligible_whole(scope, body, mode, issues) -> Column:
    """Whether a record speaks of the whole object: a whole scope, no body or failure mode of its own, no issues."""
    return F.coalesce(col(scope).isin(*WHOLE_SCOPES), F.lit(False)) & ~is_present(body) & ~is_present(mode) & ~is_present(issues, "collection")


def _href(c) -> Column:
    out = F.replace(F.trim(F.coalesce(col(c).cast("string"), F.lit(""))), F.lit("\\"), F.lit("/"))
    return F.lower(F.regexp_replace(out, r"^(?:\./)+", ""))


def stale_renders(assets: DataFrame, active: DataFrame | None, *, href: str = "href", origin: str = "origin", derived: str = "pdf_derived", folder: str = "/assets/ocr_pages/") -> DataFrame:
    """Adds ``stale``: rendered pages that the active set (a column ``href``) doesn't name. Other assets never are, nor
    is any without an active set. Files stay; ``stale`` rows are for the caller to leave out and count."""
    path = _href(href)
    render = F.coalesce(F.col(origin) == derived, F.lit(False)) & F.contains(F.concat(F.lit("/"), path), F.lit(folder))
    if active is None:
        return assets.withColumn("stale", F.lit(False))
    names = active.where(is_present("href")).select(_href("href").alias("_active")).distinct().withColumn("_there", F.lit(True))
    out = assets.join(names, path == F.col("_active"), "left")
    return out.withColumn("stale", render & F.col("_there").isNull()).drop("_active", "_there")


def reviewed_overlay(rows: DataFrame, reviews: DataFrame, key: str, scope: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Reviewed values (reviews: key, scope columns, fields) put over rows, but only if the scope that was reviewed is
    still the row's; null equals null. A review's null changes nothing. Adds ``reviewed``."""
    r = reviews.select(F.col(key), *[F.col(c).alias(f"_s_{c}") for c in scope], *[F.col(f).alias(f"_f_{f}") for f in fields], F.lit(True).alias("_r"))
    same = F.coalesce(F.col("_r"), F.lit(False))
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    out = rows.join(r, key, "left").withColumn("reviewed", same)
    out = out.withColumns({f: F.when(F.col("reviewed"), F.coalesce(F.col(f"_f_{f}"), F.col(f))).otherwise(F.col(f)) for f in fields})
    return out.select(*rows.columns, "reviewed")


def pages_in_json(c) -> Column:
    """Page numbers of a JSON text, at any depth: whole numbers of ``page`` and in lists of ``pages``, in order."""
    c = col(c)
    one = F.regexp_extract_all(c, F.lit(r'(?<!\\)"page"\s*:\s*(-?\d+)\s*(?=[,}])'), F.lit(1))
    lists = F.regexp_extract_all(c, F.lit(r'(?<!\\)"pages"\s*:\s*\[([^\[\]{}]*)\]'), F.lit(1))
    parts = F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, ","), lambda p: F.trim(p))))
    whole = F.filter(parts, lambda p: F.regexp_like(p, F.lit(r"^-?\d+$")))
    return F.array_sort(F.array_distinct(F.transform(F.concat(one, whole), lambda p: p.cast("int"))))


def search_json(df: DataFrame, json: str, *, page: int | None = None, needle: str = "", failed: str | None = None) -> DataFrame:
    """Rows whose JSON names a page, holds a text (case aside) and, if asked for, whose ``failed`` column is true."""
    out = df
    if page is not None:
        out = out.where(F.array_contains(pages_in_json(json), page))
    if needle:
        out = out.where(F.contains(F.lower(json), F.lit(needle.lower())))
    return out.where(F.coalesce(F.col(failed), F.lit(False))) if failed else out


def parts_problem(value, parts, joiner, *, most: int = 64) -> Column:
    """Why parts of evidence don't make up a field's value, else null: parts are present texts, at most ``most``; several
    are joined by a mark of lists; joined they are the value, white space and full-width marks aside."""
    parts, joiner = col(parts), F.coalesce(col(joiner), F.lit(""))
    plain = lambda c: F.translate(F.regexp_replace(c, r"(?U)\s+", ""), "：，（）；", ":,();")
    bad = (F.size(parts) < 1) | (F.size(parts) > most) | F.exists(parts, lambda p: ~is_present(F.trim(F.coalesce(p, F.lit("")))))
    bad = bad | ((F.size(parts) > 1) & ~joiner.isin(*JOINERS))
    whole = plain(F.array_join(parts, "\u0001"))
    return F.when(F.coalesce(bad, F.lit(True)), "invalid_parts").when(F.replace(whole, F.lit("\u0001"), plain(joiner)) != plain(col(value)), "parts_do_not_make_the_value")


def collect(objects: DataFrame, facts: DataFrame, key: str, *, hazards: Sequence[str], alarms: Sequence[str]) -> DataFrame:
    """Evidence of each object, one row each, by conditional aggregation: no object's facts are sorted or listed whole.

    ``objects``: key, summary, hazard_type, deformation (texts), height, height_max, gradient, gradient_max (numbers as
    text), eligible_as_current (of its dated input). ``facts``: key, type, label, body_type, temporal_scope,
    current_status_known, candidate_hazards (array).

    current, historical: counts of observations; observed, historical_observed: alarm terms affirmed in observations that
    are current, or in the object's own text if it is, and in all others; hazards, body_types, height, gradient,
    protection, exposure, dynamic (whether any evidence is current).
    """
    seen = F.col("type").isin(*OBSERVATIONS)
    now = seen & (F.coalesce(F.col("current_status_known"), F.lit(False)) | F.coalesce(F.col("temporal_scope").isin(*CURRENT_SCOPES), F.lit(False)))
    alarm = lambda rows, t: F.max(F.when(rows, T.alarm_affirmed(F.coalesce("label", F.lit("")), t)))
    by = facts.groupBy(key).agg(
        F.count_if(now).alias("current"),
        F.count_if(seen & ~now).alias("historical"),
        F.count_if(F.col("type") == "ProtectionWork").alias("protection"),
        F.count_if(F.col("type") == "ExposureObject").alias("exposure"),
        F.array_sort(F.collect_set(F.when(F.col("type") == "HazardBody", F.coalesce("body_type", F.lit("unclear"))))).alias("body_types"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("type") == "HazardSusceptibilityAssessment", F.array_sort("candidate_hazards"))))).alias("_candidates"),
        *[alarm(now, t).alias(f"_now{i}") for i, t in enumerate(alarms)],
        *[alarm(seen & ~now, t).alias(f"_old{i}") for i, t in enumerate(alarms)],
    )
    out = objects.join(by, key, "left").na.fill(0, ["current", "historical", "protection", "exposure"])
    empty, own = F.array().cast("array<string>"), F.coalesce("deformation", F.lit(""))
    current_input = F.coalesce("eligible_as_current", F.lit(False))
    said = lambda prefix, mine: F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"{prefix}{i}"), F.lit(False)) | (mine & T.alarm_affirmed(own, t)), F.lit(t)) for i, t in enumerate(alarms)]))
    named = F.concat(T.terms_in(F.coalesce("summary", F.lit("")), list(hazards)), T.terms_in(F.coalesce("hazard_type", F.lit("")), list(hazards)), F.array_sort(F.coalesce("_candidates", empty)))
    return out.select(
        key, "current", "historical", "protection", "exposure", F.coalesce("body_types", empty).alias("body_types"), F.array_distinct(named).alias("hazards"), maximum_number("height", "height_max").alias("height"), maximum_number("gradient", "gradient_max").alias("gradient"),
        said("_now", current_input).alias("observed"), said("_old", ~current_input).alias("historical_observed"), ((F.col("current") > 0) | current_input).alias("dynamic"),
    )
