"""Evaluation against gold labels and facts."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, actual: str, predicted: str, labels: Sequence) -> DataFrame:
    """Counts over the whole grid of ``labels``, zero where none occurs."""
    kind = dict(pairs.dtypes)[actual]
    grid = pairs.sparkSession.createDataFrame([*itertools.product(labels, labels)], f"actual {kind}, predicted {kind}")
    n = pairs.groupBy(F.col(actual).alias("actual"), F.col(predicted).cast(kind).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def match_labels(labels: DataFrame, predictions: DataFrame, key: str, label: str, valid: Sequence[str]) -> DataFrame:
    """Labels with their prediction and, where they cannot be used, the reason: repeated key (all its rows), unknown
    key or invalid label."""
    counted = labels.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    p = predictions.withColumn("_there", F.lit(True))
    out = labels.join(counted, key).join(p, key, "left")
    reason = F.when(F.col("_n") > 1, "duplicate_label").when(F.col("_there").isNull(), "unknown_id").when(~F.coalesce(F.col(label).isin(list(valid)), F.lit(False)), "invalid_label")
    return out.withColumn("rejected", reason).drop("_n", "_there")


def screening_metrics(pairs: DataFrame, actual: str, predicted: str, *, order: Sequence[str] = ("P1", "P2", "P3", "P4"), urgent: int = 2) -> DataFrame:
    """n, accuracy, within_one, urgent precision and recall, critical misses (most urgent taken for not urgent); nulls
    where there is nothing to divide by."""
    rank = lambda c: F.coalesce(*[F.when(F.col(c) == x, i) for i, x in enumerate(order)])
    a, p = rank(actual), rank(predicted)
    ratio = lambda n, d: F.when(d > 0, n / d)
    n, ua, up, both = F.count(F.lit(1)), F.count_if(a < urgent), F.count_if(p < urgent), F.count_if((a < urgent) & (p < urgent))
    return pairs.agg(
        n.alias("n"), ratio(F.count_if(a == p), n).alias("accuracy"), ratio(F.count_if(F.abs(a - p) <= 1), n).alias("within_one"), ratio(both, up).alias("urgent_precision"), ratio(both, ua).alias("urgent_recall"), F.count_if((a == 0) & (p >= urgent)).alias("critical_misses")
    )


def multiset_scores(gold: DataFrame, found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Micro precision and recall of rows as multisets."""
    g = gold.groupBy(*columns).agg(F.count(F.lit(1)).alias("g"))
    f = found.groupBy(*columns).agg(F.count(F.lit(1)).alias("f"))
    both = g.join(f, list(columns), "full_outer").na.fill(0, ["g", "f"])
    out = both.agg(F.sum(F.least("g", "f")).alias("matched"), F.sum("g").alias("gold"), F.sum("f").alias("found"))
    return out.withColumn("precision", F.when(F.col("found") > 0, F.col("matched") / F.col("found"))).withColumn("recall", F.when(F.col("gold") > 0, F.col("matched") / F.col("gold")))


def phrase_recall(pages: DataFrame, phrases: DataFrame, key: str, text: str, phrase: str, group: str) -> DataFrame:
    """Share of gold phrases that their page's text holds, white space aside; by group and overall (group null)."""
    strip = lambda c: F.regexp_replace(F.lower(F.col(c)), r"(?U)\s+", "")
    rows = phrases.join(pages.select(key, strip(text).alias("_t")), key, "left").withColumn("hit", F.coalesce(F.contains("_t", strip(phrase)), F.lit(False)))
    return rows.rollup(group).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("found"), (F.count_if("hit") / F.count(F.lit(1))).alias("recall"))


def gold_facts(gold: DataFrame, nodes: DataFrame, owners: DataFrame, edges: DataFrame, *, tolerance: float = 1e-6) -> DataFrame:
    """Status of each gold fact (id, owner_key, relation, node_type, field, expected as text, expect_absent,
    collection_member) against a graph: pass, wrong, missing, conflict, violation, missing_owner, ambiguous_owner.

    ``owners``: owner_key, owner_id. ``nodes``: id, type, field, value (text), one row per field. A value is tested on
    the node that has it; it is never put together from several.
    """
    n_owner = owners.groupBy("owner_key").agg(F.count_distinct("owner_id").alias("n_owners"), F.min("owner_id").alias("owner_id"))
    g = gold.join(n_owner, "owner_key", "left").withColumn("n_owners", F.coalesce("n_owners", F.lit(0)))
    own = g.select("id", "field", "expected", "node_type", F.col("owner_id").alias("src"), "relation").where("n_owners = 1")
    reach = own.join(edges.select("src", "dst", "relation").distinct(), ["src", "relation"]).join(nodes.select(F.col("id").alias("dst"), F.col("type").alias("node_type"), "field", "value"), ["dst", "node_type", "field"])
    number = lambda c: F.col(c).try_cast("double")
    fits = F.coalesce(F.abs(number("value") - number("expected")) <= tolerance, F.regexp_replace("value", r"(?U)\s+", "") == F.regexp_replace("expected", r"(?U)\s+", ""))
    seen = reach.groupBy("id").agg(F.count_distinct("dst").alias("n_nodes"), F.count_distinct(F.when(fits, F.col("dst"))).alias("n_fit"), F.count_if(F.col("value") != "").alias("n_value"))
    out = g.join(seen, "id", "left").na.fill(0, ["n_nodes", "n_fit", "n_value"])
    status = (
        F.when(F.col("n_owners") == 0, "missing_owner")
        .when(F.col("n_owners") > 1, "ambiguous_owner")
        .when(F.col("expect_absent"), F.when(F.col("n_fit") > 0, "violation").otherwise("pass"))
        .when(F.col("n_fit") > 0, F.when((F.col("n_fit") != F.col("n_nodes")) & ~F.col("collection_member"), "conflict").otherwise("pass"))
        .when(F.col("n_value") > 0, "wrong")
        .otherwise("missing")
    )
    return out.select("id", status.alias("status"), "n_nodes", "n_fit")


def label_gate(reviews: DataFrame, key: str, *, roles: Sequence[str] = ("expert",), least: int = 2) -> DataFrame:
    """Whether a case's label may be used: at least ``least`` independent reviewers of a valid role, for the current
    input and one scheme version, with evidence and a valid date, who agree. ``reasons`` say what blocks.

    ``reviews``: key, label, reviewer_id, reviewer_role, input_sha256, current_sha256, scheme_version, reviewed_at
    (text), evidence_ids array.
    """
    ok = F.col("reviewer_role").isin(list(roles)) & (F.col("input_sha256") == F.col("current_sha256")) & F.try_to_date("reviewed_at", "yyyy-MM-dd").isNotNull() & (F.size("evidence_ids") > 0)
    ok = F.coalesce(ok, F.lit(False))
    agg = reviews.groupBy(key).agg(
        F.count_distinct(F.when(ok, F.col("reviewer_id"))).alias("reviewers"), F.count_distinct(F.when(ok, F.col("label"))).alias("labels"), F.count_distinct(F.when(ok, F.col("scheme_version"))).alias("versions"), F.count_if(~ok).alias("unusable"), F.min(F.when(ok, F.col("label"))).alias("label")
    )
    reasons = F.array_compact(F.array(F.when(F.col("reviewers") < least, F.lit("too_few_independent_reviews")), F.when(F.col("labels") > 1, F.lit("reviewers_disagree")), F.when(F.col("versions") > 1, F.lit("scheme_versions_differ"))))
    return agg.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0).withColumn("label", F.when(F.size("reasons") == 0, F.col("label")))


def regression_points(points: DataFrame, facts: DataFrame) -> DataFrame:
    """Points (point_id, page, field, expected) against facts (page, field, value, evidence): a point passes if all its
    checks hold on its pages with evidence."""
    rows = points.join(facts, ["page", "field"], "left")
    hit = F.coalesce((F.col("value") == F.col("expected")) & (F.col("evidence") != ""), F.lit(False))
    by = rows.groupBy("point_id", "page", "field", "expected").agg(F.max(hit).alias("hit"))
    return by.groupBy("point_id").agg(F.bool_and("hit").alias("passed"), F.count(F.lit(1)).alias("checks"))


def scenarios(cases: DataFrame, group: str, order: Sequence[str], edits: DataFrame, *, k: int) -> DataFrame:
    """The first ``k`` cases of each group, each with every edit (edit_id, …; a small dimension)."""
    from .ordered import first_by

    top = first_by(cases, [group], [F.col(c) for c in order], k).withColumn("_k", F.lit(0))
    return top.join(F.broadcast(edits.withColumn("_k", F.lit(0))), "_k").drop("_k")
