"""Completeness, coverage, gates and admission checks of record sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_present


def unpivot_fields(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, code and whether the field is present; zero and false are present."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("code"), is_present(f).alias("present")) for f in fields])).alias("p")
    return df.select(key, pairs).select(key, "p.code", "p.present")


def completeness(df: DataFrame, key: str, specs: DataFrame, fields: Sequence[str], relations: DataFrame | None = None) -> DataFrame:
    """Per object: available, total and missing codes against ``specs`` (code, required, reserved). A code may be met
    by a field or by a relation row (key, code). Reserved codes are named, not counted."""
    long = unpivot_fields(df, key, fields)
    if relations is not None:
        met = relations.select(key, "code").distinct().withColumn("related", F.lit(True))
        every = df.select(key).withColumn("_k", F.lit(0)).join(F.broadcast(specs.select("code").withColumn("_k", F.lit(0))), "_k").drop("_k")
        long = every.join(long, [key, "code"], "left").join(met, [key, "code"], "left").select(key, "code", (F.coalesce("present", F.lit(False)) | F.coalesce("related", F.lit(False))).alias("present"))
    rows = long.join(F.broadcast(specs), "code")
    counted = ~F.col("reserved")
    out = rows.groupBy(key).agg(
        F.count_if(counted & F.col("present")).alias("available"),
        F.count_if(counted).alias("total"),
        F.count_if(counted & F.col("required") & ~F.col("present")).alias("required_missing"),
        F.array_sort(F.collect_list(F.when(counted & ~F.col("present"), F.col("code")))).alias("missing"),
    )
    return out.withColumn("ratio", F.when(F.col("total") > 0, F.col("available") / F.col("total"))).withColumn("ready", F.col("required_missing") == 0)


def field_coverage(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, available, total, ratio: one pass over the table."""
    row = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(is_present(f)).alias(f"n_{i}") for i, f in enumerate(fields)])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n_{i}").alias("available")) for i, f in enumerate(fields)])).alias("p")
    return row.select(pairs, "total").select("p.field", "p.available", "total", F.when(F.col("total") > 0, F.col("p.available") / F.col("total")).alias("ratio"))


def relation_coverage(objects: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """relation, and how many of the objects have one at least."""
    total = objects.select(F.count_distinct(key).alias("total"))
    hit = edges.join(objects.select(F.col(key).alias("src")).distinct(), "src", "left_semi").groupBy("relation").agg(F.count_distinct("src").alias("available"))
    return hit.withColumn("_k", F.lit(0)).join(F.broadcast(total.withColumn("_k", F.lit(0))), "_k").select("relation", "available", "total", (F.col("available") / F.col("total")).alias("ratio"))


def gates(coverage: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Coverage against ``thresholds`` (field, least): field, ratio, least, passed. A field that was not measured, or
    has no rows, doesn't pass."""
    out = thresholds.join(coverage.select("field", "ratio"), "field", "left")
    return out.select("field", "ratio", "least", F.coalesce(F.col("ratio") >= F.col("least"), F.lit(False)).alias("passed"))


def exactly_once(expected: DataFrame, seen: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that were not covered exactly once: missing, repeated or unexpected, with counts."""
    e = expected.groupBy(*key).agg(F.count(F.lit(1)).alias("n_expected"))
    s = seen.groupBy(*key).agg(F.count(F.lit(1)).alias("n_seen"))
    out = e.join(s, list(key), "full_outer").na.fill(0, ["n_expected", "n_seen"])
    problem = F.when(F.col("n_seen") == 0, "missing").when(F.col("n_expected") == 0, "unexpected").when(F.col("n_seen") > 1, "repeated")
    return out.withColumn("problem", problem).where("problem is not null")


def partition_leaks(df: DataFrame, content: str, split: str) -> DataFrame:
    """Contents that are in more than one split: digest and splits."""
    digest = F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256).alias("digest")
    return df.select(digest, split).groupBy("digest").agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def foreign_key_gaps(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child keys without parent, with counts; null keys aren't references."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def issues(df: DataFrame, key: Sequence[str], checks: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Issue rows: key, issue, severity. ``checks``: issue to (severity, condition that is true where it holds)."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("issue"), F.lit(s).alias("severity"))) for k, (s, c) in checks.items()]))
    return df.select(*key, F.explode(found).alias("i")).select(*key, "i.issue", "i.severity")


def asset_issues(assets: DataFrame, documents: DataFrame, *, types: Sequence[str] = ("image", "table", "page", "document")) -> DataFrame:
    """Problems of assets (id, type, sha256, page, document_id, path) against documents (id, pages)."""
    d = documents.select(F.col("id").alias("document_id"), "pages", F.lit(True).alias("_there"))
    rows = assets.join(d, "document_id", "left")
    return issues(
        rows,
        ["id"],
        {
            "path_missing": ("error", ~is_present("path")),
            "type_unknown": ("error", ~F.coalesce(F.col("type").isin(list(types)), F.lit(False))),
            "hash_malformed": ("error", ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))),
            "document_unknown": ("error", F.col("document_id").isNotNull() & F.col("_there").isNull()),
            "page_out_of_range": ("error", (F.col("page") < 1) | (F.col("page") > F.col("pages"))),
            "document_unlinked": ("warning", F.col("document_id").isNull()),
        },
    )


def case_violations(cases: DataFrame) -> DataFrame:
    """Violations of a case set (case_id, parent_case_id, source_group_id, split): check, item."""
    twice = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_case").alias("check"), F.col("case_id").alias("item"))
    parents = cases.where("parent_case_id is not null").join(cases.select(F.col("case_id").alias("parent_case_id")).distinct(), "parent_case_id", "left_anti").select(F.lit("unknown_parent").alias("check"), F.col("parent_case_id").alias("item"))
    crossing = cases.groupBy("source_group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit("group_crosses_splits").alias("check"), F.col("source_group_id").alias("item"))
    return twice.unionByName(parents).unionByName(crossing).distinct()


def status_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def inventory(files: DataFrame, documents: DataFrame, pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Files with their document and counts of its pages by type and of its tasks by status (as maps)."""

    def counts(df, by, name):
        n = df.groupBy("document_id", by).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "n")))).alias(name))

    out = files.join(documents.select(F.col("id").alias("document_id"), "file_name"), "file_name", "left")
    return out.join(counts(pages, "page_type", "page_types"), "document_id", "left").join(counts(tasks, "status", "task_statuses"), "document_id", "left")


def source_accounting(units: DataFrame, attributed: DataFrame, cited: DataFrame) -> DataFrame:
    """Per page: source units, and how many of them are attributed, cited and unassigned."""
    rows = units.join(attributed.select("unit_id").distinct().withColumn("a", F.lit(1)), "unit_id", "left").join(cited.select("unit_id").distinct().withColumn("c", F.lit(1)), "unit_id", "left")
    return rows.groupBy("page").agg(F.count(F.lit(1)).alias("units"), F.count("a").alias("attributed"), F.count("c").alias("cited"), F.count_if(F.col("a").isNull() & F.col("c").isNull()).alias("unassigned"))


def numeric_residuals(texts: DataFrame, facts: DataFrame, key: str, text: str, value: str) -> DataFrame:
    """Numbers of a source that none of its facts uses."""
    from ..functions.values import numbers_in_text

    found = texts.select(key, F.explode(numbers_in_text(text)).alias("number")).distinct()
    used = facts.select(key, F.col(value).cast("double").alias("number")).distinct()
    return found.join(used, [key, "number"], "left_anti")
