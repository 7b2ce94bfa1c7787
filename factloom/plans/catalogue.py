"""The registered queries over the driver's tables and their SQL equivalents.

Each query applies operators of the package to whole tables. Numbers that come from sums of doubles are rounded, as
their last bits depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quantities as Q
from ..functions import text as T
from ..functions import values as V
from ..operators import assessment, conditions, coverage, documents, evaluation, graph, identity, joins, layout, ordered, screening, series
from ..streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir):
    return t(spark, sf_dir, "events")


# --- series ---------------------------------------------------------------------------------------------------------


@query("""
WITH b AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS z FROM events),
s AS (SELECT DISTINCT event_type FROM events),
d AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM b),
v AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, arg_max(value, {'t': ts, 'i': event_id}) AS value FROM events GROUP BY ALL)
SELECT s.event_type, d.day, coalesce(v.n, 0) AS n, v.value, CASE WHEN v.n IS NULL THEN 'no_record' ELSE 'recorded' END AS status
FROM s CROSS JOIN d LEFT JOIN v ON v.event_type = s.event_type AND v.day = d.day""")
def series_daily_replay(spark, sf_dir):
    return series.daily_replay(_events(spark, sf_dir), "event_type", "ts", "event_id", "value")


@query("""
WITH e AS (SELECT *, lag(value) OVER w AS p, lag(ts) OVER w AS pt FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
c AS (SELECT *, CASE WHEN ts <> pt THEN abs(value - p) END AS ch FROM e)
SELECT event_type, min(value) AS min, max(value) AS max, count(*) FILTER (value = 0) AS zero_count, count(value) AS valid_count, max(ch) AS largest_change,
arg_max(pt, {'c': ch, 't': ts}) FILTER (ch IS NOT NULL) AS from_time, arg_max(ts, {'c': ch, 't': ts}) FILTER (ch IS NOT NULL) AS to_time,
arg_max(p, {'c': ch, 't': ts}) FILTER (ch IS NOT NULL) AS from_value, arg_max(value, {'c': ch, 't': ts}) FILTER (ch IS NOT NULL) AS to_value
FROM c GROUP BY event_type""")
def series_component_stats(spark, sf_dir):
    return series.value_stats(_events(spark, sf_dir), "event_type", "ts", "event_id", "value")


@query("""
WITH d AS (SELECT DISTINCT event_type, ts FROM events),
g AS (SELECT event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts)) / 1e6 AS gap FROM d)
SELECT event_type, count(*) AS n_times, median(gap) AS median_seconds, max(gap) AS max_seconds FROM g GROUP BY event_type""")
def series_gap_stats(spark, sf_dir):
    return series.gap_stats(_events(spark, sf_dir), "event_type", "ts")


@query("""
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
r AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM d)
SELECT user_id, min(day) AS start_day, max(day) AS end_day, count(*) AS days FROM r GROUP BY user_id, run""")
def series_islands(spark, sf_dir):
    return series.islands(_events(spark, sf_dir).withColumn("day", F.to_date("ts")), ["user_id"])


@query("""
WITH d AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events)
SELECT day FROM d GROUP BY day HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events)""")
def common_days(spark, sf_dir):
    return series.common_days(_events(spark, sf_dir).withColumn("day", F.to_date("ts")), "event_type")


@query("""
WITH c AS (SELECT event_type, ts, count(*) AS n, count(*) FILTER (value IS NULL OR isnan(value) OR isinf(value)) AS bad FROM events GROUP BY ALL)
SELECT event_type, CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(CASE WHEN ts IS NOT NULL AND n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicate_time_rows,
CAST(sum(CASE WHEN ts IS NULL THEN n ELSE 0 END) AS BIGINT) AS invalid_time_rows, CAST(sum(bad) AS BIGINT) AS invalid_value_rows FROM c GROUP BY event_type""")
def series_quality_counts(spark, sf_dir):
    return series.quality_counts(_events(spark, sf_dir), "event_type", "ts", "value")


@query("""
WITH e AS (SELECT *, CAST(ts AS DATE) AS day, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS k FROM events),
r AS (SELECT user_id, CASE WHEN day IS NULL THEN 'invalid_recorded_time' WHEN k > 1 THEN 'ambiguous_source_date' WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 'component_unavailable' END AS reason FROM e)
SELECT user_id, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY ALL""")
def ambiguous_days_rejected(spark, sf_dir):
    rows = series.single_valued_days(_events(spark, sf_dir), "user_id", "ts", "value")
    return rows.groupBy("user_id", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _daily(spark, sf_dir):
    """One value per user and day: the day's exact sum, declared as such, since raw days are ambiguous."""
    return _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("value"))


_DAILY = """d AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS value FROM events GROUP BY ALL),
b AS (SELECT user_id, min(day) AS a, max(day) AS z FROM d GROUP BY user_id),
s AS (SELECT user_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day, a, z, date_diff('day', a, z) + 1 AS span FROM b),
x AS (SELECT s.*, a + CAST(span * 3 // 5 AS INTEGER) - 1 AS te, a + CAST(span * 4 // 5 AS INTEGER) - 1 AS ve, d.value AS actual FROM s LEFT JOIN d USING (user_id, day)),
y AS (SELECT *, CASE WHEN day <= te THEN 'train' WHEN day <= ve THEN 'validation' ELSE 'test' END AS split, (date_diff('day', a, te) + 1 >= 7) AND ve > te AND z > ve AS usable,
 lag(actual) OVER w AS origin, lag(actual, 7) OVER w AS oldest, count(actual) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS history FROM x WINDOW w AS (PARTITION BY user_id ORDER BY day)),
p AS (SELECT user_id, day, split, actual, CASE WHEN actual IS NULL THEN 'target_missing_or_invalid' WHEN origin IS NULL THEN 'previous_date_missing_or_invalid' WHEN history < 7 THEN 'seven_day_history_missing_or_invalid' END AS excluded, origin, oldest FROM y WHERE usable AND split <> 'train')"""


@query(f"""
WITH {_DAILY}
SELECT user_id, day, split, round(actual, 6) AS actual, excluded, round(CASE WHEN excluded IS NULL THEN origin END, 6) AS persistence,
round(CASE WHEN excluded IS NULL THEN origin + (origin - oldest) / 6 END, 6) AS recent_drift FROM p""")
def daily_backtest(spark, sf_dir):
    out = series.backtest(_daily(spark, sf_dir), "user_id")
    return out.withColumns({c: F.round(c, 6) for c in ("actual", "persistence", "recent_drift")})


_SCALE = """g AS (SELECT d.*, te, lag(d.day) OVER (PARTITION BY d.user_id ORDER BY d.day) AS pd, lag(d.value) OVER (PARTITION BY d.user_id ORDER BY d.day) AS pv FROM d JOIN (SELECT DISTINCT user_id, te FROM x) USING (user_id)),
sc AS (SELECT user_id, avg(abs(value - pv)) FILTER (day <= te AND day - pd = 1) AS scale, count(*) FILTER (day <= te AND day - pd = 1) AS pairs FROM g GROUP BY user_id)"""


@query(f"WITH {_DAILY}, {_SCALE} SELECT user_id, round(scale, 6) AS scale, pairs FROM sc")
def training_scale(spark, sf_dir):
    return series.training_scale(_daily(spark, sf_dir), "user_id").withColumn("scale", F.round("scale", 6))


@query(f"""
WITH {_DAILY}, {_SCALE},
f AS (SELECT *, CASE WHEN excluded IS NULL THEN origin END AS ps, CASE WHEN excluded IS NULL THEN origin + (origin - oldest) / 6 END AS dr FROM p),
m AS (SELECT user_id, split, count(ps) AS count, avg(abs(ps - actual)) AS a1, sqrt(avg((ps - actual) * (ps - actual))) AS r1, avg(ps - actual) AS b1, avg(abs(dr - actual)) AS a2, sqrt(avg((dr - actual) * (dr - actual))) AS r2, avg(dr - actual) AS b2 FROM f GROUP BY ALL)
SELECT user_id, split, count, round(a1, 4) AS persistence_mae, round(r1, 4) AS persistence_rmse, round(b1, 4) AS persistence_bias, round(a2, 4) AS recent_drift_mae, round(r2, 4) AS recent_drift_rmse, round(b2, 4) AS recent_drift_bias,
round(CASE WHEN scale > 0 THEN a1 / scale END, 4) AS persistence_mase, round(CASE WHEN scale > 0 THEN a2 / scale END, 4) AS recent_drift_mase, round(CASE WHEN a1 <> 0 THEN 1 - a2 / a1 END, 4) AS improvement
FROM m LEFT JOIN sc USING (user_id)""")
def daily_backtest_metrics(spark, sf_dir):
    days = _daily(spark, sf_dir)
    out = series.backtest_metrics(series.backtest(days, "user_id"), series.training_scale(days, "user_id"), "user_id")
    return out.withColumns({c: F.round(c, 4) for c, k in out.dtypes if k == "double"})


@query(f"WITH {_DAILY} SELECT user_id, split, excluded, count(*) AS n FROM p WHERE excluded IS NOT NULL GROUP BY ALL")
def exclusion_counts(spark, sf_dir):
    return series.exclusion_counts(series.backtest(_daily(spark, sf_dir), "user_id"), "user_id")


@query("SELECT round(min(p_retailprice), 4) AS min, round(max(p_retailprice), 4) AS max, round(median(p_retailprice), 4) AS median, round(avg(p_retailprice), 4) AS mean, round(stddev_samp(p_retailprice), 4) AS stdev FROM part")
def published_statistics(spark, sf_dir):
    out = series.reconcile(t(spark, sf_dir, "part"), "p_retailprice")
    return out.withColumns({c: F.round(c, 4) for c in out.columns})


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    out = stream.windowed(_events(spark, sf_dir))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    out = stream.sessions(_events(spark, sf_dir))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""
SELECT event_type, count(*) AS n, max(event_id) AS last_id, arg_max(value, event_id) AS last_value FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 50 GROUP BY event_type""")
def json_props_filter(spark, sf_dir):
    rows = _events(spark, sf_dir).where(F.get_json_object("props", "$.k").try_cast("int") >= 50)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"), F.max_by("value", "event_id").alias("last_value"))


# --- filters, paging, rules -------------------------------------------------------------------------------------------


@query("""
SELECT event_id, ts, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND contains(lower(event_type || ' ' || props), 'c')
ORDER BY ts, event_id LIMIT 100 OFFSET 50""")
def paged_filtered_search(spark, sf_dir):
    rows = conditions.search(_events(spark, sf_dir), words="C", over=["event_type", "props"], date="ts", start=F.expr("timestamp_ntz'2024-01-05 00:00:00'"), end=F.expr("timestamp_ntz'2024-01-20 00:00:00'"))
    return conditions.page(rows, ["ts", "event_id"], limit=100, offset=50).select("event_id", "ts", "event_type", "value")


RULES = (
    {"id": "rich_builder", "match": "all", "conditions": [{"field": "c_acctbal", "operator": "gte", "value": "5000"}, {"field": "c_mktsegment", "operator": "eq", "value": "BUILDING"}], "output": "P1"},
    {"id": "debt_or_household", "match": "any", "conditions": [{"field": "c_acctbal", "operator": "lt", "value": 0}, {"field": "c_mktsegment", "operator": "in", "value": ["HOUSEHOLD", "MACHINERY"]}], "output": "P2"},
    {"id": "named", "match": "all", "conditions": [{"field": "c_name", "operator": "contains", "value": "7"}, {"field": "c_nationkey", "operator": "neq", "value": 3}], "output": "P3"},
    {"id": "not_approved", "approval_status": "draft", "conditions": [{"field": "c_name", "operator": "exists"}], "output": "P1"},
)


@query("""
WITH r AS (SELECT c_custkey, c_acctbal >= 5000 AND c_mktsegment = 'BUILDING' AS a, c_acctbal < 0 OR c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') AS b, contains(c_name, '7') AND c_nationkey <> 3 AS c FROM customer)
SELECT c_custkey, concat_ws('|', CASE WHEN a THEN 'rich_builder' END, CASE WHEN b THEN 'debt_or_household' END, CASE WHEN c THEN 'named' END) AS matched, CASE WHEN a THEN 'P1' WHEN b THEN 'P2' WHEN c THEN 'P3' END AS rule_output FROM r""")
def rule_conditions_all_any(spark, sf_dir):
    out = conditions.evaluate_rules(t(spark, sf_dir, "customer"), RULES)
    return out.select("c_custkey", F.array_join("matched_rules", "|").alias("matched"), "rule_output")


@query("""
SELECT 'p_brand' AS field, p_brand AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY ALL UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY ALL""")
def facet_counts(spark, sf_dir):
    return conditions.facets(t(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


@query("""
SELECT c_custkey, field, problem FROM (
 SELECT c_custkey, 'c_acctbal' AS field, CASE WHEN c_acctbal < 0 THEN 'below_minimum' WHEN c_acctbal > 9000 THEN 'above_maximum' END AS problem FROM customer
 UNION ALL SELECT c_custkey, 'c_mktsegment', CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'not_an_option' END FROM customer
 UNION ALL SELECT c_custkey, 'c_name', 'unknown_field' FROM customer WHERE c_name <> '') WHERE problem IS NOT NULL""")
def field_validation(spark, sf_dir):
    specs = spark.createDataFrame([("c_acctbal", "number", 0.0, 9000.0, [], None), ("c_mktsegment", "text", None, None, ["BUILDING", "MACHINERY", "HOUSEHOLD"], 40)], "field string, type string, minimum double, maximum double, options array<string>, max_length int")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in ("c_acctbal", "c_mktsegment", "c_name")])).alias("p")
    rows = t(spark, sf_dir, "customer").select("c_custkey", pairs).select("c_custkey", "p.field", "p.value")
    return conditions.validate_values(rows, specs).where("problem is not null").select("c_custkey", "field", "problem")


# --- ordered, merge, conflicts ------------------------------------------------------------------------------------------


@query("""
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_shipdate, l_discount, l_tax) = 1""")
def dedupe_max_confidence(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem")
    rank = [-F.col("l_quantity"), -F.col("l_extendedprice"), *map(F.col, ("l_orderkey", "l_linenumber", "l_shipdate", "l_discount", "l_tax"))]
    return ordered.best_row(rows, ["l_partkey", "l_suppkey"], rank).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("""
WITH u AS (SELECT c_nationkey AS nation, 1 AS prio, c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_name END AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment END AS segment, c_acctbal AS bal FROM customer
 UNION ALL SELECT s_nationkey, 0, s_suppkey, CASE WHEN s_acctbal > 5000 THEN s_name END, NULL, s_acctbal FROM supplier)
SELECT nation, first(name ORDER BY prio, k) FILTER (name <> '') AS name, first(segment ORDER BY prio, k) FILTER (segment <> '') AS segment, max(bal) AS bal, string_agg(DISTINCT CASE prio WHEN 0 THEN 'supplier' ELSE 'customer' END, '|' ORDER BY CASE prio WHEN 0 THEN 'supplier' ELSE 'customer' END DESC) AS sources FROM u GROUP BY nation""")
def merge_priority_first_present(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.lit(1).alias("prio"), F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment")).alias("segment"), F.col("c_acctbal").alias("bal"))
    s = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit(0).alias("prio"), F.col("s_suppkey").alias("k"), F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("name"), F.lit(None).cast("string").alias("segment"), F.col("s_acctbal").alias("bal"))
    rows = c.unionByName(s).withColumn("src", F.when(F.col("prio") == 0, "supplier").otherwise("customer"))
    merged = ordered.merge_by_priority(rows, ["nation"], ["prio", "k"], fields=["name", "segment"], greatest=["bal"])
    sources = rows.groupBy("nation").agg(F.array_join(F.sort_array(F.collect_set("src"), asc=False), "|").alias("sources"))
    return merged.join(sources, "nation")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, unnest(['l_returnflag', 'l_linestatus', 'l_partkey']) AS field, unnest([l_returnflag, l_linestatus, CAST(l_partkey AS VARCHAR)]) AS value, CAST(l_suppkey AS VARCHAR) AS src FROM lineitem),
v AS (SELECT l_orderkey, l_linenumber, field, value, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM p GROUP BY ALL)
SELECT l_orderkey, l_linenumber, field, string_agg(value || ':' || sources, ';' ORDER BY value) AS alternatives FROM v GROUP BY ALL HAVING count(*) > 1""")
def source_disagreements(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").withColumn("src", F.col("l_suppkey").cast("string"))
    out = ordered.disagreements(rows, ["l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus", "l_partkey"], "src")
    shown = F.array_join(F.transform("alternatives", lambda a: F.concat(a["value"], F.lit(":"), F.array_join(a["sources"], ","))), ";")
    return out.withColumn("alternatives", shown)


@query("""
SELECT l_orderkey, l_linenumber, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS statuses, count(DISTINCT l_discount) AS n_values, count(*) AS n_rows FROM lineitem GROUP BY ALL
HAVING count(DISTINCT l_linestatus) > 1 OR (count(DISTINCT l_discount) > 1 AND max(l_discount) - min(l_discount) > 0.025)""")
def conflict_groups(spark, sf_dir):
    out = ordered.conflict_groups(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], value="l_discount", status="l_linestatus", spread=0.025)
    return out.select("l_orderkey", "l_linenumber", F.array_join("statuses", ",").alias("statuses"), F.size("values").cast("long").alias("n_values"), "n_rows")


@query("""
WITH m AS (SELECT *, min(l_partkey) OVER w <> max(l_partkey) OVER w OR min(l_suppkey) OVER w <> max(l_suppkey) OVER w AS several FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber))
SELECT CASE WHEN several THEN 'pending' ELSE l_linestatus END AS status, count(*) AS n, count(DISTINCT CASE WHEN several THEN l_orderkey || '/' || l_linenumber END) AS conflicts FROM m GROUP BY 1""")
def conflicts_pending(spark, sf_dir):
    out = ordered.mark_conflicts(t(spark, sf_dir, "lineitem").withColumn("status", F.col("l_linestatus")), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conflict_id").alias("conflicts"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'OVERRIDDEN' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 2 = 0 THEN 'manual ' || c_name ELSE c_name END AS c_name,
concat_ws(',', CASE WHEN c_custkey % 7 = 0 THEN 'c_mktsegment' END, CASE WHEN c_custkey % 14 = 0 THEN 'c_name' END) AS overridden FROM customer""")
def overlay_manual(spark, sf_dir):
    base = t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    manual = base.where("c_custkey % 7 = 0").select("c_custkey", F.lit("OVERRIDDEN").alias("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("manual "), "c_name")).otherwise("").alias("c_name"))
    out = ordered.overlay(base, manual, "c_custkey", ["c_mktsegment", "c_name"])
    return out.withColumn("overridden", F.array_join("overridden", ","))


@query("SELECT user_id, arg_max(event_id, {'t': ts, 'i': event_id}) AS event_id, arg_max(event_type, {'t': ts, 'i': event_id}) AS event_type FROM events GROUP BY user_id")
def latest_version_per_key(spark, sf_dir):
    return ordered.latest(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""
SELECT source, doc_id, score FROM (SELECT source, doc_id, len(string_split(lower(text), 'the')) - 1 AS score FROM documents)
QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 3""")
def topk_per_group(spark, sf_dir):
    scored = t(spark, sf_dir, "documents").select("source", "doc_id", (F.size(F.split(F.lower("text"), "the", -1)) - 1).cast("long").alias("score"))
    return ordered.first_by(scored, ["source"], [F.col("score").desc(), F.col("doc_id")], 3)


@query("""
SELECT o_orderkey, o_custkey, coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) <= 500000, false) AS selected FROM orders""")
def budget_selection(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    return ordered.within_budget(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "amount", 500_000).select("o_orderkey", "o_custkey", "selected")


@query("""
WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role ELSE '' END AS r FROM conversations)
SELECT conv_id, turn, last_value(CASE WHEN r <> '' THEN r END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS r FROM x""")
def carry_down_cells(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("role")).otherwise("").alias("r"))
    return ordered.carry_down(rows, ["conv_id"], ["turn"], ["r"])


# --- joins --------------------------------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, o_custkey, count(l_orderkey) AS n_lines, coalesce(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 0) AS quantity, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_returnflag = 'A') AS accepted, count(*) FILTER (l_returnflag = 'N') AS new_lines
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def inventory_with_counts(spark, sf_dir):
    # Counts meet before the join, so each order joins one row.
    n = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), *[F.count_if(F.col("l_returnflag") == f).alias(a) for f, a in (("R", "returned"), ("A", "accepted"), ("N", "new_lines"))])
    return t(spark, sf_dir, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_custkey", "n_lines", "quantity", "returned", "accepted", "new_lines").na.fill(0)


@query("""
WITH b AS (SELECT s_suppkey, s_nationkey, s_acctbal * 40 AS lo, s_acctbal * 40 + 3000 AS hi FROM supplier)
SELECT s_suppkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM b JOIN orders ON o_totalprice BETWEEN lo AND hi GROUP BY s_suppkey""")
def range_containment_join(spark, sf_dir):
    bands = t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") * 40).alias("lo"), (F.col("s_acctbal") * 40 + 3000).alias("hi"))
    hits = joins.containment_join(t(spark, sf_dir, "orders"), bands, "o_totalprice", "lo", "hi", width=3000)
    return hits.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""
WITH b AS (SELECT s_suppkey, s_nationkey, s_acctbal AS lo, s_acctbal + 500 AS hi FROM supplier),
h AS (SELECT c_custkey, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS o FROM customer JOIN b ON s_nationkey = c_nationkey AND c_acctbal BETWEEN lo AND hi GROUP BY ALL)
SELECT c_custkey, CASE WHEN n = 1 THEN o END AS owner, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'single' ELSE 'multiple' END AS status FROM customer LEFT JOIN h USING (c_custkey)""")
def range_attribution_unique(spark, sf_dir):
    bands = t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 500).alias("hi"))
    points = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    return joins.attribute_unique(points, bands, ["c_custkey"], "c_acctbal", "lo", "hi", "s_suppkey", on=["nation"], width=500).select("c_custkey", "owner", "status")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS a, date_diff('day', DATE '1990-01-01', CAST(max(l_shipdate) AS DATE)) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate),
p AS (SELECT x.o_custkey, CASE WHEN x.a = y.a AND x.b = y.b THEN 'same' ELSE 'partial' END AS relation FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND greatest(x.a, y.a) <= least(x.b, y.b))
SELECT o_custkey, relation, count(*) AS n FROM p GROUP BY ALL""")
def interval_overlap_join(spark, sf_dir):
    days = lambda c: F.datediff(F.to_date(c), F.lit("1990-01-01").cast("date")).cast("long")
    last = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("s"))
    spans = t(spark, sf_dir, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", days("o_orderdate").alias("a"), days("s").alias("b")).where("a <= b")
    other = spans.select("o_custkey", F.col("o_orderkey").alias("k2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    hits = joins.overlap_join(spans, other, ("a", "b"), ("a2", "b2"), on=["o_custkey"], width=60).where("o_orderkey < k2")
    return hits.groupBy("o_custkey", "relation").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
d AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS k FROM orders GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l.o_custkey, l_shipdate, d.o_orderdate AS asof_o_orderdate, d.k AS asof_o_orderkey FROM l ASOF LEFT JOIN d ON l.o_custkey = d.o_custkey AND l.l_shipdate >= d.o_orderdate""")
def asof_preceding(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    left = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    return joins.asof_join(left, orders, ["o_custkey"], "l_shipdate", "o_orderdate", ["o_orderkey"], tie=["o_orderkey"])


@query("""
SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_partkey < y.p_partkey AND x.p_size = y.p_size AND abs(x.p_retailprice - y.p_retailprice) <= 0.5""")
def near_duplicate_numeric(spark, sf_dir):
    return joins.near_duplicates_numeric(t(spark, sf_dir, "part"), "p_partkey", {"p_size": 0, "p_retailprice": 0.5})


@query("""
WITH a AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS m FROM orders WHERE year(o_orderdate) = 1995 GROUP BY ALL), b AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS m FROM orders WHERE year(o_orderdate) = 1996 GROUP BY ALL)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.n AS a_n, a.m AS a_m, b.n AS b_n, b.m AS b_m, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' WHEN a.n IS NOT DISTINCT FROM b.n AND a.m IS NOT DISTINCT FROM b.m THEN 'same' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def full_outer_compare(spark, sf_dir):
    year = lambda y: t(spark, sf_dir, "orders").where(F.year("o_orderdate") == y).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("m"))
    return joins.compare_runs(year(1995), year(1996), ["o_custkey"], ["n", "m"])


@query("""
SELECT 'orders_without_lines' AS "check", count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'customers_with_orders', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'customers_without_orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'lines_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def semi_anti_integrity(spark, sf_dir):
    c, o, li = (t(spark, sf_dir, x) for x in ("customer", "orders", "lineitem"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    out = count(o.join(li, o.o_orderkey == li.l_orderkey, "left_anti"), "orders_without_lines")
    out = out.unionByName(count(c.join(o, c.c_custkey == o.o_custkey, "left_semi"), "customers_with_orders"))
    out = out.unionByName(count(c.join(o, c.c_custkey == o.o_custkey, "left_anti"), "customers_without_orders"))
    return out.unionByName(count(li.join(o, li.l_orderkey == o.o_orderkey, "left_anti"), "lines_without_order"))


@query("""
WITH g AS (SELECT c_nationkey AS nation, CAST(floor(c_acctbal / 100) AS BIGINT) AS band, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS ls FROM customer),
h AS (SELECT s_nationkey AS nation, CAST(floor(s_acctbal / 100) AS BIGINT) AS band, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'BUILDING' END AS rs FROM supplier),
p AS (SELECT c_custkey, s_suppkey FROM g JOIN h USING (nation, band) WHERE ls IS NULL OR rs IS NULL OR ls = rs)
SELECT c_custkey, s_suppkey FROM p QUALIFY count(*) OVER (PARTITION BY c_custkey) = 1 AND count(*) OVER (PARTITION BY s_suppkey) = 1""")
def unique_null_tolerant_match(spark, sf_dir):
    left = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 100).alias("band"), "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    right = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 100).alias("band"), "s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.lit("BUILDING")).alias("segment"))
    return joins.unique_match(left, right, ["nation", "band"], "c_custkey", "s_suppkey", nullable=["segment"])


# --- graph --------------------------------------------------------------------------------------------------------------


def _graph(spark, sf_dir):
    r, n, c, o = (t(spark, sf_dir, x) for x in ("region", "nation", "customer", "orders"))
    nodes = graph.node_rows(r, "Region", "r_regionkey", "r_name").unionByName(graph.node_rows(n, "Nation", "n_nationkey", "n_name")).unionByName(graph.node_rows(c, "Customer", "c_custkey", "c_name")).unionByName(graph.node_rows(o, "Order", "o_orderkey", "o_orderstatus"))
    edges = graph.edge_rows(n, ("Region", "n_regionkey"), ("Nation", "n_nationkey"), "HAS_NATION").unionByName(graph.edge_rows(c, ("Nation", "c_nationkey"), ("Customer", "c_custkey"), "HAS_CUSTOMER")).unionByName(graph.edge_rows(o, ("Customer", "o_custkey"), ("Order", "o_orderkey"), "PLACED"))
    return nodes, graph.distinct_edges(edges)


@query("""
WITH c AS (SELECT 'node' AS kind, 'Region' AS name, count(*) AS n FROM region UNION ALL SELECT 'node', 'Nation', count(*) FROM nation UNION ALL SELECT 'node', 'Customer', count(*) FROM customer UNION ALL SELECT 'node', 'Order', count(*) FROM orders
UNION ALL SELECT 'edge', 'HAS_NATION', count(*) FROM nation UNION ALL SELECT 'edge', 'HAS_CUSTOMER', count(*) FROM customer UNION ALL SELECT 'edge', 'PLACED', count(*) FROM orders)
SELECT kind, name, n FROM c UNION ALL SELECT kind, '*', CAST(sum(n) AS BIGINT) FROM c GROUP BY kind""")
def graph_stats(spark, sf_dir):
    return graph.stats(*_graph(spark, sf_dir))


@query("""
SELECT 'nation_' || substr(sha1('Nation:' || n_nationkey), 1, 12) AS other, 'HAS_NATION' AS relation, 'out' AS direction FROM nation WHERE n_regionkey = 1""")
def graph_neighbourhood(spark, sf_dir):
    import hashlib

    return graph.neighbourhood(_graph(spark, sf_dir)[1], "region_" + hashlib.sha1(b"Region:1").hexdigest()[:12])


@query("""
SELECT 'orphan_node' AS "check", 'customer_' || substr(sha1('Customer:' || c_custkey), 1, 12) AS item, CAST(1 AS BIGINT) AS n FROM customer WHERE c_nationkey = 3 AND c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'dangling_edge', 'nation_' || substr(sha1('Nation:' || 4), 1, 12), count(*) + 1 FROM customer WHERE c_nationkey = 4""")
def graph_integrity(spark, sf_dir):
    """The graph with nation 4 taken out of the nodes and the customers of nation 3 cut from their nation."""
    nodes, edges = _graph(spark, sf_dir)
    four, three = (F.concat(F.lit("nation_"), F.substring(F.sha1(F.lit(f"Nation:{k}").cast("binary")), 1, 12)) for k in (4, 3))
    return graph.integrity(nodes.where(F.col("id") != four), edges.where(~((F.col("relation") == "HAS_CUSTOMER") & (F.col("src") == three))))


@query("""
SELECT 'region_' || substr(sha1('Region:' || r_regionkey), 1, 12) AS owner, 'HAS_NATION' AS relation, n_name AS label FROM region JOIN nation ON n_regionkey = r_regionkey""")
def graph_related_facts(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    owners = nodes.where("type = 'Region'").select(F.col("id").alias("rid"))
    return graph.related_facts(nodes, edges, owners, "rid").select("owner", "relation", "label")


@query("""SELECT 'd_' || doc_id AS node, min('d_' || doc_id) OVER (PARTITION BY text) AS component FROM documents WHERE text IS NOT NULL""")
def connected_components(spark, sf_dir):
    """Documents linked by equal text within sources: components of the bipartite graph of sources and texts."""
    d = t(spark, sf_dir, "documents")
    digest = F.concat(F.lit("t_"), F.sha1(F.col("text").cast("binary")))
    e = d.select(F.concat(F.lit("d_"), F.col("doc_id").cast("string")).alias("src"), digest.alias("dst"))
    return graph.components(e).where("node like 'd_%'")


@query("""
WITH RECURSIVE c AS (SELECT conv_id AS k, 0 AS depth FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id = 0
UNION SELECT b.conv_id, c.depth + 1 FROM c JOIN (SELECT DISTINCT conv_id FROM conversations) b ON b.conv_id IN (2 * c.k + 1, 2 * c.k + 2))
SELECT k AS id, depth FROM c""")
def link_closure(spark, sf_dir):
    """Closure over links k to 2k+1 and 2k+2 among conversations, from conversation 0."""
    ids = t(spark, sf_dir, "conversations").select("conv_id").distinct()
    links = ids.where("conv_id > 0").select(F.expr("(conv_id - 1) div 2").alias("src"), F.col("conv_id").alias("dst"))
    seeds = ids.where("conv_id = 0").select(F.col("conv_id").alias("id"))
    return graph.closure(links, seeds)


@query("""SELECT c_custkey AS child, CAST(c_custkey % 10 AS BIGINT) AS root FROM customer WHERE c_custkey >= 10""")
def part_of_roots(spark, sf_dir):
    """Roots along part-of links k to k - 10."""
    links = t(spark, sf_dir, "customer").where("c_custkey >= 10").select(F.col("c_custkey").alias("child"), (F.col("c_custkey") - 10).alias("parent"))
    return graph.roots(links, "child", "parent")


# --- coverage, screening, assessment ------------------------------------------------------------------------------------


def _objects(spark, sf_dir):
    last = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("low_price"), F.count(F.lit(1)).alias("n_orders"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_status"))
    return t(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


_OBJECTS = """o AS (SELECT c.*, low_price, n_orders, last_status FROM customer c LEFT JOIN (SELECT o_custkey, min(o_totalprice) AS low_price, count(*) AS n_orders, arg_max(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) AS last_status FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"""


@query(f"""
WITH {_OBJECTS} SELECT c_custkey, 2 + (low_price IS NOT NULL)::INT + (last_status IS NOT NULL)::INT AS available, 4 AS total, (last_status IS NULL)::INT AS required_missing,
concat_ws(',', CASE WHEN last_status IS NULL THEN 'last_status' END, CASE WHEN low_price IS NULL THEN 'low_price' END) AS missing, (2 + (low_price IS NOT NULL)::INT + (last_status IS NOT NULL)::INT) / 4 AS ratio, last_status IS NOT NULL AS ready FROM o""")
def completeness_report(spark, sf_dir):
    specs = spark.createDataFrame([("c_name", True, False), ("c_acctbal", False, False), ("low_price", False, False), ("last_status", True, False), ("c_phone", False, True)], "code string, required boolean, reserved boolean")
    rows = _objects(spark, sf_dir).withColumn("c_phone", F.lit(None).cast("string"))
    out = coverage.completeness(rows, "c_custkey", specs, ["c_name", "c_acctbal", "low_price", "last_status", "c_phone"])
    return out.withColumn("missing", F.array_join("missing", ",")).withColumns({c: F.col(c).cast("int") for c in ("available", "total", "required_missing")})


@query(f"""
WITH {_OBJECTS}, c AS (SELECT count(*) AS t, count(*) FILTER (c_name <> '') AS a, count(*) FILTER (c_acctbal IS NOT NULL) AS b, count(low_price) AS c, count(*) FILTER (last_status <> '') AS d FROM o)
SELECT unnest(['c_name', 'c_acctbal', 'low_price', 'last_status']) AS field, unnest([a, b, c, d]) AS available, t AS total, unnest([a, b, c, d]) / t AS ratio FROM c""")
def field_coverage(spark, sf_dir):
    return coverage.field_coverage(_objects(spark, sf_dir), ["c_name", "c_acctbal", "low_price", "last_status"])


@query(f"""
WITH {_OBJECTS}, c AS (SELECT count(low_price) / count(*) AS r FROM o)
SELECT 'c_name' AS field, 1.0::DOUBLE AS ratio, 0.95::DOUBLE AS least, true AS passed UNION ALL SELECT 'low_price', r, 0.8::DOUBLE, r >= 0.8 FROM c UNION ALL SELECT 'geometry', NULL, 0.5::DOUBLE, false""")
def quality_gates(spark, sf_dir):
    least = spark.createDataFrame([("c_name", 0.95), ("low_price", 0.8), ("geometry", 0.5)], "field string, least double")
    return coverage.gates(coverage.field_coverage(_objects(spark, sf_dir), ["c_name", "low_price"]), least)


@query("""
SELECT 'PLACED' AS relation, count(DISTINCT o_custkey) AS available, (SELECT count(*) FROM customer) AS total, count(DISTINCT o_custkey) / (SELECT count(*) FROM customer) AS ratio FROM orders""")
def relation_coverage(spark, sf_dir):
    edges = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.lit("PLACED").alias("relation"))
    return coverage.relation_coverage(t(spark, sf_dir, "customer"), "c_custkey", edges)


@query("""
WITH e AS (SELECT o_orderkey AS k, count(*) AS n_expected FROM orders GROUP BY ALL), s AS (SELECT l_orderkey AS k, count(*) AS n_seen FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL)
SELECT coalesce(e.k, s.k) AS o_orderkey, coalesce(n_expected, 0) AS n_expected, coalesce(n_seen, 0) AS n_seen, CASE WHEN n_seen IS NULL THEN 'missing' WHEN n_expected IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM e FULL JOIN s ON e.k = s.k WHERE n_seen IS NULL OR n_expected IS NULL OR n_seen > 1""")
def coverage_exactly_once(spark, sf_dir):
    seen = t(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return coverage.exactly_once(t(spark, sf_dir, "orders"), seen, ["o_orderkey"])


@query("""
SELECT sha256(text) AS digest, string_agg(DISTINCT source, ',' ORDER BY source) AS splits FROM documents GROUP BY text HAVING count(DISTINCT source) > 1""")
def partition_leak_check(spark, sf_dir):
    return coverage.partition_leaks(t(spark, sf_dir, "documents"), "text", "source").withColumn("splits", F.array_join("splits", ","))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def status_counts(spark, sf_dir):
    return coverage.status_counts(t(spark, sf_dir, "orders"), "o_orderstatus")


@query(f"""
WITH {_OBJECTS}, f AS (SELECT *, low_price / 100000 AS factor, CASE last_status WHEN 'F' THEN '不稳定' WHEN 'O' THEN '稳定' WHEN 'P' THEN '基本稳定' END AS st FROM o),
j AS (SELECT *, coalesce(st IN ('不稳定', '欠稳定') OR factor < 1.05, st IN ('不稳定', '欠稳定'), false) AS adverse, coalesce(c_acctbal < -900, false) AS ob, coalesce(st = '基本稳定', false) OR coalesce(factor >= 1.05 AND factor < 1.15, false) AS watch, c_mktsegment = 'FURNITURE' AND coalesce(c_acctbal >= 5000, false) AS rock FROM f)
SELECT c_custkey, CASE WHEN ob OR adverse THEN 'P1' WHEN watch OR rock THEN 'P2' WHEN c_mktsegment <> 'MACHINERY' AND n_orders IS NOT NULL THEN 'P3' ELSE 'P4' END AS priority,
CASE WHEN ob OR adverse THEN concat_ws('|', CASE WHEN ob THEN 'anomaly_observed' END, CASE WHEN adverse THEN 'adverse_stability' END) WHEN watch OR rock THEN concat_ws('|', CASE WHEN watch THEN 'watch_stability' END, CASE WHEN rock THEN 'rockfall_on_high_or_steep' END)
WHEN c_mktsegment <> 'MACHINERY' AND n_orders IS NOT NULL THEN 'identified_without_recent_state' WHEN c_mktsegment <> 'MACHINERY' THEN 'identified_without_evidence' ELSE 'nothing_identified' END AS reasons FROM j""")
def priority_screening(spark, sf_dir):
    return _screened(spark, sf_dir).select("c_custkey", "p.priority", F.array_join("p.reasons", "|").alias("reasons"))


def _screened(spark, sf_dir):
    o = _objects(spark, sf_dir).withColumn("factor", F.col("low_price") / 100000)
    o = o.withColumn("st", F.when(F.col("last_status") == "F", "不稳定").when(F.col("last_status") == "O", "稳定").when(F.col("last_status") == "P", "基本稳定"))
    o = o.withColumn("observed", F.col("c_acctbal") < -900)
    p = screening.priority(F.col("st"), F.col("factor"), F.col("observed"), marked=F.lit(False), potential=F.lit(False), rockfall=F.col("c_mktsegment") == "FURNITURE", height=F.col("c_acctbal") * 30 / 5000, gradient=F.lit(None).cast("double"), identified=F.col("c_mktsegment") != "MACHINERY", reliable=F.col("n_orders").isNotNull())
    return o.withColumn("p", p)


@query(f"""
WITH {_OBJECTS}, f AS (SELECT *, low_price / 100000 AS factor, CASE last_status WHEN 'F' THEN '不稳定' WHEN 'O' THEN '稳定' WHEN 'P' THEN '基本稳定' END AS st FROM o),
a AS (SELECT c_custkey, CASE WHEN coalesce(c_acctbal < -900, false) OR coalesce(st IN ('不稳定', '欠稳定') OR factor < 1.05, st IN ('不稳定', '欠稳定'), false) THEN '较高' WHEN coalesce(st = '基本稳定', false) OR coalesce(factor < 1.15, false) THEN '中等' WHEN st = '稳定' THEN '较低' END AS likelihood,
CASE WHEN c_acctbal >= 7000 THEN '高' WHEN c_acctbal >= 3000 THEN '中等' WHEN c_acctbal >= 0 THEN '低' END AS consequence FROM f),
m(likelihood, consequence, level) AS (VALUES ('较高', '高', '高'), ('较高', '中等', '较高'), ('较高', '低', '中等'), ('中等', '高', '较高'), ('中等', '中等', '中等'), ('中等', '低', '较低'), ('较低', '高', '中等'), ('较低', '中等', '较低'), ('较低', '低', '低'))
SELECT c_custkey, likelihood, consequence, level FROM a LEFT JOIN m USING (likelihood, consequence)""")
def risk_matrix(spark, sf_dir):
    o = _screened(spark, sf_dir).withColumn("likelihood", screening.likelihood(F.col("st"), F.col("factor"), F.col("observed")))
    exposure = F.when(F.col("c_acctbal") >= 7000, "重大后果").when(F.col("c_acctbal") >= 3000, "中").when(F.col("c_acctbal") >= 0, "较小")
    o = o.withColumn("consequence", screening.consequence(exposure))
    return screening.apply_matrix(o, screening.matrix_table(spark)).select("c_custkey", "likelihood", "consequence", "level")


@query("""
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 9 END, o_totalprice, o_orderkey) = 1""")
def worst_record(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return screening.worst_record(rows, ["o_custkey"], "o_orderstatus", "o_totalprice", "o_orderkey", order=["F", "P", "O"])


@query(f"WITH s AS ({ORACLE_SQL['priority_screening']}), c(priority) AS (VALUES ('P1'), ('P2'), ('P3'), ('P4')) SELECT priority, count(s.c_custkey) AS n FROM c LEFT JOIN s USING (priority) GROUP BY priority")
def screening_summary(spark, sf_dir):
    codes = spark.createDataFrame([(p,) for p in screening.PRIORITIES], "priority string")
    return screening.summary(_screened(spark, sf_dir).select("p.priority"), codes, "priority")


@query(f"""
WITH s AS ({ORACLE_SQL['priority_screening']}), r AS ({ORACLE_SQL['rule_conditions_all_any']})
SELECT c_custkey, least(priority, coalesce(rule_output, priority)) AS priority FROM s JOIN r USING (c_custkey)""")
def rule_escalation(spark, sf_dir):
    o = _screened(spark, sf_dir).withColumn("priority", F.col("p.priority"))
    return conditions.evaluate_rules(o, RULES).select("c_custkey", screening.escalate("priority", "rule_output").alias("priority"))


@query(f"""
WITH {_OBJECTS} SELECT c_custkey, false AS ready, concat_ws('|', CASE WHEN NOT coalesce(n_orders > 2, false) THEN 'approved_rule_set' END, CASE WHEN last_status IS NULL THEN 'hazard_or_likelihood_available' END, CASE WHEN low_price IS NULL THEN 'consequence_available' END,
CASE WHEN NOT coalesce(last_status = 'O', false) THEN 'current_dynamic_evidence' END, 'approved_dynamic_rule_result', CASE WHEN coalesce(n_orders, 0) % 5 <> 0 THEN 'no_unresolved_stability_conflict' END, 'formal_release_supported') AS blocking FROM o""")
def formal_gate(spark, sf_dir):
    g = screening.formal_gate(F.col("n_orders") > 2, F.col("last_status"), F.col("low_price"), F.col("last_status") == "O", F.lit(False), F.col("n_orders") % 5)
    return _objects(spark, sf_dir).withColumn("g", g).select("c_custkey", "g.ready", F.array_join("g.blocking", "|").alias("blocking"))


@query(f"""
WITH {_OBJECTS}, g AS (SELECT c_custkey, coalesce(n_orders, 0) AS gaps, last_status IS NOT NULL AS st, coalesce(c_acctbal < 0, false) AS ob, c_mktsegment = 'BUILDING' AS ex, c_nationkey = 1 AS cf, CASE WHEN c_nationkey = 2 THEN 'stale' ELSE 'current' END AS v FROM o)
SELECT c_custkey, ['低', '较低', '中等', '较高'][least(CASE WHEN st AND ob AND ex AND gaps <= 3 THEN 3 WHEN st AND gaps <= 8 THEN 2 WHEN st OR ob THEN 1 ELSE 0 END, CASE WHEN cf OR v = 'stale' THEN 1 ELSE 3 END) + 1] AS confidence FROM g""")
def confidence_label(spark, sf_dir):
    c = screening.confidence(F.col("last_status").isNotNull(), F.col("c_acctbal") < 0, F.col("c_mktsegment") == "BUILDING", F.coalesce("n_orders", F.lit(0)), F.col("c_nationkey") == 1, F.when(F.col("c_nationkey") == 2, "stale").otherwise("current"))
    return _objects(spark, sf_dir).select("c_custkey", c.alias("confidence"))


@query("""
WITH f AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'loss' ELSE 'deaths' END AS variable, o_totalprice / 1000 AS x FROM orders),
g AS (SELECT o_custkey, variable, CASE variable WHEN 'loss' THEN CASE WHEN x < 100 THEN '危害小' WHEN x <= 250 THEN '危害中等' ELSE '危害大' END ELSE CASE WHEN x < 150 THEN '危害小' WHEN x <= 300 THEN '危害中等' ELSE '危害大' END END AS g FROM f)
SELECT o_custkey, string_agg(DISTINCT g, ',' ORDER BY g) AS possible, count(DISTINCT variable) AS indicators, count(DISTINCT g) > 1 AS conflict, CASE WHEN count(DISTINCT g) = 1 THEN min(g) END AS grade FROM g GROUP BY o_custkey""")
def table_band_grade(spark, sf_dir):
    x = F.col("o_totalprice") / 1000
    facts = t(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, "loss").otherwise("deaths").alias("variable"), x.alias("low"), x.alias("high"), F.lit(True).alias("low_closed"), F.lit(True).alias("high_closed"), F.lit("k").alias("unit"))
    bands = spark.createDataFrame([("loss", "k", 100.0, 250.0), ("deaths", "k", 150.0, 300.0)], "variable string, unit string, low_boundary double, high_boundary double")
    out = assessment.table_grade(facts, bands, "o_custkey")
    return out.select("o_custkey", F.array_join("possible", ",").alias("possible"), "indicators", "conflict", "grade")


@query("""
WITH o AS (SELECT DISTINCT o_custkey, o_orderstatus AS development, o_orderpriority AS harm FROM orders),
b AS (SELECT a.o_custkey, a.development, b.harm FROM (SELECT DISTINCT o_custkey, development FROM o) a JOIN (SELECT DISTINCT o_custkey, harm FROM o) b USING (o_custkey)),
g AS (SELECT *, CASE WHEN development = 'F' AND harm LIKE '1%' THEN 'high' WHEN development = 'F' OR harm LIKE '1%' THEN 'medium' ELSE 'low' END AS grade FROM b)
SELECT o_custkey, count(*) AS n_branches, string_agg(DISTINCT grade, ',' ORDER BY grade) AS possible, CASE WHEN count(DISTINCT grade) = 1 THEN min(grade) END AS grade FROM g GROUP BY o_custkey""")
def branch_product(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    # The matrix is a dimension: statuses times priorities.
    d = o.select(F.col("o_orderstatus").alias("development")).distinct().withColumn("_k", F.lit(0)).join(o.select(F.col("o_orderpriority").alias("harm")).distinct().withColumn("_k", F.lit(0)), "_k").drop("_k")
    f, one = F.col("development") == "F", F.col("harm").startswith("1")
    matrix = d.withColumn("grade", F.when(f & one, "high").when(f | one, "medium").otherwise("low"))
    objects = o.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("developments"), F.collect_set("o_orderpriority").alias("harms"))
    out = assessment.branch_product(objects, matrix, "o_custkey")
    return out.select("o_custkey", F.size("branches").cast("long").alias("n_branches"), F.array_join("possible", ",").alias("possible"), "grade")


@query("""
WITH w AS (SELECT c_custkey, unnest(['F', 'O', 'P']) AS variable FROM customer),
f AS (SELECT o_custkey AS c_custkey, o_orderstatus AS variable, count(DISTINCT o_orderpriority) FILTER (o_totalprice > 50000) AS k, min(o_orderpriority) FILTER (o_totalprice > 50000) AS v, count(*) AS n FROM orders GROUP BY ALL)
SELECT c_custkey, variable, CASE WHEN k = 1 THEN 'selected' WHEN k > 1 THEN 'conflicted' WHEN n > 0 THEN 'candidates' ELSE 'missing' END AS state, CASE WHEN k = 1 THEN v END AS value FROM w LEFT JOIN f USING (c_custkey, variable)""")
def variable_resolution(spark, sf_dir):
    facts = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("variable"), F.col("o_orderpriority").alias("value"), (F.col("o_totalprice") > 50000).alias("usable"), F.col("o_orderkey").cast("string").alias("fact_id"))
    wanted = t(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*map(F.lit, "FOP"))).alias("variable"))
    return assessment.resolve_variables(facts, wanted, "c_custkey").drop("fact_ids")


# --- evaluation ---------------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT toxic AS actual, CASE WHEN lower(text) LIKE '%idiot%' OR lower(text) LIKE '%scum%' THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id)),
g AS (SELECT a.x AS actual, b.x AS predicted FROM (VALUES (0), (1)) a(x), (VALUES (0), (1)) b(x))
SELECT g.actual, g.predicted, count(p.actual) AS n FROM g LEFT JOIN p ON p.actual = g.actual AND p.predicted = g.predicted GROUP BY ALL""")
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(_pairs(spark, sf_dir), "toxic", "predicted", [0, 1])


def _pairs(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.when(F.lower("text").rlike("idiot|scum"), 1).otherwise(0).alias("predicted"))
    return t(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "predicted", "doc_id")


@query("""
WITH p AS (SELECT toxic AS a, CASE WHEN lower(text) LIKE '%idiot%' OR lower(text) LIKE '%scum%' THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)),
m AS (SELECT CASE a WHEN 1 THEN 0 ELSE 3 END AS a, CASE p WHEN 1 THEN 0 ELSE 3 END AS p FROM p)
SELECT count(*) AS n, count(*) FILTER (a = p) / count(*) AS accuracy, count(*) FILTER (abs(a - p) <= 1) / count(*) AS within_one, count(*) FILTER (a < 2 AND p < 2) / nullif(count(*) FILTER (p < 2), 0) AS urgent_precision, count(*) FILTER (a < 2 AND p < 2) / nullif(count(*) FILTER (a < 2), 0) AS urgent_recall, count(*) FILTER (a = 0 AND p >= 2) AS critical_misses FROM m""")
def precision_recall(spark, sf_dir):
    p = _pairs(spark, sf_dir).select(*[F.when(F.col(c) == 1, "P1").otherwise("P4").alias(c) for c in ("toxic", "predicted")])
    return evaluation.screening_metrics(p, "toxic", "predicted")


@query("""
WITH g AS (SELECT l_partkey, l_suppkey, count(*) AS g FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), f AS (SELECT l_partkey, l_suppkey, count(*) AS f FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
b AS (SELECT coalesce(g, 0) AS g, coalesce(f, 0) AS f FROM g FULL JOIN f USING (l_partkey, l_suppkey))
SELECT CAST(sum(least(g, f)) AS BIGINT) AS matched, CAST(sum(g) AS BIGINT) AS gold, CAST(sum(f) AS BIGINT) AS found, sum(least(g, f)) / nullif(sum(f), 0) AS precision, sum(least(g, f)) / nullif(sum(g), 0) AS recall FROM b""")
def multiset_intersect(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    return evaluation.multiset_scores(li.where("l_linestatus = 'F'"), li.where("l_linestatus = 'O'"), ["l_partkey", "l_suppkey"])


@query("""
WITH l AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'P1' ELSE 'bad' END AS label FROM labels UNION ALL SELECT doc_id, 'P2' FROM labels WHERE doc_id % 50 = 0 UNION ALL SELECT -1 - doc_id, 'P3' FROM labels WHERE doc_id % 40 = 0),
c AS (SELECT doc_id, count(*) AS n FROM l GROUP BY ALL)
SELECT coalesce(CASE WHEN n > 1 THEN 'duplicate_label' WHEN d.doc_id IS NULL THEN 'unknown_id' WHEN label NOT IN ('P1', 'P2', 'P3', 'P4') THEN 'invalid_label' END, 'accepted') AS rejected, count(*) AS n FROM l JOIN c USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d ON d.doc_id = l.doc_id GROUP BY 1""")
def label_rejections(spark, sf_dir):
    base = t(spark, sf_dir, "labels")
    l_ = base.select("doc_id", F.when(F.col("quality") == 1, "P1").otherwise("bad").alias("label")).union(base.where("doc_id % 50 = 0").select("doc_id", F.lit("P2"))).union(base.where("doc_id % 40 = 0").select(-1 - F.col("doc_id"), F.lit("P3")))
    out = evaluation.match_labels(l_, t(spark, sf_dir, "documents").select("doc_id").distinct(), "doc_id", "label", screening.PRIORITIES)
    return out.groupBy(F.coalesce("rejected", F.lit("accepted")).alias("rejected")).agg(F.count(F.lit(1)).alias("n"))


# --- text ---------------------------------------------------------------------------------------------------------------


@query("""
SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) AS compact_chars, 'doc_' || substr(sha1(text), 1, 12) AS id, len(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) AS n_numbers FROM documents""")
def text_normalise(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.length(T.compact("text")).cast("long").alias("compact_chars"), V.stable_id("doc", "text").alias("id"), F.size(V.numbers_in_text("text")).cast("long").alias("n_numbers"))


@query("""
WITH s AS (SELECT o_orderkey, 'k' || (o_orderkey % 90) || ' + ' || (o_custkey % 1000) || '～' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'K' || (o_orderkey % 90 + o_orderkey % 2) || '+' END || (o_custkey % 700) AS raw FROM orders)
SELECT o_orderkey, 'K' || (o_orderkey % 90) || '+' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '-K' || (o_orderkey % 90 + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 2 END) || '+' || lpad(CAST(o_custkey % 700 AS VARCHAR), 3, '0') AS station,
CAST((o_orderkey % 90) * 1000 + o_custkey % 1000 AS BIGINT) AS start_m, CAST((o_orderkey % 90 + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 2 END) * 1000 + o_custkey % 700 AS BIGINT) AS end_m FROM orders""")
def station_parse(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    raw = F.concat(F.lit("k"), s(k % 90), F.lit(" + "), s(c % 1000), F.lit("～"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("K"), s(k % 90 + k % 2), F.lit("+"))), s(c % 700))
    return t(spark, sf_dir, "orders").select("o_orderkey", T.station(raw).alias("s")).select("o_orderkey", F.col("s.text").alias("station"), "s.start_m", "s.end_m")


@query("""
SELECT doc_id, len(regexp_extract_all(text, '([a-z]+)@([a-z.]+)')) AS n_pairs, regexp_extract(text, '([a-z]+)@([a-z.]+)', 1) AS first_name, regexp_extract(text, '([a-z]+)@([a-z.]+)', 2) AS first_host FROM documents""")
def regex_pairs(spark, sf_dir):
    rows = T.pattern_rows("text", "([a-z]+)@([a-z.]+)", ["name", "host"])
    return t(spark, sf_dir, "documents").select("doc_id", rows.alias("m")).select("doc_id", F.size("m").cast("long").alias("n_pairs"), F.coalesce(F.get("m", F.lit(0))["name"], F.lit("")).alias("first_name"), F.coalesce(F.get("m", F.lit(0))["host"], F.lit("")).alias("first_host"))


TERMS = ("the", "ing", "ation", "tion", "heit", "ment", "ción")


@query("SELECT doc_id, concat_ws('|', " + ", ".join(f"CASE WHEN contains(text, '{x}') THEN '{x}' END" for x in TERMS) + ") AS terms FROM documents")
def term_dictionary(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(T.terms_in("text", list(TERMS)), "|").alias("terms"))


@query("""
WITH s AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[.;\\n]')) AS clause FROM conversations)
SELECT conv_id, turn, count(*) FILTER (regexp_replace(clause, '\\s+', '', 'g') <> '') AS n_clauses, count(*) FILTER (contains(clause, ' the ') AND NOT regexp_matches(clause, 'not |never ')) AS n_affirmed FROM s GROUP BY ALL""")
def clause_polarity(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", r"[.;\n]", -1)).alias("clause"))
    return rows.groupBy("conv_id", "turn").agg(F.count_if(T.compact("clause") != "").alias("n_clauses"), F.count_if(F.contains("clause", F.lit(" the ")) & ~F.col("clause").rlike("not |never ")).alias("n_affirmed"))


@query("""
WITH p AS (SELECT page_id, len(string_split(html, ' ')) AS w, len(string_split(lower(html), '<img')) - 1 AS i, len(string_split(lower(html), '<svg')) - 1 AS d, len(string_split(lower(html), '<table')) - 1 AS tb FROM pages)
SELECT page_id, CASE WHEN tb > 0 THEN 'table' WHEN d >= 50 AND w < 100 THEN 'drawing' WHEN w < 20 AND i > 0 THEN 'scanned' WHEN w < 20 AND i = 0 THEN 'blank' WHEN i > 0 THEN 'mixed' ELSE 'native' END AS page_type FROM p""")
def page_type_classify(spark, sf_dir):
    tags = lambda x: F.size(F.split(F.lower("html"), x, -1)) - 1
    return t(spark, sf_dir, "pages").select("page_id", documents.page_class(F.size(F.split("html", " ", -1)), tags("<img"), tags("<svg"), tags("<table")).alias("page_type"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, '[<>]') AND regexp_matches(line, '[0-9]')) AS n_thresholds FROM l GROUP BY doc_id""")
def threshold_lines(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    n = documents.lines(d, ["doc_id"], "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
    hits = documents.threshold_lines(d, ["doc_id"], "text").where(F.col("line").rlike("[<>]")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_thresholds"))
    return n.join(hits, "doc_id", "left").na.fill(0, ["n_thresholds"])


@query("""
WITH s AS (SELECT doc_id, source, regexp_replace(lower(text), '\\s+', '', 'g') AS t, regexp_replace(lower(substr(text, 1, 40)), '\\s+', '', 'g') AS p FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (contains(t, p)) AS found, count(*) FILTER (contains(t, p)) / count(*) AS recall FROM s GROUP BY ROLLUP (source)""")
def phrase_recall(spark, sf_dir):
    """Recall of each document's own first words in its page text, by source and overall."""
    d = t(spark, sf_dir, "documents")
    phrases = d.select("doc_id", "source", F.substring("text", 1, 40).alias("phrase"))
    return evaluation.phrase_recall(d, phrases, "doc_id", "text", "phrase", "source")


@query("""
SELECT n_nationkey AS k, 'both' AS op FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT k, 'customer_only' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT k, 'either' FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT k, 'all' FROM (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)""")
def set_ops(spark, sf_dir):
    c, s = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    named = lambda df, n: df.select("k", F.lit(n).alias("op"))
    out = named(c.intersect(s), "both").unionByName(named(c.subtract(s), "customer_only")).unionByName(named(c.union(s).distinct(), "either"))
    return out.unionByName(named(c.intersectAll(s), "all"))


@query()
def identity_proposals(spark, sf_dir):
    """Suppliers proposed for customers of their nation, by name, nation and balance range."""

    def shaped(df, p, key):
        return df.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_nationkey").cast("string").alias("route"), F.lit("L").alias("side"), F.floor(F.col(f"{p}_acctbal") * 10).cast("long").alias("start_m"), (F.floor(F.col(f"{p}_acctbal") * 10) + 500).cast("long").alias("end_m"), F.lit(None).cast("string").alias("namespace"), F.lit(None).cast("string").alias("external_id"))

    return identity.proposals(shaped(t(spark, sf_dir, "supplier"), "s", "s_suppkey"), shaped(t(spark, sf_dir, "customer").withColumnRenamed("c_name", "c_name"), "c", "c_custkey")).where("place = 1")


# --- retrieval, typed values, bindings, readings --------------------------------------------------------------------------


@query("""
WITH l AS (SELECT doc_id, lower(unnest(string_split(text, chr(10)))) AS line FROM documents), k(keyword) AS (VALUES ('licensed'), ('the and'), ('die '))
SELECT doc_id, keyword, count(*) AS n_lines FROM l, k WHERE contains(line, keyword) GROUP BY ALL""")
def keyword_retrieval(spark, sf_dir):
    words = spark.createDataFrame([("licensed",), ("the and",), ("die ",)], "keyword string")
    hits = joins.keyword_pages(t(spark, sf_dir, "documents"), words, "doc_id", "text", "keyword")
    return hits.where("quote is not null").groupBy("doc_id", "keyword").agg(F.count(F.lit(1)).alias("n_lines"))


@query("""
WITH d AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1997-06-30') AS age FROM orders)
SELECT o_orderkey, CASE WHEN age < 0 THEN 'future_date' WHEN age <= 30 THEN 'current' WHEN age <= 90 THEN 'aging' ELSE 'stale' END AS validity FROM d""")
def temporal_validity(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", V.age_class(F.date_format("o_orderdate", "yyyy-MM-dd"), "1997-06-30").alias("validity"))


@query("""
WITH v AS (SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS a, CAST(floor(o_totalprice / 1000) AS BIGINT) + o_custkey % 7 - 1 AS b FROM orders)
SELECT o_orderkey, CASE WHEN a > b THEN 'rejected' ELSE 'accepted' END AS state, CASE WHEN a > b THEN 'bounds_reversed' END AS reason, CASE WHEN a <= b THEN a::DOUBLE END AS lower, CASE WHEN a <= b THEN b::DOUBLE END AS upper FROM v""")
def typed_quantities(spark, sf_dir):
    a = F.floor(F.col("o_totalprice") / 1000).cast("long")
    text = F.concat(F.lit("约"), a.cast("string"), F.lit("~"), (a + F.col("o_custkey") % 7 - 1).cast("string"))
    rows = t(spark, sf_dir, "orders").select("o_orderkey", text.alias("v"), F.concat(F.lit("损失"), text, F.lit("万元")).alias("quote"), F.lit("万元").alias("unit"))
    return rows.select("o_orderkey", Q.quantity("v", "unit", "quote", kind="money").alias("q")).select("o_orderkey", "q.state", "q.reason", "q.lower", "q.upper")


@query("""
WITH n AS (SELECT user_id, max(event_id) AS seq FROM events GROUP BY user_id)
SELECT user_id AS binding_id, seq % 11 AS master_id, seq FROM n WHERE seq % 3 <> 0""")
def active_bindings(spark, sf_dir):
    h = _events(spark, sf_dir).select(F.col("user_id").alias("binding_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "release").otherwise("assign").alias("action"), (F.col("event_id") % 11).alias("master_id"))
    return identity.active_bindings(h)


@query("""
WITH e AS (SELECT user_id AS job_id, event_id AS seq, CASE WHEN event_id % 97 = 0 THEN 'failed' WHEN event_id % 2 = 0 THEN 'running' ELSE 'queued' END AS state FROM events)
SELECT job_id, arg_max(state, seq) AS state, arg_max(state, seq) <> 'failed' AS active, coalesce(min(seq) FILTER (state = 'failed') = max(seq), true) AS legal FROM e GROUP BY job_id""")
def job_states(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 97 == 0, "failed").when(F.col("event_id") % 2 == 0, "running").otherwise("queued").alias("state"))
    return stream.job_states(e)


@query("""
WITH a AS (SELECT l_orderkey, count(*) AS n, min(l_returnflag) AS v FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL), b AS (SELECT l_orderkey, count(*) AS n, min(l_returnflag) AS v FROM lineitem WHERE l_linenumber = 2 GROUP BY ALL)
SELECT l_orderkey, a.v AS a_value, b.v AS b_value, CASE WHEN a.n > 1 OR b.n > 1 THEN 'ambiguous' WHEN a.n IS NULL THEN 'only_second' WHEN b.n IS NULL THEN 'only_first' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'agree' ELSE 'differ' END AS state FROM a FULL JOIN b USING (l_orderkey)""")
def independent_readings(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    return layout.independent_readings(li.where("l_linenumber = 1"), li.where("l_linenumber = 2"), ["l_orderkey"], "l_returnflag")


@query("""
WITH c AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY ALL)
SELECT CASE WHEN n IS NULL THEN 'unassigned' WHEN n = 1 THEN 'attributed' ELSE 'disputed' END AS state, count(*) AS n FROM orders LEFT JOIN c ON l_orderkey = o_orderkey GROUP BY 1""")
def attribution_partition(spark, sf_dir):
    units = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"))
    claims = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_suppkey").alias("owner"))
    return layout.attribution_partition(units, claims).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS a, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + 60 AS b FROM orders),
m AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
c AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM m)
SELECT o_custkey, cluster, o_orderkey FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey, cluster ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def overlap_clusters(spark, sf_dir):
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("long")
    spans = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", day.alias("a"), (day + 60).alias("b"))
    out = layout.overlap_clusters(spans, ["o_custkey"], "a", "b", [F.col("o_totalprice").desc()], ["o_orderkey"])
    return out.where("chosen").select("o_custkey", "cluster", "o_orderkey")


@query("""
WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey - 1 END AS s FROM orders)
SELECT o_orderkey FROM f WHERE o_orderkey NOT IN (SELECT s FROM f WHERE s IS NOT NULL)""")
def supersession(spark, sf_dir):
    f = t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") - 1).alias("s"))
    return ordered.superseded_out(f, "o_orderkey", "s").select("o_orderkey")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, concat_ws('|', CASE WHEN l_returnflag = 'R' THEN 'no_id' END, CASE WHEN l_linestatus = 'F' AND l_quantity > 45 THEN 'unknown_kind' END, CASE WHEN l_linestatus = 'O' AND l_tax = 0 THEN 'no_unit' END) AS problems FROM lineitem
WHERE l_returnflag = 'R' OR (l_linestatus = 'F' AND l_quantity > 45) OR (l_linestatus = 'O' AND l_tax = 0)""")
def fact_contract(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    kind = F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45), "picture").when(F.col("l_linestatus") == "F", "text").otherwise("number")
    facts = li.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") != "R", F.lit("f")).alias("fact_id"), F.lit("v").alias("variable"), kind.alias("kind"), F.col("l_quantity").alias("value"), F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"), F.when(F.col("l_tax") != 0, F.lit("u")).alias("unit"))
    return facts.withColumn("problems", F.array_join(assessment.fact_problems(), "|")).where("problems <> ''").select("l_orderkey", "l_linenumber", "l_partkey", "problems")


from . import catalogue_facts  # noqa: E402, F401 - registers its queries here
