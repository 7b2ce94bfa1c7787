"""Registered queries of operators on text, geometry, evidence and review, with their SQL.

Tables of the driver hold no stations, boxes or quotes, so these are made of their keys and numbers, row by row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import assessment, conditions, coverage, documents, evaluation, evidence, graph, identity, joins, layout, ordered, screening, series
from .catalogue import query, t


def _of(key: str, *choices: str):
    """A text by a key's remainder."""
    out = F.lit(None).cast("string")
    for i, c in enumerate(choices):
        out = F.when(F.col(key) % len(choices) == i, F.lit(c)).otherwise(out)
    return out


def _pick(key: str, *values: str) -> str:
    """The same in SQL; values are SQL."""
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("""
SELECT doc_id, text IS NOT NULL AND text <> '' AS has_text, (text IS NOT NULL AND text <> '') OR (lang IS NOT NULL AND lang <> '') AS has_any, n_chars IS NOT NULL AS has_count FROM documents""")
def presence(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", V.is_present("text").alias("has_text"), V.any_present("text", "lang").alias("has_any"), V.is_present("n_chars", "other").alias("has_count"))


@query("""
WITH k AS (SELECT o_orderkey, CAST(o_orderkey % 18300 AS INTEGER) AS i FROM orders)
SELECT o_orderkey, CASE WHEN i < 1 THEN NULL WHEN i <= 26 THEN chr(64 + i) WHEN i <= 702 THEN chr(65 + (i - 27) // 26) || chr(65 + (i - 1) % 26)
ELSE chr(65 + (i - 703) // 676 % 26) || chr(65 + (i - 27) // 26 % 26) || chr(65 + (i - 1) % 26) END AS letter FROM k WHERE i <= 18278""")
def column_letters(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("i", F.col("o_orderkey") % 18300).where("i <= 18278")
    return o.select("o_orderkey", V.column_letter("i").alias("letter"))


_SPAN = "o_custkey, o_custkey % 90 AS km, CAST(floor(o_totalprice) AS BIGINT) % 1200 AS m, CAST(floor(o_totalprice) AS BIGINT) % 1200 - 100 + o_orderkey % 900 AS e"


@query(f"""
WITH s AS (SELECT o_orderkey, {_SPAN} FROM orders), v AS (SELECT *, e >= 0 AS ok FROM s)
SELECT o_orderkey, CASE WHEN ok THEN km * 1000 + m END AS start_m, CASE WHEN ok THEN km * 1000 + e END AS end_m,
CASE WHEN ok THEN printf('K%d+%03d-K%d+%03d', km, m, km, e) END AS canonical, ok AND e >= m AND m < 1000 AND e < 1000 AS valid,
CASE WHEN ok THEN printf('K%d+%03d-K%d+%03d', (km * 1000 + m) // 1000, (km * 1000 + m) % 1000, (km * 1000 + e) // 1000, (km * 1000 + e) % 1000) END AS again,
'G' || CAST(100 + o_custkey % 700 AS VARCHAR) AS route FROM v""")
def station_validity(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    price = F.floor("o_totalprice").cast("long")
    m = price % 1200
    o = o.withColumn("km", F.col("o_custkey") % 90).withColumn("m", m).withColumn("e", m - 100 + F.col("o_orderkey") % 900)
    text = F.concat(F.lit("k "), "km", F.lit("+"), "m", F.lit("～"), F.when(F.col("e") >= 0, F.col("e").cast("string")).otherwise("none"))
    o = o.withColumn("s", text).withColumn("line", F.concat(F.lit("along g"), 100 + F.col("o_custkey") % 700, F.lit(" and x1")))
    s = T.station("s")
    return o.select("o_orderkey", s["start_m"].alias("start_m"), s["end_m"].alias("end_m"), s["text"].alias("canonical"), T.station_valid("s").alias("valid"), T.station_text(s["start_m"], s["end_m"]).alias("again"), T.route_code("s", "line").alias("route"))


@query("""
SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":' || CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || ',"c_name":"' || c_name || '"}') AS digest FROM customer""")
def content_digests(spark, sf_dir):
    c = t(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")))
    return c.select("c_custkey", V.content_digest("c_name", "c_custkey", "c_mktsegment").alias("digest"))


@query(r"""
WITH a AS (SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS s FROM documents),
b AS (SELECT doc_id, regexp_replace(s, '[ \t\x{3000}]+', ' ', 'g') AS s FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^ +', ''), ' +$', ''), '\n +', chr(10), 'g'), ' +\n', chr(10), 'g') AS s FROM b)
SELECT doc_id, sha256(regexp_replace(s, '\n{3,}', chr(10) || chr(10), 'g')) AS cleaned FROM c""")
def text_cleaning(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(T.clean_text("text").cast("binary"), 256).alias("cleaned"))


@query(r"""
SELECT doc_id, regexp_matches(text, '(^|[^0-9.])7($|[^0-9.]|\.$|\.[^0-9])') AS seven, regexp_matches(text, '(^|[^A-Za-z])the($|[^A-Za-z²³^/])') AS the FROM documents""")
def literal_support(spark, sf_dir):
    d = t(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", T.literal_supported("text", F.lit("7")).alias("seven"), T.literal_supported("text", F.lit("the")).alias("the"))


@query("""
WITH v AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 60 AS DOUBLE) AS b FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN a ELSE least(a, b) END AS low, CASE WHEN p_partkey % 3 = 0 THEN a ELSE greatest(a, b) END AS high,
CASE p_partkey % 4 WHEN 0 THEN CASE WHEN least(a, b) = greatest(a, b) THEN CAST(CAST(a AS BIGINT) AS VARCHAR) ELSE CAST(CAST(least(a, b) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(greatest(a, b) AS BIGINT) AS VARCHAR) END
WHEN 1 THEN '≤' || CAST(CAST(greatest(a, b) AS BIGINT) AS VARCHAR) WHEN 2 THEN '≥' || CAST(CAST(least(a, b) AS BIGINT) AS VARCHAR) END AS shown,
CASE p_partkey % 4 WHEN 0 THEN CASE WHEN a = b THEN 'exact' ELSE 'range' END WHEN 1 THEN 'upper_bound' WHEN 2 THEN 'lower_bound' ELSE 'missing' END AS qualifier FROM v""")
def range_texts(spark, sf_dir):
    from ..functions.quantities import interval_qualifier

    p = t(spark, sf_dir, "part").withColumn("a", F.col("p_size").cast("double")).withColumn("b", (F.col("p_partkey") % 60).cast("double"))
    text = F.concat(F.lit("width "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(" ～ "), (F.col("p_partkey") % 60).cast("string"))), F.lit(" m"))
    r, k = T.first_range(text), F.col("p_partkey") % 4
    low, high = F.when(k.isin(0, 2), F.least("a", "b")), F.when(k.isin(0, 1), F.greatest("a", "b"))
    return p.select("p_partkey", r["low"].alias("low"), r["high"].alias("high"), V.interval_text(low, high).alias("shown"), interval_qualifier(low, high).alias("qualifier"))


_POLAR = ("未见裂缝，坡面稳定", "坡面可能发生裂缝", "坡顶裂缝发育", "裂缝未见扩大，但裂缝有延伸", "通过计算裂缝稳定；坡脚裂缝", "无明显裂缝；降雨后裂缝，渗水", "没有变形")


@query(f"""SELECT c_custkey, {_pick('c_custkey', '2', '1', '1', '2', '1', '3', '1')} AS n_clauses, {_pick('c_custkey', '0', '0', '1', '1', '1', '1', '0')} AS n_affirmed FROM customer""")
def clause_mentions(spark, sf_dir):
    """Clauses of a text, and those that affirm a crack: not negated, foretold or computed."""
    c = t(spark, sf_dir, "customer").withColumn("clauses", T.clauses(_of("c_custkey", *_POLAR)))
    hits = F.filter("clauses", lambda x: T.positive_mention(x, "裂缝"))
    return c.select("c_custkey", F.size("clauses").alias("n_clauses"), F.size(hits).alias("n_affirmed"))


_ALARMS = ("坡体滑动明显", "未见滑动", "无滑动，局部坍塌", "未发现任何滑动迹象", "未见坍塌，滑动加剧", "否认有人员伤亡；坍塌", "正常")


@query(f"""SELECT c_custkey, {_pick('c_custkey', "'滑动'", "''", "'坍塌'", "''", "'滑动'", "'坍塌'", "''")} AS alarms FROM customer""")
def alarms_affirmed(spark, sf_dir):
    c = t(spark, sf_dir, "customer").withColumn("s", _of("c_custkey", *_ALARMS))
    return c.select("c_custkey", F.array_join(T.alarm_terms("s", ["滑动", "坍塌"]), "、").alias("alarms"))


@query(f"""SELECT c_custkey, {_pick('c_custkey', "'岩质崩塌'", "'崩塌、滑坡'", "''", "'滑坡'")} AS label, {_pick('c_custkey', "'岩质崩塌'", "'崩塌|滑坡'", "''", "'滑坡'")} AS longest, {_pick('c_custkey', "'崩塌|岩质崩塌'", "'崩塌|滑坡'", "''", "'滑坡'")} AS listed FROM customer""")
def hazard_labels(spark, sf_dir):
    """Terms of a text, those found longest first, and labels that aren't part of another."""
    c = t(spark, sf_dir, "customer").withColumn("s", _of("c_custkey", "岩质崩塌", "崩塌和滑坡", "稳定", "滑坡"))
    terms = ["崩塌", "滑坡", "岩质崩塌"]
    return c.select("c_custkey", T.hazard_label(T.terms_in("s", terms)).alias("label"), F.array_join(T.terms_in("s", terms, longest_first=True), "|").alias("longest"), F.array_join(T.terms_in("s", terms), "|").alias("listed"))


@query("""
WITH b AS (SELECT o_orderkey AS k, CAST(o_orderkey % 7 AS DOUBLE) AS l, CAST(o_custkey % 5 AS DOUBLE) AS tp, CAST(o_orderkey % 11 AS DOUBLE) AS r, CAST(o_custkey % 13 AS DOUBLE) AS bt FROM orders),
n AS (SELECT k, least(l, r) AS x0, least(tp, bt) AS y0, greatest(l, r) AS x1, greatest(tp, bt) AS y1 FROM b),
o AS (SELECT *, greatest(0, least(x1, 6) - greatest(x0, 2)) * greatest(0, least(y1, 8) - greatest(y0, 3)) AS shared, (x1 - x0) * (y1 - y0) AS area FROM n)
SELECT k, x0, y0, x1, y1, x0 <= 6 AND 2 <= x1 AND y0 <= 8 AND 3 <= y1 AS meets, x0 >= 2 AND y0 >= 3 AND x1 <= 6 AND y1 <= 8 AS inside, CASE WHEN area > 0 THEN round(shared / area, 9) ELSE 0 END AS share,
least(x0, 2) AS ux0, greatest(y1, 8) AS uy1, round((4 * (x0 - 1) - (y0 - 3)) / 5, 9) AS px, round(((y0 - 3) + (x0 - 1)) / 5, 9) AS py FROM o""")
def rectangles(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.array(*[x.cast("double") for x in (F.col("o_orderkey") % 7, F.col("o_custkey") % 5, F.col("o_orderkey") % 11, F.col("o_custkey") % 13)]).alias("box"))
    fixed = F.array(*[F.lit(x) for x in (2.0, 3.0, 6.0, 8.0)])
    r, u = V.rectangle("box"), V.rectangle_union(F.array(V.rectangle("box"), fixed))
    # x' = x + y + 1, y' = -x + 4 y + 3
    a, b = V.project_point(F.get(r, F.lit(0)), F.get(r, F.lit(1)), F.array(*[F.lit(v) for v in (1.0, -1.0, 1.0, 4.0, 1.0, 3.0)]))
    return o.select("k", *[F.get(r, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], V.rectangles_meet("box", fixed).alias("meets"), V.rectangle_inside("box", fixed).alias("inside"), F.round(V.overlap_share("box", fixed), 9).alias("share"), F.get(u, F.lit(0)).alias("ux0"), F.get(u, F.lit(3)).alias("uy1"), F.round(a, 9).alias("px"), F.round(b, 9).alias("py"))


@query("""
SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 7 WHEN 1 THEN 0 WHEN 2 THEN 4 WHEN 3 THEN NULL ELSE least(3, 7) END AS n_pages,
CASE WHEN o_custkey % 3 = 0 THEN o_orderdate END AS stamp, CASE WHEN o_custkey % 4 <> 1 THEN CAST(o_orderkey AS DOUBLE) + 0.5 END AS total, o_custkey % 4 = 2 AS equal, o_custkey % 2 = 0 AS same,
round(CASE WHEN o_custkey % 2 = 0 THEN 2 / 4.0 ELSE 0 END, 6) AS broken FROM orders""")
def parsed_values(spark, sf_dir):
    """Page selections, times with and without zone, numbers between commas, tolerant equality, broken characters."""
    o = t(spark, sf_dir, "orders")
    pages = T.pages_selected(_of("o_custkey", "all", "none", "1-3, 5", "1-", "3-1"), F.lit(7))
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), _of("o_custkey", "", "Z", "+08:00"))
    parts = V.parse_components(F.concat(F.col("o_orderkey").cast("string"), _of("o_custkey", "，0.5", ",nan", ", 0.5", ",0.5")))
    near = F.when(F.col("o_custkey") % 4 == 2, F.lit(1.0 + 5e-7)).when(F.col("o_custkey") % 4 == 1, F.lit(None).cast("double")).when(F.col("o_custkey") % 4 == 3, F.lit(float("nan"))).otherwise(1.1)
    text = _of("o_custkey", "a b c", "abd")
    return o.select("o_orderkey", F.size(pages).alias("n_pages"), V.parse_timestamp(stamp).cast("timestamp").alias("stamp"), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("total"), V.tolerant_equal(near, F.lit(1.0)).alias("equal"), V.same_text(text, F.lit("ab c")).alias("same"), T.mojibake_ratio(_of("o_custkey", "a\ufffdb\ufffd", "abcd")).alias("broken"))


# --- documents -------------------------------------------------------------------------------------------------------

_PAPER = ("1 General {k}", "scope is {k}", "1.1 Terms", "a term", "another", "2 Loads .......... 12", "2 Loads", "y = a + {k} * b", "value > {k} kPa", "2.1.1 Wind", "")


def _papers(spark, sf_dir):
    text = F.lit("\n".join(_PAPER))
    return t(spark, sf_dir, "customer").select("c_custkey", F.replace(text, F.lit("{k}"), F.col("c_custkey").cast("string")).alias("text"))


@query("""SELECT c_custkey, line_no, number, depth, replace(title, '{k}', CAST(c_custkey AS VARCHAR)) AS title FROM customer,
(VALUES (0, '1', 1, 'General {k}'), (2, '1.1', 2, 'Terms'), (6, '2', 1, 'Loads'), (9, '2.1.1', 3, 'Wind')) v(line_no, number, depth, title) WHERE title <> 'General {k}' OR c_custkey > 999""")
def numbered_headings(spark, sf_dir):
    """A number of up to three digits at the end of a line is a page number: such a heading is a table of contents'."""
    return documents.headings(_papers(spark, sf_dir), ["c_custkey"], "text")


@query("""SELECT c_custkey, line_no, number, title, body FROM customer, (VALUES (2, '1.1', 'Terms', 'a term' || chr(10) || 'another' || chr(10) || '2 Loads .......... 12'),
(6, '2', 'Loads', ''), (9, '2.1.1', 'Wind', '')) v(line_no, number, title, b), LATERAL (SELECT CASE WHEN line_no = 6 THEN 'y = a + ' || c_custkey || ' * b' || chr(10) || 'value > ' || c_custkey || ' kPa' ELSE b END AS body)""")
def heading_sections(spark, sf_dir):
    out = documents.sections(_papers(spark, sf_dir), ["c_custkey"], "text")
    return out.where("number <> '1'")


@query("""SELECT c_custkey, line_no, path FROM customer, (VALUES (2, '1.1'), (6, '2'), (9, '2|2.1.1')) v(line_no, path)""")
def heading_owners(spark, sf_dir):
    h = documents.headings(_papers(spark, sf_dir), ["c_custkey"], "text").where("number <> '1'")
    return documents.section_owner(h, ["c_custkey"], "line_no", "number", "depth").select("c_custkey", "line_no", F.array_join("path", "|").alias("path"))


@query("""SELECT c_custkey, line_no, line FROM customer, LATERAL (SELECT 7 AS line_no, 'y = a + ' || c_custkey || ' * b' AS line)""")
def formula_lines(spark, sf_dir):
    return documents.formula_lines(_papers(spark, sf_dir), ["c_custkey"], "text")


@query(f"""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '天然' WHEN 1 THEN '暴雨' END AS condition, CASE c_custkey % 3 WHEN 0 THEN 1.05 WHEN 1 THEN 0.98 END AS factor, CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 0 END AS place FROM customer WHERE c_custkey % 3 < 2
UNION ALL SELECT c_custkey, '饱和', 1.12, 1 FROM customer WHERE c_custkey % 3 = 0""")
def stability_mentions(spark, sf_dir):
    c = t(spark, sf_dir, "customer").withColumn("s", _of("c_custkey", "天然工况下稳定系数为1.05；饱和工况稳定性系数Fs=1.12。", "暴雨时Fs为0.98", "稳定"))
    return documents.stability_mentions(c, ["c_custkey"], "s")


@query("""SELECT c_custkey, place, type, clause FROM customer, (VALUES (0, 0, '裂缝', '坡顶裂缝发育'), (0, 1, '渗水', '坡脚渗水'), (2, 0, '渗水', '渗水'), (2, 1, '裂缝', '裂缝')) v(m, place, type, clause) WHERE c_custkey % 3 = m""")
def affirmed_observations(spark, sf_dir):
    c = t(spark, sf_dir, "customer").withColumn("s", _of("c_custkey", "坡顶裂缝发育，坡脚渗水", "未见裂缝和渗水", "渗水，裂缝，可能裂缝"))
    return documents.observations(c, ["c_custkey"], "s", {"裂缝": ["裂缝"], "渗水": ["渗水"]}, most=2)


@query("""SELECT doc_id, len(regexp_extract_all(text, '[^.!?\n]*[.!?\n]|[^.!?\n]+')) AS n, text AS joined FROM documents WHERE text <> '' AND NOT regexp_matches(text, '[。；;]')""")
def lossless_pieces(spark, sf_dir):
    d = t(spark, sf_dir, "documents").where("text <> '' and not regexp_like(text, '[。；;]')").withColumn("p", documents.text_pieces("text"))
    return d.select("doc_id", F.size("p").cast("long").alias("n"), F.array_join("p", "").alias("joined"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS k, o_orderkey AS i, 1 + o_orderkey % 7 AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
f AS (SELECT k, i, n, r, n AS used, 0 AS batch FROM o WHERE r = 1 UNION ALL SELECT o.k, o.i, o.n, o.r, CASE WHEN f.used + o.n > 10 THEN o.n ELSE f.used + o.n END, CASE WHEN f.used + o.n > 10 THEN f.batch + 1 ELSE f.batch END FROM f JOIN o ON o.k = f.k AND o.r = f.r + 1)
SELECT k AS o_custkey, i AS o_orderkey, batch FROM f""")
def budget_batches(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (1 + F.col("o_orderkey") % 7).alias("n"))
    return documents.pack_pieces(o, ["o_custkey"], "o_orderkey", "n", 10).select("o_custkey", "o_orderkey", "batch")


@query("""SELECT c_custkey, c_custkey % 3 <> 2 AS located FROM customer""")
def quotes_located(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    pages = c.select("c_custkey", F.concat(F.lit("height "), "c_custkey", F.lit(" m\nat the  toe")).alias("text"))
    quotes = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("height"), "c_custkey", F.lit("m"))).when(F.col("c_custkey") % 3 == 1, "m at the\ttoe").otherwise("m of the toe").alias("quote"))
    return documents.quote_located(quotes, pages, ["c_custkey"], "quote", "text").select("c_custkey", "located")


@query("""WITH q AS (SELECT *, substr(lower(replace(p_name, ' ', '')), 1, 5) AS q FROM part) SELECT arg_min(p_partkey, p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM q GROUP BY q""")
def quote_deduplication(spark, sf_dir):
    return documents.deduplicate_quotes(t(spark, sf_dir, "part"), "p_name", ["p_partkey"], width=5).select("p_partkey", "p_name")


@query("""SELECT p_partkey, CASE WHEN p_type LIKE '%ECON%' THEN 'economy' WHEN p_name LIKE '%ring%' THEN 'ring' ELSE 'other' END AS scope FROM part""")
def first_class_of_text(spark, sf_dir):
    p = t(spark, sf_dir, "part").withColumn("s", F.concat_ws(" ", "p_type", "p_name"))
    return p.select("p_partkey", documents.classify_first("s", [("economy", "ECON"), ("ring", "ring")], "other").alias("scope"))


@query("""SELECT p_name, CASE WHEN contains(lower(p_name), 'small') THEN 'small things' WHEN contains(lower(p_name), 'ring') THEN 'rings' ELSE 'rest' END AS profile FROM (SELECT DISTINCT p_name FROM part)""")
def source_profiles(spark, sf_dir):
    profiles = spark.createDataFrame([("small things", "Small", 1), ("rings", "ring", 2)], "profile string, pattern string, priority int")
    return documents.catalogue_sources(t(spark, sf_dir, "part").select("p_name").distinct(), profiles, "p_name", fallback="rest").select("p_name", "profile")


@query("""SELECT p_partkey, r AS row_no, "column", value FROM part, LATERAL (VALUES (0, 'size', CAST(p_size AS VARCHAR)), (0, 'brand', p_brand), (1, 'size', CASE WHEN p_partkey % 2 = 0 THEN '≥ 5' END)) v(r, "column", value) WHERE value IS NOT NULL""")
def table_cell_rules(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    rows = F.array(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")), F.create_map(F.lit("size"), F.when(F.col("p_partkey") % 2 == 0, "≥ 5").otherwise(" "), F.lit("brand"), F.lit("")))
    return documents.table_rules(p.select("p_partkey", rows.alias("rows")), ["p_partkey"], "rows")


# --- coverage --------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 1 THEN '' ELSE 'p' END AS path, CASE WHEN l_returnflag = 'A' THEN 'sound' ELSE 'image' END AS type, l_linenumber AS page, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_suppkey + CASE WHEN l_suppkey % 9 = 1 THEN 1000000 ELSE 0 END END AS document_id, l_partkey % 4 = 0 AS bad FROM lineitem)
SELECT id, 'path_missing' AS issue, 'error' AS severity FROM a WHERE path = '' UNION ALL SELECT id, 'type_unknown', 'error' FROM a WHERE type = 'sound' UNION ALL SELECT id, 'hash_malformed', 'error' FROM a WHERE bad
UNION ALL SELECT id, 'document_unknown', 'error' FROM a WHERE document_id >= 1000000 UNION ALL SELECT id, 'page_out_of_range', 'error' FROM a WHERE document_id < 1000000 AND page > 5 UNION ALL SELECT id, 'document_unlinked', 'warning' FROM a WHERE document_id IS NULL""")
def asset_checks(spark, sf_dir):
    n = F.col("l_suppkey") % 9
    a = t(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") == 1, "").otherwise("p").alias("path"), F.when(F.col("l_returnflag") == "A", "sound").otherwise("image").alias("type"), F.col("l_linenumber").alias("page"),
        F.when(n != 0, F.col("l_suppkey") + F.when(n == 1, 1000000).otherwise(0)).alias("document_id"), F.when(F.col("l_partkey") % 4 == 0, "ABC").otherwise(F.sha2(F.col("l_partkey").cast("string"), 256)).alias("sha256"),
    )
    return coverage.asset_issues(a, t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(5).alias("pages")))


@query("""WITH c AS (SELECT 'c' || CAST(o_orderkey - o_orderkey % 50 // 49 AS VARCHAR) AS case_id, CASE WHEN o_orderkey % 40 = 3 THEN 'x' || o_orderkey END AS parent, o_custkey AS g, CASE WHEN o_orderkey % 10 < 9 THEN 'train' ELSE 'test' END AS split FROM orders)
SELECT 'duplicate_case' AS "check", case_id AS item FROM c GROUP BY case_id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'unknown_parent', parent FROM c WHERE parent IS NOT NULL AND parent NOT IN (SELECT case_id FROM c)
UNION ALL SELECT 'group_crosses_splits', CAST(g AS VARCHAR) FROM c GROUP BY g HAVING count(DISTINCT split) > 1""")
def case_set_violations(spark, sf_dir):
    k = F.col("o_orderkey")
    c = t(spark, sf_dir, "orders").select(F.concat(F.lit("c"), (k - F.when(k % 50 == 49, 1).otherwise(0)).cast("string")).alias("case_id"), F.when(k % 40 == 3, F.concat(F.lit("x"), k.cast("string"))).alias("parent_case_id"), F.col("o_custkey").cast("string").alias("source_group_id"), F.when(k % 10 < 9, "train").otherwise("test").alias("split"))
    return coverage.case_violations(c)


@query("""WITH p AS (SELECT o_custkey, string_agg(o_orderstatus || ':' || n, ',' ORDER BY o_orderstatus) AS types FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1),
k AS (SELECT o_custkey, string_agg(o_orderpriority || ':' || n, ',' ORDER BY o_orderpriority) AS tasks FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1)
SELECT c_name AS file_name, c_custkey AS document_id, types, tasks FROM customer LEFT JOIN p ON p.o_custkey = c_custkey LEFT JOIN k ON k.o_custkey = c_custkey""")
def file_inventory(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    pages = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("page_type"))
    tasks = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("status"))
    out = coverage.inventory(c.select(F.col("c_name").alias("file_name")), c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("file_name")), pages, tasks)
    shown = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return out.select("file_name", "document_id", shown("page_types").alias("types"), shown("task_statuses").alias("tasks"))


@query("""SELECT o_custkey AS page, count(*) AS units, count(*) FILTER (o_orderkey % 2 = 0) AS attributed, count(*) FILTER (o_orderkey % 3 = 0) AS cited, count(*) FILTER (o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0) AS unassigned FROM orders GROUP BY ALL""")
def page_source_accounting(spark, sf_dir):
    u = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("page"))
    twice = lambda df: df.unionByName(df)
    return coverage.source_accounting(u, twice(u.where("unit_id % 2 = 0")), twice(u.where("unit_id % 3 = 0")))


@query("""SELECT DISTINCT o_custkey, CAST(o_orderkey AS DOUBLE) AS number FROM orders WHERE o_orderkey % 4 <> 0""")
def unused_numbers(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    texts = o.select("o_custkey", F.concat(F.lit("no. "), "o_orderkey", F.lit(" seen")).alias("text"))
    return coverage.numeric_residuals(texts, o.where("o_orderkey % 4 = 0"), "o_custkey", "text", "o_orderkey")


# --- screening -------------------------------------------------------------------------------------------------------


@query(f"""SELECT c_custkey, {_pick('c_custkey', "'天然'", "'饱和'", "'暴雨'", "''")} AS condition, {_pick('c_custkey', "'exact'", "'mismatch'", "'page_only'", "'missing'", "'exact'", "'mismatch'")} AS alignment FROM customer""")
def evidence_alignments(spark, sf_dir):
    c = t(spark, sf_dir, "customer").withColumn("c", _of("c_custkey", "天然 工况", "饱水状态", "暴雨", ""))
    quote = F.when(F.col("c_custkey") % 6 != 3, _of("c_custkey", "系数 1.05，稳定", "系数 1.051，稳定", "  ", "", "1.05", "1.05，欠稳定性"))
    c = c.withColumn("factor", F.lit(1.05)).withColumn("status", F.when(F.col("c_custkey") % 6 == 4, "").when(F.col("c_custkey") % 6 == 5, "不稳定").otherwise("稳定")).withColumn("quote", quote)
    return c.select("c_custkey", screening.canonical_condition("c").alias("condition"), screening.evidence_alignment("factor", "status", "quote").alias("alignment"))


@query("""
WITH r AS (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS a, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS d, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS e, l_partkey * 1000 + l_suppkey AS seq FROM lineitem)
SELECT l_orderkey, arg_min(seq, {'a': -a, 'd': -d, 'e': -e, 's': seq}) AS seq FROM r GROUP BY l_orderkey""")
def best_duplicate_records(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem")  # noqa: E741
    rows = l.select("l_orderkey", _of("l_linenumber", "mismatch", "exact", "page_only", "missing").alias("alignment"), (F.col("l_returnflag") == "A").alias("det"), F.when(F.col("l_linestatus") == "F", "quote").otherwise("").alias("evidence"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"))
    return screening.best_duplicates(rows, ["l_orderkey"], "alignment", "det", "evidence", "seq").select("l_orderkey", "seq")


@query("""
WITH h AS (SELECT c_custkey, unnest(CASE c_custkey % 3 WHEN 0 THEN ['collapse'] WHEN 1 THEN ['slide', 'collapse'] ELSE ['none'] END) AS profile FROM customer)
SELECT c_custkey, profile, CASE WHEN c_custkey % 2 = 0 THEN CASE profile WHEN 'collapse' THEN 'joints' ELSE 'depth' END ELSE CASE profile WHEN 'collapse' THEN 'height|joints' ELSE 'depth|height' END END AS missing FROM h WHERE profile <> 'none'""")
def hazard_profile_gaps(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", F.array(*[_of("c_custkey", *x) for x in (("rock collapse", "landslide", "stable"), ("collapse", "rock collapse", "calm"))]).alias("labels"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("height"))).otherwise(F.array().cast("array<string>")).alias("present"))
    profiles = spark.createDataFrame([("collapse", ["collapse", "rockfall"], ["joints", "height"]), ("slide", ["slide"], ["depth", "height"])], "profile string, aliases array<string>, inputs array<string>")
    return screening.hazard_profiles(c, profiles, "c_custkey", "labels", "present").select("c_custkey", "profile", F.array_join("missing_inputs", "|").alias("missing"))


@query("""
WITH g(code, priority, preferred, why) AS (VALUES ('1-URGENT', 'P1', 2, 'load'), ('2-HIGH', 'P1', 1, 'water'), ('3-MEDIUM', 'P2', 1, 'size')),
f AS (SELECT o_custkey, o_orderpriority AS code, 'L' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS label, CASE o_orderstatus WHEN 'F' THEN 'available' WHEN 'O' THEN 'interface_reserved' ELSE 'missing' END AS status FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY priority, preferred, label, code) AS place FROM f JOIN g USING (code) WHERE status <> 'available')
SELECT o_custkey, label, place, CASE WHEN status = 'interface_reserved' THEN 'interface_pending' ELSE 'slope_data_missing' END AS gap_scope, why FROM r WHERE place <= 5""")
def critical_gaps(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "available").when(F.col("o_orderstatus") == "O", "interface_reserved").otherwise("missing")
    f = t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("code"), F.concat(F.lit("L"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("label"), status.alias("status"))
    guidance = spark.createDataFrame([("1-URGENT", "P1", 2, "load"), ("2-HIGH", "P1", 1, "water"), ("3-MEDIUM", "P2", 1, "size")], "code string, priority string, preferred int, why string")
    return screening.critical_gaps(f, guidance, "o_custkey", n=5).select("o_custkey", "label", F.col("place").cast("long").alias("place"), "gap_scope", "why")


@query("""
WITH r AS (SELECT DISTINCT o_custkey, 'R' || (o_orderkey % 40) AS rule_id, 'title ' || (o_orderkey % 40) AS title FROM orders WHERE o_orderkey % 40 < 30), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY rule_id) AS k FROM r)
SELECT o_custkey, rule_id, title FROM n WHERE k <= 8""")
def rule_reference_lists(spark, sf_dir):
    rules = spark.createDataFrame([(k, f"R{k}", f"title {k}") for k in range(30)], "topic long, rule_id string, title string")
    return screening.rule_references(t(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 40).alias("topic")), rules, "o_custkey", "topic")


@query("""SELECT c_custkey, false AS ready, concat_ws('|', CASE WHEN c_custkey % 2 = 1 THEN 'method_formula_approved' END, CASE WHEN c_custkey % 3 <> 0 THEN 'full_section_or_block_geometry' END, CASE WHEN c_nationkey % 2 <> 0 THEN 'material_strength_parameters' END, CASE WHEN c_acctbal <= 0 THEN 'slip_surface_or_structural_model' END, 'solver_implemented', 'reference_case_verified') AS blocking, c_custkey % 5 = 0 AS basic FROM customer""")
def calculation_readiness(spark, sf_dir):
    yes = lambda e: F.expr(e)
    r = screening.calculation_readiness(yes("c_custkey % 2 = 0"), yes("case when c_custkey % 3 = 0 then true end"), yes("c_custkey % 5 = 0"), yes("c_nationkey % 2 = 0"), yes("c_acctbal > 0"), F.lit(True), F.lit(None).cast("boolean"))
    return t(spark, sf_dir, "customer").select("c_custkey", r["ready"].alias("ready"), F.array_join(r["blocking"], "|").alias("blocking"), r["basic_height_and_gradient"].alias("basic"))


# --- page geometry ---------------------------------------------------------------------------------------------------

_BOXED = "o_custkey AS page, o_orderkey AS id, CAST(o_orderkey % 3 * 300 AS DOUBLE) AS x0, CAST(floor(o_totalprice) AS BIGINT) % 700 + 0.0 AS y0"


def _boxes(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    x, y = (F.col("o_orderkey") % 3 * 300).cast("double"), (F.floor("o_totalprice").cast("long") % 700).cast("double")
    return o.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("id"), F.array(x, y, x + 100, y + 20).alias("bbox"))


@query(f"""WITH b AS (SELECT {_BOXED} FROM orders) SELECT id, page, CAST(floor(x0 / 300) AS INTEGER) AS panel, y0 AS y FROM b""")
def reading_order(spark, sf_dir):
    return layout.reading_order(_boxes(spark, sf_dir), "page", "bbox", panel_width=300.0).select("id", "page", "panel", "y")


@query(f"""WITH b AS (SELECT {_BOXED} FROM orders) SELECT a.page, tb.id AS table_id, a.id AS block_id, tb.y0 - (a.y0 + 20) AS distance FROM b a JOIN b tb ON a.page = tb.page AND tb.id % 2 = 0 AND a.id % 2 = 1 AND tb.y0 - (a.y0 + 20) BETWEEN 0 AND 110""")
def blocks_above_tables(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return layout.blocks_above(b.where("id % 2 = 1"), b.where("id % 2 = 0"), ["page"])


@query(f"""WITH b AS (SELECT {_BOXED} FROM orders) SELECT DISTINCT a.id AS block_id FROM b a JOIN b tb ON a.page = tb.page AND tb.id % 2 = 0 AND a.id % 2 = 1 AND a.x0 + 50 BETWEEN tb.x0 AND tb.x0 + 100 AND a.y0 + 10 BETWEEN tb.y0 AND tb.y0 + 100""")
def blocks_in_tables(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    side = lambda i: F.get("bbox", F.lit(i))
    return layout.blocks_in_tables(b.where("id % 2 = 1"), b.where("id % 2 = 0").withColumn("bbox", F.array(side(0), side(1), side(2), side(1) + 100)), ["page"])


@query("""SELECT c_custkey AS page, 'a' AS first_id, 'b' AS second_id, '坡面防护工程' AS text, '10.0,18.0,90.0,39.0' AS box FROM customer WHERE c_custkey % 4 = 0""")
def wrapped_label_lines(spark, sf_dir):
    """A label and the centred line under it; not one far below, off centre, or with two candidates."""
    second = [(30.0, 29.0), (30.0, 49.0), (60.0, 29.0), (30.0, 29.0)]
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"))
    at = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in second]), (F.col("page") % 4 + 1).cast("int"))
    item = lambda i, text, x, y, wide, high: c.select("page", F.lit(i).alias("id"), F.lit(text).alias("text"), F.array(x, y, x + wide, y + high).alias("bbox"))
    out = item("a", "坡面防护", F.lit(10.0), F.lit(18.0), 80.0, 10.0).unionByName(item("b", "工程", at(0), at(1), 40.0, 10.0))
    out = out.unionByName(item("c", "措施", F.lit(30.0), F.lit(29.0), 40.0, 10.0).where("page % 4 = 3"))
    found = layout.wrapped_labels(out, ["page"])
    return found.select("page", "first_id", "second_id", "text", F.array_join(F.transform("bbox", lambda x: x.cast("string")), ",").alias("box"))


@query(f"""WITH b AS (SELECT {_BOXED} FROM orders), h AS (SELECT r.id AS rebuilt_id, n.id AS native_id, count(*) OVER (PARTITION BY r.id) AS k FROM b r JOIN b n ON r.page = n.page AND n.id % 2 = 0
AND greatest(0, least(r.x0 + 100, n.x0 + 100) - greatest(r.x0, n.x0)) * greatest(0, least(r.y0 + 20, n.y0 + 60) - greatest(r.y0, n.y0)) >= 1800 WHERE r.id % 2 = 1) SELECT rebuilt_id, native_id FROM h WHERE k = 1""")
def repaired_text_links(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    side = lambda i: F.get("bbox", F.lit(i))
    return layout.repaired_links(b.where("id % 2 = 0").withColumn("bbox", F.array(side(0), side(1), side(2), side(1) + 60)), b.where("id % 2 = 1"), ["page"])


@query("""SELECT l_partkey AS cell, string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), '|' ORDER BY CAST(l_orderkey AS VARCHAR)) AS facts FROM lineitem GROUP BY l_partkey""")
def cell_reverse_index(spark, sf_dir):
    f = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("fact")).agg(F.collect_list("l_partkey").alias("cells"))
    return layout.reverse_index(f, "fact", "cells").select("cell", F.array_join("facts", "|").alias("facts"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey AS d, o_orderkey % 5 AS p FROM orders), l AS (SELECT DISTINCT o_custkey AS d, o_orderkey % 5 AS f, o_orderkey % 4 AS g FROM orders WHERE abs(o_orderkey % 5 - o_orderkey % 4) <= 1)
SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.d = b.d AND a.p = b.p AND a.id <> b.id UNION SELECT a.id, b.id FROM s a JOIN l ON a.d = l.d AND a.p = l.f JOIN s b ON b.d = l.d AND b.p = l.g AND a.id <> b.id""")
def related_source_pairs(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    s = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 5).alias("page"))
    links = o.select(F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 5).alias("from_page"), (F.col("o_orderkey") % 4).alias("to_page")).distinct()
    return layout.related_sources(s, links, "page", within=1)


# --- assessment, review and evaluation -------------------------------------------------------------------------------


@query("""WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS s, CASE c_nationkey % 2 WHEN 0 THEN true END AS p FROM customer)
SELECT c_custkey, CASE WHEN s = false THEN 'inapplicable' WHEN s IS NULL OR p IS NULL THEN 'unknown' ELSE 'applicable' END AS overall, CASE WHEN s IS NULL THEN 'unknown' WHEN s THEN 'applicable' ELSE 'inapplicable' END AS subject,
concat_ws('|', CASE WHEN s IS NULL OR NOT s THEN 'subject' END, CASE WHEN p IS NULL THEN 'period' END) AS excluded FROM c""")
def fact_applicability(spark, sf_dir):
    checks = {"subject": F.expr("case c_custkey % 3 when 0 then true when 1 then false end"), "period": F.expr("case c_nationkey % 2 when 0 then true end")}
    a = assessment.applicability(checks)
    return t(spark, sf_dir, "customer").select("c_custkey", a["overall"].alias("overall"), a["subject"].alias("subject"), F.array_join(assessment.scope_exclusions(checks), "|").alias("excluded"))


@query("""
WITH RECURSIVE m AS (SELECT o_custkey AS k, o_orderkey AS i, 1 + o_orderkey % 6 AS n, CASE WHEN o_orderstatus = 'F' THEN 'status' WHEN o_orderpriority = '5-LOW' THEN 'rank' END AS why, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
f AS (SELECT k, 0 AS r, 12 AS room, CAST(NULL AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS why, false AS selected FROM (SELECT DISTINCT k FROM m) UNION ALL
SELECT m.k, m.r, CASE WHEN m.why IS NULL AND m.n <= f.room THEN f.room - m.n ELSE f.room END, m.i, m.why, m.why IS NULL AND m.n <= f.room FROM f JOIN m ON m.k = f.k AND m.r = f.r + 1)
SELECT k AS o_custkey, i AS o_orderkey, why AS excluded, selected FROM f WHERE r > 0""")
def evidence_packets(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", (1 + F.col("o_orderkey") % 6).alias("n"))
    out = assessment.evidence_packet(o, "o_custkey", {"status": F.col("o_orderstatus") != "F", "rank": F.col("o_orderpriority") != "5-LOW"}, ["o_orderkey"], "n", 12)
    return out.select("o_custkey", "o_orderkey", "excluded", "selected")


@query("""WITH s AS (SELECT o_custkey AS case_id, 'p' || o_orderkey % 3 AS path, 'h' || o_orderkey % 6 AS sha256, o_orderstatus AS purpose, year(o_orderdate) AS period, 'x' AS scenario FROM orders)
SELECT case_id, 'path_with_several_contents' AS problem, path AS item FROM s GROUP BY case_id, path HAVING count(DISTINCT sha256) > 1 UNION ALL SELECT case_id, 'several_purposes', 'purpose' FROM s GROUP BY case_id HAVING count(DISTINCT purpose) > 1
UNION ALL SELECT case_id, 'several_periods', 'period' FROM s GROUP BY case_id HAVING count(DISTINCT period) > 1""")
def composition_problems(spark, sf_dir):
    k = F.col("o_orderkey")
    s = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("path"), F.concat(F.lit("h"), (k % 6).cast("string")).alias("sha256"), F.col("o_orderstatus").alias("purpose"), F.year("o_orderdate").alias("period"), F.lit("x").alias("scenario"))
    return assessment.compose_problems(s)


@query("""SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN 'pass' WHEN 1 THEN 'wrong' WHEN 2 THEN 'missing' WHEN 3 THEN 'missing_owner' WHEN 4 THEN 'ambiguous_owner' WHEN 5 THEN 'violation' WHEN 6 THEN 'conflict' ELSE 'pass' END AS status FROM customer""")
def gold_fact_status(spark, sf_dir):
    """Gold facts against a graph: equal, wrong and missing values, owners unknown or ambiguous, facts that should be
    absent, and several nodes of which one fits, which is a conflict unless the fact is one of a collection."""
    c, k = t(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey")
    name = lambda p: F.concat(F.lit(p), k.cast("string"))
    gold = c.select(k.alias("id"), name("k").alias("owner_key"), F.lit("has").alias("relation"), F.lit("Size").alias("node_type"), F.lit("height").alias("field"), F.concat((k % 50).cast("string"), F.lit(".0")).alias("expected"), (k % 8 == 5).alias("expect_absent"), (k % 8 == 7).alias("collection_member"))
    owners = c.where(k % 8 != 3).select(name("k").alias("owner_key"), name("o").alias("owner_id")).unionByName(c.where(k % 8 == 4).select(name("k").alias("owner_key"), name("o2_").alias("owner_id")))
    value = F.when(k % 8 == 1, "999").otherwise((k % 50).cast("string"))
    nodes = c.where(k % 8 != 2).select(name("n").alias("id"), F.lit("Size").alias("type"), F.lit("height").alias("field"), value.alias("value"))
    nodes = nodes.unionByName(c.where(k % 8 >= 6).select(name("m").alias("id"), F.lit("Size").alias("type"), F.lit("height").alias("field"), F.lit("777").alias("value")))
    edges = c.select(name("o").alias("src"), name("n").alias("dst"), F.lit("has").alias("relation")).unionByName(c.select(name("o").alias("src"), name("m").alias("dst"), F.lit("has").alias("relation")))
    return evaluation.gold_facts(gold, nodes, owners, edges).select("id", "status")


@query("""
WITH r AS (SELECT o_custkey AS k, o_orderstatus AS label, o_orderkey % 4 AS who, o_orderpriority = '5-LOW' AS v2, o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS ok FROM orders),
a AS (SELECT k, count(DISTINCT who) FILTER (ok) AS reviewers, count(DISTINCT label) FILTER (ok) AS labels, count(DISTINCT v2) FILTER (ok) AS versions, count(*) FILTER (NOT ok) AS unusable, min(label) FILTER (ok) AS label FROM r GROUP BY k),
b AS (SELECT *, concat_ws('|', CASE WHEN reviewers < 2 THEN 'too_few_independent_reviews' END, CASE WHEN labels > 1 THEN 'reviewers_disagree' END, CASE WHEN versions > 1 THEN 'scheme_versions_differ' END) AS reasons FROM a)
SELECT k, unusable, reasons, reasons = '' AS passed, CASE WHEN reasons = '' THEN label END AS label FROM b""")
def label_gates(spark, sf_dir):
    k = F.col("o_orderkey")
    r = t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("label"), (k % 4).cast("string").alias("reviewer_id"), F.when(k % 5 == 0, "guest").otherwise("expert").alias("reviewer_role"), F.lit("h").alias("input_sha256"), F.lit("h").alias("current_sha256"),
        F.when(F.col("o_orderpriority") == "5-LOW", "2").otherwise("1").alias("scheme_version"), F.when(k % 7 == 0, "soon").otherwise("2026-01-05").alias("reviewed_at"), F.array(F.lit("e")).alias("evidence_ids"),
    )
    return evaluation.label_gate(r, "k").select("k", "unusable", F.array_join("reasons", "|").alias("reasons"), "passed", "label")


@query("""SELECT o_custkey AS point_id, bool_and(o_orderkey % 3 <> 0 AND o_orderkey % 11 <> 0) AS passed, count(*) AS checks FROM orders GROUP BY o_custkey""")
def regression_point_results(spark, sf_dir):
    k = F.col("o_orderkey")
    o = t(spark, sf_dir, "orders")
    points = o.select(F.col("o_custkey").alias("point_id"), k.alias("page"), F.lit("size").alias("field"), F.lit("v").alias("expected"))
    facts = o.where(k % 11 != 0).select(k.alias("page"), F.lit("size").alias("field"), F.lit("v").alias("value"), F.when(k % 3 == 0, "").otherwise("q").alias("evidence"))
    return evaluation.regression_points(points, facts)


@query("""WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) SELECT o_custkey, o_orderkey, edit_id FROM n, (VALUES ('drop'), ('swap'), ('blur')) e(edit_id) WHERE r <= 2""")
def edit_scenarios(spark, sf_dir):
    edits = spark.createDataFrame([("drop",), ("swap",), ("blur",)], "edit_id string")
    return evaluation.scenarios(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], edits, k=2)


# --- identity, order, graph ------------------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT o_custkey AS k, o_orderstatus AS field, o_orderpriority AS value FROM orders) SELECT k, field, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, count(DISTINCT value) > 1 AS conflict, string_agg(DISTINCT value, '|' ORDER BY value) AS seen FROM r GROUP BY k, field""")
def identity_attributes(spark, sf_dir):
    r = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("field"), F.col("o_orderpriority").alias("value"))
    return identity.reconcile(r, "k", "field", "value").select("k", "field", "value", "conflict", F.array_join("values", "|").alias("seen"))


@query("""SELECT c_custkey AS mention_id, CASE c_custkey % 3 WHEN 2 THEN 'entity_' || substr(sha1('customer|' || lower(replace(c_name, ' ', '')) || '|'), 1, 12) ELSE 'E' || c_custkey END AS entity_id FROM customer""")
def entity_resolution(spark, sf_dir):
    """By id where it is known, else by kind, name and context, else a new entity."""
    c, k = t(spark, sf_dir, "customer"), F.col("c_custkey")
    m = c.select(k.alias("mention_id"), F.when(k % 3 == 0, F.concat(F.lit("E"), k.cast("string"))).when(k % 3 == 2, "unheard").alias("supplied_id"), F.lit("customer").alias("kind"), F.concat(F.upper(F.substring("c_name", 1, 8)), F.lit(" "), F.substring("c_name", 9, 99)).alias("name"), F.lit(None).cast("string").alias("context"))
    known = c.where(k % 3 != 2).select(F.concat(F.lit("E"), k.cast("string")).alias("entity_id"), F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.lit("").alias("context"))
    return identity.resolve_entities(m, known)


@query("""SELECT arg_min(event_id, event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type""")
def distinct_in_order(spark, sf_dir):
    return ordered.distinct_in_order(t(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@query("""SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20""")
def audit_tail(spark, sf_dir):
    return ordered.keep_last(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 20).select("event_id", "user_id")


@query("""
WITH d AS (SELECT c_custkey, sha1(c_name) AS h FROM customer), p AS (SELECT h[1:10] AS p, count(*) AS n, min(c_custkey) AS doc FROM d GROUP BY 1)
SELECT s_suppkey AS asset, doc FROM supplier JOIN customer ON c_custkey = s_suppkey * 3 JOIN p ON p.p = sha1(c_name)[1:10] WHERE n = 1""")
def assets_by_digest(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.sha1(F.col("c_name").cast("binary")).alias("sha"))
    a = t(spark, sf_dir, "supplier").join(c, F.col("doc") == F.col("s_suppkey") * 3).select(F.col("s_suppkey").alias("asset"), F.upper(F.substring("sha", 1, 10)).alias("prefix"))
    return joins.link_by_prefix(a, c, "asset", "prefix", "sha", "doc")


# --- evidence of objects and fields ------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_orderkey % 3 < 2 AND o_custkey % 4 <> 1 AND o_custkey % 5 <> 2 AND o_orderkey % 7 <> 3 AS eligible FROM orders""")
def whole_object_records(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    scope, body, mode = _of("o_orderkey", "整体边坡", "现状边坡", "危岩体"), F.when(F.col("o_custkey") % 4 == 1, "W1").when(F.col("o_custkey") % 4 == 2, ""), F.when(F.col("o_custkey") % 5 == 2, "slide")
    issues = F.when(F.col("o_orderkey") % 7 == 3, F.array(F.lit("x"))).when(F.col("o_orderkey") % 7 == 4, F.array().cast("array<string>"))
    return o.select("o_orderkey", evidence.eligible_whole(scope, body, mode, issues).alias("eligible"))


@query("""SELECT o_orderkey, o_custkey % 2 = 0 AND o_orderkey % 3 <> 2 AND o_orderkey % 5 <> 0 AS stale FROM orders""")
def stale_page_renders(spark, sf_dir):
    k = F.col("o_orderkey")
    name = lambda p: F.concat(F.lit(p), k.cast("string"), F.lit(".PNG"))
    href = F.when(k % 3 == 0, name("./Assets/ocr_pages/")).when(k % 3 == 1, name("out\\assets\\ocr_pages\\")).otherwise(name("photos/"))
    a = t(spark, sf_dir, "orders").select("o_orderkey", href.alias("href"), F.when(F.col("o_custkey") % 2 == 0, "pdf_derived").otherwise("upload").alias("origin"))
    active = a.where(k % 5 == 0).select(F.lower(F.replace("href", F.lit("\\"), F.lit("/"))).alias("href"))
    return evidence.stale_renders(a, active).select("o_orderkey", "stale")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 1 THEN 'checked' ELSE c_mktsegment END AS c_mktsegment, c_acctbal, c_custkey % 3 = 0 AND c_custkey % 4 <> 1 AS reviewed FROM customer""")
def reviewed_values(spark, sf_dir):
    """A review counts only while the scope it was made for is the row's; its nulls change nothing."""
    c, k = t(spark, sf_dir, "customer"), F.col("c_custkey")
    rows = c.withColumn("side", F.when(k % 2 == 0, "left")).select("c_custkey", "c_nationkey", "side", "c_mktsegment", "c_acctbal")
    reviews = rows.where(k % 3 == 0).select("c_custkey", F.when(k % 4 == 1, -1).otherwise(F.col("c_nationkey")).alias("c_nationkey"), "side", F.lit("checked").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    return evidence.reviewed_overlay(rows, reviews, "c_custkey", ["c_nationkey", "side"], ["c_mktsegment", "c_acctbal"]).select("c_custkey", "c_mktsegment", "c_acctbal", "reviewed")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN array_to_string(list_sort(list_distinct([c_nationkey, 3, 12])), '|') WHEN 1 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END AS pages FROM customer""")
def pages_in_nested_json(spark, sf_dir):
    """Pages of nested JSON: numbers and lists at any depth; not fractions, texts, or what a text quotes."""
    c, n = t(spark, sf_dir, "customer"), F.col("c_nationkey").cast("string")
    first = F.concat(F.lit('{"a": {"page": '), n, F.lit(', "b": [{"pages": [3, 12, "x", 1.5]}]}, "page_no": 99}'))
    second = F.concat(F.lit('[{"page" : '), n, F.lit('}, {"page": 1.5}, {"page": true}, {"note": "say \\"page\\": 8, so"}]'))
    third = F.lit('{"page": "7", "pages": [], "other": {"pages": ["1"]}}')
    k = F.col("c_custkey") % 3
    pages = evidence.pages_in_json(F.when(k == 0, first).when(k == 1, second).otherwise(third))
    return c.select("c_custkey", F.array_join(F.transform(pages, lambda p: p.cast("string")), "|").alias("pages"))


@query("""SELECT event_id, user_id FROM events WHERE regexp_matches(props, '"k": 7}') AND contains(lower(props), '"k"')""")
def json_searches(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("j", F.replace("props", F.lit('"k"'), F.lit('"page"')))
    return evidence.search_json(e, "j", page=7, needle='"PAGE"').select("event_id", "user_id")


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 2 THEN 'invalid_parts' WHEN 3 THEN 'parts_do_not_make_the_value' WHEN 4 THEN 'invalid_parts' WHEN 5 THEN 'invalid_parts' END AS problem FROM customer""")
def field_evidence_parts(spark, sf_dir):
    k = F.col("c_custkey") % 6
    strings = lambda *x: F.array(*map(F.lit, x))
    parts = F.when(k == 0, strings("rock fall", "slide（old）")).when(k == 1, strings("rock fall; slide(old)")).when(k == 2, strings("rock fall", "slide(old)")).when(k == 3, strings("rock fall", "slide")).when(k == 4, strings("rock fall", " ")).otherwise(F.array().cast("array<string>"))
    problem = evidence.parts_problem(F.lit("rock fall;slide (old)"), parts, F.when(k == 2, "and").otherwise("；"))
    return t(spark, sf_dir, "customer").select("c_custkey", problem.alias("problem"))


@query("""
WITH f AS (SELECT o_custkey AS k, o_orderkey % 6 AS kind, o_orderkey % 4 AS scope, o_orderkey % 5 AS said FROM orders),
a AS (SELECT k, count(*) FILTER (kind IN (0, 1) AND scope < 2) AS current, count(*) FILTER (kind IN (0, 1) AND scope >= 2) AS historical, count(*) FILTER (kind = 2) AS protection, count(*) FILTER (kind = 3) AS exposure, bool_or(kind = 4 AND scope = 0) AS rock, bool_or(kind = 4 AND scope <> 0) AS unclear,
bool_or(kind IN (0, 1) AND scope < 2 AND said = 1) AS now, bool_or(kind IN (0, 1) AND scope >= 2 AND said = 1) AS before, bool_or(kind = 5) AS candidate FROM f GROUP BY k)
SELECT c_custkey AS k, coalesce(current, 0) AS current, coalesce(historical, 0) AS historical, coalesce(protection, 0) AS protection, coalesce(exposure, 0) AS exposure, concat_ws('|', CASE WHEN rock THEN 'rock' END, CASE WHEN unclear THEN 'unclear' END) AS body_types,
concat_ws('|', CASE WHEN c_custkey % 3 = 0 THEN 'slide' END, CASE WHEN candidate OR c_custkey % 4 = 0 THEN 'fall' END) AS hazards, CASE WHEN c_custkey % 2 = 0 THEN greatest(c_nationkey + 0.0, 12.5) ELSE c_nationkey + 0.0 END AS height,
CASE WHEN coalesce(now, false) OR (c_custkey % 5 = 0 AND c_custkey % 7 = 0) THEN 'crack' ELSE '' END AS observed, CASE WHEN coalesce(before, false) OR (c_custkey % 5 <> 0 AND c_custkey % 7 = 0) THEN 'crack' ELSE '' END AS historical_observed, coalesce(current, 0) > 0 OR c_custkey % 5 = 0 AS dynamic
FROM customer LEFT JOIN a ON k = c_custkey""")
def object_evidence(spark, sf_dir):
    """Facts of objects by kind and time: current and earlier observations, affirmed alarms, hazards, bodies, sizes."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    objects = t(spark, sf_dir, "customer").select(
        k.alias("k"), F.when(k % 3 == 0, "a slide here").alias("summary"), F.when(k % 4 == 0, "fall").alias("hazard_type"), F.when(k % 7 == 0, "a crack").when(k % 7 == 1, "未见crack").alias("deformation"),
        F.col("c_nationkey").cast("string").alias("height"), F.when(k % 2 == 0, "12.5").alias("height_max"), F.lit("nan").alias("gradient"), F.lit(None).cast("string").alias("gradient_max"), (k % 5 == 0).alias("eligible_as_current"),
    )
    kind = _of("o_orderkey", "DeformationObservation", "InspectionRecord", "ProtectionWork", "ExposureObject", "HazardBody", "HazardSusceptibilityAssessment")
    facts = t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("k"), kind.alias("type"), F.when(o % 5 == 1, "crack widened").when(o % 5 == 2, "无crack").otherwise("calm").alias("label"), F.when(o % 4 == 0, "rock").alias("body_type"),
        F.when(o % 4 == 0, "current").when(o % 4 == 2, "historical").alias("temporal_scope"), (o % 4 == 1).alias("current_status_known"), F.array(F.lit("fall")).alias("candidate_hazards"),
    )
    out = evidence.collect(objects, facts, "k", hazards=["slide", "fall"], alarms=["crack"])
    shown = lambda c: F.array_join(c, "|").alias(c)
    return out.select("k", "current", "historical", "protection", "exposure", shown("body_types"), shown("hazards"), "height", shown("observed"), shown("historical_observed"), "dynamic")


# --- graphs, stores and rules ------------------------------------------------------------------------------------------


@query("""
SELECT 0 AS part, '' AS k, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">' AS line UNION ALL SELECT 3, '', '</graph></graphml>'
UNION ALL SELECT 1, 'c' || c_custkey, '<node id="c' || c_custkey || '"><data key="type">Customer</data><data key="label">' || c_name || ' &lt;&quot;&amp;&gt;</data></node>' FROM customer
UNION ALL SELECT 2, 'e' || c_custkey, '<edge id="e' || c_custkey || '" source="c' || c_custkey || '" target="n' || c_nationkey || '"><data key="relation">of</data></edge>' FROM customer""")
def graphml_export(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    nodes = c.select(name("c", "c_custkey").alias("id"), F.lit("Customer").alias("type"), F.concat("c_name", F.lit(' <"&>')).alias("label"))
    edges = c.select(name("e", "c_custkey").alias("id"), name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"), F.lit("of").alias("relation"))
    return graph.graphml_lines(nodes, edges)


@query("""SELECT o_custkey AS id, arg_min(o_orderkey, o_orderkey) AS seq, arg_min(o_orderstatus, o_orderkey) AS label FROM orders GROUP BY o_custkey""")
def first_nodes_win(spark, sf_dir):
    return graph.first_nodes(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("label")), "seq")


@query("""
WITH s AS (SELECT s_suppkey, 'S' || s_suppkey AS id, 'P' || s_nationkey AS pt FROM supplier)
SELECT DISTINCT pt AS src, id AS dst, 'HAS_MONITORING_SERIES' AS relation FROM s UNION SELECT 'site', pt, 'HAS_MONITORING_POINT' FROM s UNION SELECT id, 'mf_' || id, 'DERIVED_FROM' FROM s
UNION SELECT id, 'mq_' || id, 'HAS_QUALITY_REPORT' FROM s UNION SELECT id, 'run1', 'GENERATED_BY' FROM s UNION SELECT 'mq_' || id, 'run1', 'GENERATED_BY' FROM s""")
def series_provenance(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("P"), F.col("s_nationkey").cast("string")).alias("sensor_id"), F.lit("f").alias("file"))
    return series.provenance_graph(s, F.lit("site"), F.lit("run1"))[1]


@query("""SELECT DISTINCT o_orderkey // 2 AS id, 'v' || o_orderkey % 3 AS payload FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0)
EXCEPT SELECT o_orderkey // 2, 'v' || o_orderkey % 3 FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0""")
def rows_to_append(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = t(spark, sf_dir, "orders").select(F.floor(k / 2).alias("id"), F.concat(F.lit("v"), (k % 3).cast("string")).alias("payload"), ((k % 2 == 0) & (k % 5 != 0)).alias("old"))
    return ordered.append_new(rows.where("old").drop("old"), rows.where("not old").drop("old"), "id", "payload")


@query("""SELECT id FROM (SELECT o_orderkey // 2 AS id, o_orderkey % 3 AS v FROM orders) GROUP BY id HAVING count(DISTINCT v) > 1""")
def store_collisions(spark, sf_dir):
    k = F.col("o_orderkey")
    return ordered.version_collisions(t(spark, sf_dir, "orders").select(F.floor(k / 2).alias("id"), (k % 3).alias("payload")), "id", "payload")


@query("""
WITH r AS (SELECT p_partkey, concat_ws('|', CASE WHEN p_partkey % 7 = 0 THEN 'no_conditions' END, CASE WHEN p_partkey % 7 > 0 AND p_partkey % 3 = 0 THEN 'unknown_field' END, CASE WHEN p_partkey % 7 > 0 AND p_partkey % 4 = 0 THEN 'unknown_operator' END,
CASE WHEN p_partkey % 7 > 0 AND p_partkey % 4 <> 0 AND p_partkey % 5 = 0 THEN 'not_a_number' END, CASE WHEN p_size % 2 = 0 THEN 'unknown_output' END) AS why FROM part)
SELECT p_partkey, why, why = '' AS executable, why = '' AND p_partkey % 2 = 0 AS enabled FROM r""")
def normalised_rules(spark, sf_dir):
    k = F.col("p_partkey")
    one = F.struct(F.when(k % 3 == 0, "mass").otherwise("height").alias("field"), F.when(k % 4 == 0, "like").otherwise("gte").alias("operator"), F.when(k % 5 == 0, "inf").otherwise("3.5").alias("value"))
    rules = t(spark, sf_dir, "part").select("p_partkey", F.filter(F.array(one), lambda x: k % 7 != 0).alias("conditions"), F.when(F.col("p_size") % 2 == 0, "P9").otherwise("P1").alias("output"), F.when(k % 2 == 0, "approved").otherwise("draft").alias("approval_status"))
    return conditions.normalise_rules(rules, ["height"]).select("p_partkey", F.array_join("unsupported", "|").alias("why"), "executable", "enabled")


@query("""SELECT c_custkey, lower(replace(c_name, ' ', '')) AS name FROM customer""")
def folded_names(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    wide = F.translate(F.upper(F.substring("c_name", 1, 4)), "CUST", "ＣＵＳＴ")
    return c.select("c_custkey", T.nfkc_casefold(F.concat(wide, F.lit(" \u3000"), F.substring("c_name", 5, 99))).alias("name"))
