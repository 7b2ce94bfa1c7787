import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.operators import assessment, conditions, coverage, documents, evaluation, graph, identity, joins, ordered, screening, series
from factloom.sources import readers, snapshots
from factloom.streaming import events


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def check(spark, column_kind, value, operator, expected, **options):
    return spark.createDataFrame([(value,)], f"x {column_kind}").select(conditions.condition("x", operator, expected, **options).alias("y")).first().y


@pytest.mark.parametrize(
    "kind, value, operator, expected, yes",
    [
        ("double", 1.0, "eq", "1", True), ("string", "1.0", "eq", 1, True), ("string", "a", "neq", "b", True), ("double", float("nan"), "neq", 1, False), ("string", None, "neq", "b", False), ("string", "", "exists", None, False),
        ("double", 0.0, "exists", None, True), ("string", "12", "gt", "x", False), ("string", "12", "gte", 12, True), ("string", "abc", "contains", "b", True), ("int", 3, "in", [1, 3], True), ("string", "inf", "gt", 1, False),
    ],
)
def test_conditions(spark, kind, value, operator, expected, yes):
    assert check(spark, kind, value, operator, expected) is yes


def test_list_conditions(spark):
    assert check(spark, "array<string>", ["a", "b"], "eq", "b", kind="list") is True
    assert check(spark, "array<string>", ["a"], "neq", "b", kind="list") is True
    assert check(spark, "array<string>", [], "neq", "b", kind="list") is False
    assert check(spark, "array<string>", ["xab"], "contains", "ab", kind="list") is True
    with pytest.raises(ValueError):
        conditions.condition("x", "like", "a")


def test_unsupported_rules_are_kept(spark):
    rules = spark.createDataFrame([("r1", [("f", "gt", "x")], "P1", "approved"), ("r2", [("f", "gt", "1")], "P1", "approved"), ("r3", [("g", "is", "1")], "P9", "approved")], "id string, conditions array<struct<field:string,operator:string,value:string>>, output string, approval_status string")
    out = {r.id: r for r in conditions.normalise_rules(rules, ["f"]).collect()}
    assert out["r1"].unsupported == ["not_a_number"] and not out["r1"].enabled
    assert out["r2"].enabled and set(out["r3"].unsupported) == {"unknown_field", "unknown_operator", "unknown_output"}


def test_paging_bounds(spark):
    with pytest.raises(ValueError):
        conditions.page(spark.range(3), ["id"], limit=0)


def test_first_wins_and_merge(spark):
    df = spark.createDataFrame([("a", 1, "", ["x"], 0.5, "s2"), ("a", 0, None, ["y", "x"], 0.9, "s1"), ("a", 2, "v", [], 0.1, "s3")], "k string, p int, f string, l array<string>, c double, src string")
    r = ordered.merge_by_priority(df, ["k"], ["p"], fields=["f"], lists=["l"], greatest=["c"], source="src").first()
    assert (r.f, r.l, r.c, r.sources) == ("v", ["y", "x"], 0.9, ["s1", "s2", "s3"])
    assert ordered.best_row(df, ["k"], [-F.col("c"), F.col("p")]).first().src == "s1"


def test_overlay_does_not_take_missing_values(spark):
    base = spark.createDataFrame([(1, "a", "b")], "id int, f string, g string")
    out = ordered.overlay(base, spark.createDataFrame([(1, "", "z")], "id int, f string, g string"), "id", ["f", "g"]).first()
    assert (out.f, out.g, out.overridden) == ("a", "z", ["g"])


def test_versions(spark):
    stored = spark.createDataFrame([("a", "1")], "id string, payload string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2"), ("a", "9")], "id string, payload string")
    assert values(ordered.append_new(stored, new, "id", "payload"), "id", "payload") == [("a", "9"), ("b", "2")]
    assert values(ordered.version_collisions(stored.union(new), "id", "payload"), "id") == [("a",)]
    facts = spark.createDataFrame([("f1", None), ("f2", "f1")], "id string, supersedes string")
    assert values(ordered.superseded_out(facts, "id", "supersedes"), "id") == [("f2",)]


def test_backtest_of_a_line(spark):
    days = [("s", dt.date(2026, 1, 1) + dt.timedelta(days=i), 2.0 * i) for i in range(60)]
    df = spark.createDataFrame(days, "series string, day date, value double")
    p = series.backtest(df, "series")
    m = {r.split: r for r in series.backtest_metrics(p, series.training_scale(df, "series"), "series").collect()}
    assert m["test"]["count"] == 12 and m["test"].recent_drift_mae == 0 and m["test"].persistence_mae == 2 and m["test"].persistence_mase == 1
    gap = series.backtest(df.where("day <> '2026-02-10'"), "series")
    assert {r.excluded: r.n for r in gap.groupBy("excluded").agg(F.count(F.lit(1)).alias("n")).collect()}["seven_day_history_missing_or_invalid"] == 6
    zeros = series.backtest_metrics(series.backtest(df.withColumn("value", F.lit(0.0)), "series"), series.training_scale(df.withColumn("value", F.lit(0.0)), "series"), "series").first()
    assert zeros.persistence_mae == 0 and zeros.persistence_mase is None and zeros.improvement is None


def test_replay_keeps_gaps_and_refuses_flags(spark):
    rows = [("s", dt.datetime(2026, 1, 1, 8), 1, 0.0, []), ("s", dt.datetime(2026, 1, 3, 8), 2, 5.0, ["invalid_value"])]
    df = spark.createDataFrame(rows, "s string, t timestamp_ntz, i int, v double, flags array<string>")
    out = values(series.daily_replay(df, "s", "t", "i", "v", flags="flags"), "day", "n", "value", "status")
    assert out == [(dt.date(2026, 1, 1), 1, 0.0, "recorded"), (dt.date(2026, 1, 2), 0, None, "no_record"), (dt.date(2026, 1, 3), 1, None, "ambiguous_or_invalid_day")]


def test_asof_and_gap(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 5, "z")], "k string, u int, v string")
    out = values(joins.asof_join(left, right, ["k"], "t", "u", ["v"], tie=["v"]), "k", "t", "asof_v")
    assert out == [("a", 1, None), ("a", 5, "z"), ("b", 9, None)]
    assert joins.asof_join(left, right.where("u = 2"), ["k"], "t", "u", ["v"], max_gap=2).where("asof_v is not null").count() == 0


def test_ranges(spark):
    pts = spark.createDataFrame([(i, float(i)) for i in range(0, 30, 5)], "id int, x double")
    rng = spark.createDataFrame([("p", 0.0, 10.0), ("q", 10.0, 12.0), ("r", 24.0, 26.0)], "o string, lo double, hi double")
    out = values(joins.attribute_unique(pts, rng, ["id"], "x", "lo", "hi", "o", width=4), "id", "status")
    assert out == [(0, "single"), (5, "single"), (10, "multiple"), (15, "none"), (20, "none"), (25, "single")]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5)], "src long, dst long")
    assert values(graph.components(edges), "node", "component") == [(1, 1), (2, 1), (3, 1), (5, 5), (8, 8), (9, 8)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    assert {r.component for r in graph.components(chain).collect()} == {0}
    links = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), ("y", "x")], "child string, parent string")
    assert values(graph.roots(links, "child", "parent", most_rounds=6), "child", "root") == [("b", "a"), ("c", "a"), ("x", None), ("y", None)]
    nodes = spark.createDataFrame([("n<1", "T", 'a"b', "{}")], "id string, type string, label string, props string")
    e = graph.distinct_edges(spark.createDataFrame([("n<1", "n<1", "R", "{}")] * 2, "src string, dst string, relation string, props string"))
    lines = [r.line for r in graph.graphml_lines(nodes, e).orderBy("part", "k").collect()]
    assert len(lines) == 4 and "n&lt;1" in lines[1] and "&quot;" in lines[1]


def test_priorities(spark):
    def at(**k):
        p = {"status": None, "factor": None, "observed": False, "marked": False, "potential": False, "rockfall": False, "height": None, "gradient": None, "identified": False, "reliable": False} | k
        kinds = {"status": "string", "factor": "double", "height": "double", "gradient": "double"}
        cols = {n: F.lit(v).cast(kinds.get(n, "boolean")) for n, v in p.items()}
        return spark.range(1).select(screening.priority(cols.pop("status"), cols.pop("factor"), cols.pop("observed"), **cols).alias("p")).first().p.priority

    assert at(factor=1.04, status="不稳定") == "P1" and at() == "P4" and at(potential=True) == "P2"
    assert at(identified=True) == "P4" and at(identified=True, reliable=True) == "P3" and at(factor=1.1) == "P2"
    assert at(rockfall=True, height=30.0) == "P2" and at(rockfall=True) == "P4"


def test_matrix_and_gate(spark):
    pairs = spark.createDataFrame([("较高", "高"), ("较低", "低"), (None, "高")], "likelihood string, consequence string")
    assert {(r.likelihood, r.level) for r in screening.apply_matrix(pairs, screening.matrix_table(spark)).collect()} == {("较高", "高"), ("较低", "低"), (None, None)}
    g = spark.range(1).select(screening.formal_gate(F.lit(True), F.lit("a"), F.lit("b"), F.lit(True), F.lit(True), F.lit(0)).alias("g")).first().g
    assert g.blocking == ["formal_release_supported"] and not g.ready


def test_bands(spark):
    rows = [("a", "x", 90.0, 120.0, True, True), ("b", "x", 10.0, 100.0, True, False), ("c", "x", 100.0, 100.0, True, True), ("d", "x", 500.1, 500.1, True, True), ("e", "x", 99.9, 99.9, True, True)]
    facts = spark.createDataFrame(rows, "k string, variable string, low double, high double, low_closed boolean, high_closed boolean").withColumn("unit", F.lit("m"))
    bands = spark.createDataFrame([("x", "m", 100.0, 500.0)], "variable string, unit string, low_boundary double, high_boundary double")
    out = {r.k: r.possible for r in assessment.table_grade(facts, bands, "k").collect()}
    assert out == {"a": ["危害中等", "危害小"], "b": ["危害小"], "c": ["危害中等"], "d": ["危害大"], "e": ["危害小"]}


def test_packet_passes_over_large_rows(spark):
    df = spark.createDataFrame([("k", 1, 5, "r"), ("k", 2, 9, "r"), ("k", 3, 4, "r"), ("k", 4, 1, None)], "k string, i int, n int, role string")
    out = {r.i: (r.selected, r.excluded) for r in assessment.evidence_packet(df, "k", {"no_role": F.col("role").isNotNull()}, ["i"], "n", 10).collect()}
    assert out == {1: (True, None), 2: (False, None), 3: (True, None), 4: (False, "no_role")}


def test_gold_facts(spark):
    gold = spark.createDataFrame(
        [("g1", "o1", "R", "T", "f", "2.62", False, False), ("g2", "o1", "R", "T", "f", "9", False, False), ("g3", "oX", "R", "T", "f", "1", False, False), ("g4", "o2", "R", "T", "f", "1", False, False), ("g5", "o1", "R", "T", "f", "2.62", True, False), ("g6", "o1", "R", "T", "h", "1", False, False)],
        "id string, owner_key string, relation string, node_type string, field string, expected string, expect_absent boolean, collection_member boolean",
    )
    owners = spark.createDataFrame([("o1", "n1"), ("o2", "n2"), ("o2", "n3")], "owner_key string, owner_id string")
    nodes = spark.createDataFrame([("t1", "T", "f", "2.6200000001")], "id string, type string, field string, value string")
    edges = spark.createDataFrame([("n1", "t1", "R")], "src string, dst string, relation string")
    out = dict(values(evaluation.gold_facts(gold, nodes, owners, edges), "id", "status"))
    assert out == {"g1": "pass", "g2": "wrong", "g3": "missing_owner", "g4": "ambiguous_owner", "g5": "violation", "g6": "missing"}


def test_label_gate(spark):
    ok = ("expert", "h", "h", "v1", "2026-01-01", ["e"])
    rows = [("a", "P1", "r1", *ok), ("a", "P1", "r2", *ok), ("b", "P1", "r1", *ok), ("b", "P1", "r1", *ok), ("c", "P1", "r1", *ok), ("c", "P2", "r2", *ok), ("d", "P1", "r1", *ok), ("d", "P1", "r2", "expert", "old", "h", "v1", "2026-01-01", ["e"])]
    df = spark.createDataFrame(rows, "case_id string, label string, reviewer_id string, reviewer_role string, input_sha256 string, current_sha256 string, scheme_version string, reviewed_at string, evidence_ids array<string>")
    out = {r.case_id: (r.passed, r.reasons) for r in evaluation.label_gate(df, "case_id").collect()}
    assert out == {"a": (True, []), "b": (False, ["too_few_independent_reviews"]), "c": (False, ["reviewers_disagree"]), "d": (False, ["too_few_independent_reviews"])}


def test_admission(spark):
    cases = spark.createDataFrame([("a", None, "g", "train"), ("a", "zz", "g", "test")], "case_id string, parent_case_id string, source_group_id string, split string")
    assert values(coverage.case_violations(cases), "check", "item") == [("duplicate_case", "a"), ("group_crosses_splits", "g"), ("unknown_parent", "zz")]
    assets = spark.createDataFrame([("x", "image", "f" * 64, 9, "d", "p"), ("y", "odd", "zz", 1, "nope", "")], "id string, type string, sha256 string, page int, document_id string, path string")
    docs = spark.createDataFrame([("d", 3)], "id string, pages int")
    assert values(coverage.asset_issues(assets, docs), "id", "issue") == [("x", "page_out_of_range"), ("y", "document_unknown"), ("y", "hash_malformed"), ("y", "path_missing"), ("y", "type_unknown")]


def test_documents(spark):
    text = "1 总则\n正文一\n1.1 范围\n不小于 3 m\n2 术语……12\n3 计算\ny = a + b*2"
    df = spark.createDataFrame([("d", text)], "id string, text string")
    assert values(documents.headings(df, ["id"], "text"), "number", "depth") == [("1", 1), ("1.1", 2), ("3", 1)]
    assert [r.body for r in documents.sections(df, ["id"], "text").orderBy("line_no").collect()][0] == "正文一"
    assert values(documents.threshold_lines(df, ["id"], "text"), "line", "before") == [("不小于 3 m", "1.1 范围")]
    assert documents.formula_lines(df, ["id"], "text").count() == 1
    heads = spark.createDataFrame([("d", 0, "A", 1), ("d", 1, None, None), ("d", 2, "B", 2), ("d", 3, None, None), ("d", 4, "C", 1), ("d", 5, None, None)], "id string, i int, h string, depth int")
    assert {r.i: r.path for r in documents.section_owner(heads, ["id"], "i", "h", "depth").collect()} == {0: ["A"], 1: ["A"], 2: ["A", "B"], 3: ["A", "B"], 4: ["C"], 5: ["C"]}
    p = spark.createDataFrame([("d", i, n) for i, n in enumerate((4, 5, 3, 9, 1))], "id string, i int, n int")
    assert {r.i: r.batch for r in documents.pack_pieces(p, ["id"], "i", "n", 10).collect()} == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2}
    assert "".join(spark.createDataFrame([("甲。乙；丙",)], "x string").select(documents.text_pieces(F.col("x")).alias("y")).first().y) == "甲。乙；丙"


def test_observations_are_affirmed(spark):
    df = spark.createDataFrame([("d", "坡顶有裂缝，未见掉块。可能滑塌；坡脚渗水")], "id string, text string")
    out = documents.observations(df, ["id"], "text", {"变形": ["裂缝", "掉块", "滑塌"], "水": ["渗水"]})
    assert values(out, "type", "clause") == [("变形", "坡顶有裂缝"), ("水", "坡脚渗水")]


def test_identity(spark):
    kinds = "id string, name string, route string, side string, start_m long, end_m long, namespace string, external_id string"
    s = spark.createDataFrame([("s1", "Ａ坡", "G1", "L", 100, 200, None, None), ("s2", "b", None, None, None, None, "n", "7"), ("s3", "zz", "G1", "L", 150, 300, None, None)], kinds)
    m = spark.createDataFrame([("m1", "A坡", "G1", "L", 100, 200, None, None), ("m2", "other", None, None, None, None, "n", "7")], kinds)
    out = values(identity.proposals(s, m), "source_id", "master_id", "score")
    assert out == [("s1", "m1", 90), ("s2", "m2", 100), ("s3", "m1", 50)]
    h = spark.createDataFrame([("b1", 1, "assign", "m1"), ("b1", 2, "release", "m1"), ("b2", 1, "assign", "m2")], "binding_id string, seq long, action string, master_id string")
    assert values(identity.active_bindings(h), "binding_id", "master_id") == [("b2", "m2")]


def test_snapshots(spark, tmp_path):
    base = str(tmp_path)
    a = spark.range(10).withColumn("x", F.col("id") * 2)
    first = snapshots.publish(a, base)
    assert snapshots.publish(a.orderBy(F.col("id").desc()), base) == first
    second = snapshots.publish(a.where("id < 5"), base)
    assert second != first and snapshots.read_current(spark, base, verify=True).count() == 5


def test_readers(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1")
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    found = readers.files(spark, str(tmp_path), content=True)
    assert found.count() == 1
    assert readers.read_pdf_pages(found).first().error is not None
    rows = readers.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int").cache()
    assert sorted((r.a is None, r._corrupt is None) for r in rows.collect()) == [(False, True), (True, False)]
    now = found.select("path", "size", "modified")
    assert values(readers.directory_changes(now, now.limit(0)), "change") == [("removed",)]
    with pytest.raises(ValueError):
        readers.parsed_table(spark, str(tmp_path), "users")


def test_xml(spark, tmp_path):
    (tmp_path / "t.xml").write_text("<t>" + "".join(f"<row><n>{i}</n><c>{'a' if i < 3 else 'b'}</c></row>" for i in (1, 2, 3)) + "</t>")
    rows = readers.read_xml_rows(spark, str(tmp_path / "t.xml"), "row", "n int, c string")
    assert readers.reconcile_xml(rows, {"a": 2, "b": 1}, "c", "n").count() == 0
    assert readers.reconcile_xml(rows, {"a": 1, "b": 2}, "c", "n").count() == 2


def test_stream_days_match_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    t0 = dt.datetime(2026, 1, 1, 9)
    rows = [("a", t0, 1.0), ("a", t0 + dt.timedelta(hours=1), 2.0), ("a", t0 + dt.timedelta(days=2), 3.0), ("a", t0 + dt.timedelta(days=3), 4.0)]
    spark.createDataFrame(rows, "event_type string, ts timestamp, value double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("event_type string, ts timestamp, value double").parquet(src)
    q = events.daily_history(stream).writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = values(spark.table("days"), "day", "n", "value", "status")
    d = dt.date(2026, 1, 1)
    assert got == [(d, 2, 2.0, "recorded"), (d + dt.timedelta(days=1), 0, None, "no_record"), (d + dt.timedelta(days=2), 1, 3.0, "recorded")]


def test_stream_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", dt.datetime(2026, 1, 1, 9), 1.0), ("a", dt.datetime(2026, 1, 5, 9), 1.0)], "event_type string, ts timestamp, value double").write.parquet(src)
    stream = spark.readStream.schema("event_type string, ts timestamp, value double").parquet(src)
    q = events.windowed(stream).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").count() == 1


def test_jobs(spark):
    df = spark.createDataFrame([("j", 1, "queued"), ("j", 2, "running"), ("k", 1, "failed"), ("k", 2, "running")], "job_id string, seq long, state string")
    assert values(events.job_states(df), "job_id", "active", "legal") == [("j", True, True), ("k", True, False)]
