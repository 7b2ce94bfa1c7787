import pytest
from pyspark.sql import functions as F

from factloom.functions import quantities as Q
from factloom.operators import layout, tables


def labelled(spark, rows):
    df = spark.createDataFrame([("t", rows)], "id string, rows array<array<string>>")
    return sorted(((r.subject, r.measure, r.condition, r.value, r.problem) for r in tables.labelled_numbers(df, ["id"], "rows").collect()), key=str)


def test_parameter_per_row(spark):
    rows = [["岩性", "项目", "天然", "饱和"], ["粉土", "内聚力(kPa)", "12", "8"], ["", "内摩擦角(°)", "20", "15"]]
    assert labelled(spark, rows) == [("粉土", "cohesion", "天然", 12.0, None), ("粉土", "cohesion", "饱和", 8.0, None), ("粉土", "friction_angle", "天然", 20.0, None), ("粉土", "friction_angle", "饱和", 15.0, None)]


def test_parameter_per_column_and_two_levels(spark):
    rows = [["名称", "工况", "重度(kN/m³)", "黏聚力 (kPa)"], ["土", "天然", "18", "10"], ["", "饱水", "19", "7"]]
    assert labelled(spark, rows) == [("土", "cohesion", "天然", 10.0, None), ("土", "cohesion", "饱水", 7.0, None), ("土", "unit_weight", "天然", 18.0, None), ("土", "unit_weight", "饱水", 19.0, None)]
    rows = [["计算剖面", "稳定性系数", "", "剩余下滑力(kN/m)"], ["", "天然", "暴雨", "暴雨"], ["1-1'", "1.20", "1.04", "500"]]
    got = labelled(spark, rows)
    assert ("1-1'", "safety_factor", "天然", 1.2, None) in got and ("1-1'", "safety_factor", "暴雨", 1.04, None) in got
    assert [x for x in got if x[3] == 500.0][0][4] == "no_single_measure"


def test_ambiguous_headers_name_nothing(spark):
    got = labelled(spark, [["名称", "天然 饱和", "稳定系数"], ["a", "1.0", "1.1"]])
    assert all(x[4] for x in got)


@pytest.mark.parametrize(
    "value, unit, quote, kind, state, low, high, reason",
    [
        ("12人", "", "威胁12人", "people", "accepted", 12.0, 12.0, None), ("12.5", "人", "12.5人", "people", "rejected", None, None, "fraction_of_people"), ("约3~5", "万元", "损失约3~5万元", "money", "accepted", 3.0, 5.0, None),
        ("2亿元", "", "损失2亿元", "money", "accepted", 20000.0, 20000.0, None), ("2亿元", "万元", "损失2亿元", "money", "rejected", None, None, "units_differ"), ("1,234", "元", "损失1,234元", "money", "accepted", 0.1234, 0.1234, None),
        ("12,34", "元", "12,34元", "money", "rejected", None, None, "ambiguous_comma"), ("未统计", "", "损失未统计", "money", "unknown", None, None, None), ("5~3", "", "5~3", "number", "rejected", None, None, "bounds_reversed"),
        ("4.5", "", "系数4.51", "number", "rejected", None, None, "not_in_quote"), ("4.5", "", "", "number", "rejected", None, None, "no_quote"), ("0", "", "共0处", "number", "accepted", 0.0, 0.0, None),
    ],
)
def test_quantities(spark, value, unit, quote, kind, state, low, high, reason):
    df = spark.createDataFrame([(value, unit, quote)], "v string, u string, q string")
    r = df.select(Q.quantity("v", "u", "q", kind=kind).alias("x")).first().x
    assert (r.state, r.reason) == (state, reason)
    assert r.lower == pytest.approx(low) if low is not None else r.lower is None
    assert r.upper == pytest.approx(high) if high is not None else r.upper is None


def test_geometry_joins(spark):
    blocks = spark.createDataFrame([("p", "b1", [0.0, 0.0, 10.0, 90.0]), ("p", "b2", [0.0, 200.0, 10.0, 210.0])], "page string, id string, bbox array<double>")
    t = spark.createDataFrame([("p", "t1", [0.0, 150.0, 100.0, 300.0])], "page string, id string, bbox array<double>")
    assert [(r.table_id, r.block_id, r.distance) for r in layout.blocks_above(blocks, t, ["page"]).collect()] == [("t1", "b1", 60.0)]
    assert [r.block_id for r in layout.blocks_in_tables(blocks, t, ["page"]).collect()] == ["b2"]
    rebuilt = spark.createDataFrame([("p", "r1", [0.0, 200.0, 10.0, 210.0]), ("p", "r2", [500.0, 1.0, 510.0, 2.0])], "page string, id string, bbox array<double>")
    assert [(r.rebuilt_id, r.native_id) for r in layout.repaired_links(blocks, rebuilt, ["page"]).collect()] == [("r1", "b2")]


def test_wrapped_labels(spark):
    items = [("p", "a", "挡土墙工程", [0.0, 0.0, 50.0, 10.0]), ("p", "b", "位置", [15.0, 11.0, 35.0, 21.0]), ("p", "c", "很远", [200.0, 11.0, 220.0, 21.0])]
    out = layout.wrapped_labels(spark.createDataFrame(items, "page string, id string, text string, bbox array<double>"), ["page"]).collect()
    assert [(r.first_id, r.second_id, r.text, r.bbox) for r in out] == [("a", "b", "挡土墙工程位置", [0.0, 0.0, 50.0, 21.0])]


def test_readings_clusters_and_attribution(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3"), ("z", "4")], "k string, v string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "5")], "k string, v string")
    assert {r.k: r.state for r in layout.independent_readings(a, b, ["k"], "v").collect()} == {"x": "agree", "y": "differ", "z": "ambiguous", "w": "only_second"}
    spans = spark.createDataFrame([("d", 1, 0, 5, 2), ("d", 2, 4, 9, 1), ("d", 3, 20, 25, 3)], "doc string, id int, s int, e int, rank int")
    out = {r.id: (r.cluster, r.chosen) for r in layout.overlap_clusters(spans, ["doc"], "s", "e", [F.col("rank")], ["id"]).collect()}
    assert out == {1: (1, False), 2: (1, True), 3: (2, True)}
    units = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "unit_id string")
    claims = spark.createDataFrame([("u1", "o1"), ("u2", "o1"), ("u2", "o2")], "unit_id string, owner string")
    assert {r.unit_id: r.state for r in layout.attribution_partition(units, claims).collect()} == {"u1": "attributed", "u2": "disputed", "u3": "unassigned"}


def test_stitching_and_support(spark):
    df = spark.createDataFrame([("d", 0, [["剖面", "Fs"]], "x"), ("d", 1, [["1", "1.2"], ["2", "1.3"]], "1 1.2 2"), ("d", 2, [["a", "b"]], "q")], "doc string, i int, rows array<array<string>>, text string")
    assert {r.i: r.header_from for r in tables.stitch_headers(df, ["doc"], "i", "rows").collect()} == {0: None, 1: 0, 2: None}
    assert {r.i: r.support for r in tables.table_support(df, "rows", "text").collect()}[1] == 0.75
