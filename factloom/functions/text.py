"""Scalar functions on text: normalisation, stations and routes, repeating patterns, clauses and their polarity.

Built-in expressions, but for those at the end that need Unicode normalisation or token grammars, which are Arrow
(pandas) functions.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from .values import col

# Patterns of the data format.
STATION = r"(?i)K\s*(\d+)\s*\+\s*(\d+)\s*[-～~]\s*(?:K\s*)?(?:(\d+)\s*\+)?\s*(\d+)"
ROUTE = r"(?i)\b([GSXY]\d{2,4})\b"
NEGATION = r"未(?:见|发现|发生|出现)|尚未|没有|不存在|无(?:明显)?(?:地)?"
PREDICTION = r"可能|有可能|易(?:于)?(?:发生|产生|形成|出现)|极易|将(?:会)?|建议|应当|宜|如不|若不|一旦|通过计算|通过模拟|模拟结果|计算选取|公式|式中"
COMPUTED = r"通过(?:计算|模拟)|模拟结果|计算选取|公式|式中"
AFTER_NEGATION = r"(?:未见|未发生|不存在|不发育)"
ALARM_NEGATION = r"(?:无|未见|未发现|未出现|不存在|未观察到|否认)"


def clean_text(c) -> Column:
    """Control characters out, lines trimmed, runs of spaces and of empty lines made one."""
    c = F.regexp_replace(col(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    c = F.regexp_replace(c, r"(?m)[ \t\x{3000}]+", " ")
    c = F.regexp_replace(c, r"(?m)^ +| +$", "")
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def compact(c) -> Column:
    """Without any white space, also full-width."""
    return F.regexp_replace(col(c), r"(?U)\s+", "")


def full_width_comparators(c) -> Column:
    """Compact text with full-width comparison signs and digits as ASCII and one form for each sign."""
    c = F.translate(compact(c), "＜＞＝（）：，．－０１２３４５６７８９", "<>=():,.-0123456789")
    for a, b in (("≦", "≤"), ("≧", "≥"), ("<=", "≤"), (">=", "≥")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def station(c) -> Column:
    """The first station range of a text as start_m, end_m and its canonical form; null fields if there is none."""
    c = col(c)
    part = lambda i: F.regexp_extract(c, STATION, i)
    number = lambda i: part(i).try_cast("long")
    start_km, start, end = number(1), number(2), number(4)
    end_km = F.coalesce(number(3), start_km)
    found = F.format_string("K%d+%03d-K%d+%03d", start_km, start, end_km, end)
    ok = start_km.isNotNull()
    return F.struct(F.when(ok, found).alias("text"), (start_km * 1000 + start).alias("start_m"), (end_km * 1000 + end).alias("end_m"))


def station_text(start_m, end_m) -> Column:
    """Metres back to a station range; null without both."""
    a, b = col(start_m).cast("long"), col(end_m).cast("long")
    return F.when(a.isNotNull() & b.isNotNull(), F.format_string("K%d+%03d-K%d+%03d", F.floor(a / 1000), a % 1000, F.floor(b / 1000), b % 1000))


def station_valid(c) -> Column:
    """A station range that parses, whose metres are below 1000 and which doesn't run backwards."""
    s = station(c)
    return F.coalesce((s["end_m"] >= s["start_m"]) & (F.regexp_extract(col(c), STATION, 2).try_cast("long") < 1000) & (F.regexp_extract(col(c), STATION, 4).try_cast("long") < 1000), F.lit(False))


def route_code(*columns, default: str = "ROUTE") -> Column:
    """The first route code in any of several texts, upper case; else the default."""
    found = F.regexp_extract(F.concat_ws(" ", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in columns]), ROUTE, 1)
    return F.when(found == "", default).otherwise(F.upper(found))


def mojibake_ratio(c) -> Column:
    """Share of replacement and private-use characters."""
    c = col(c)
    return F.when(F.length(c) > 0, 1 - F.length(F.regexp_replace(c, "[�-]", "")) / F.length(c)).otherwise(0.0)


def first_range(c, pattern: str = r"(\d+(?:\.\d+)?)(?:\s*[-~～]\s*(\d+(?:\.\d+)?))?") -> Column:
    """The first number or range of a text: low, high (equal for one number)."""
    a = F.regexp_extract(col(c), pattern, 1).try_cast("double")
    b = F.coalesce(F.regexp_extract(col(c), pattern, 2).try_cast("double"), a)
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def pattern_rows(c, pattern: str, names: list[str]) -> Column:
    """All matches of a pattern as an array of structs of its groups (as text)."""
    arrays = [F.regexp_extract_all(col(c), F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    return F.arrays_zip(*arrays)


def coordinates(c) -> Column:
    """Longitude, latitude and elevation triples inside plausible bounds."""
    rows = pattern_rows(c, r"(\d{2,3}\.\d{3,})\D{1,6}(\d{2}\.\d{3,})(?:\D{1,6}(-?\d+(?:\.\d+)?))?", ["longitude", "latitude", "elevation"])
    typed = F.transform(rows, lambda r: F.struct(*[r[n].try_cast("double").alias(n) for n in ("longitude", "latitude", "elevation")]))
    return F.filter(typed, lambda r: r["longitude"].between(-180, 180) & r["latitude"].between(-90, 90))


def orientations(c) -> Column:
    """Dip direction and dip pairs (``120°∠45°``); directions over 360 and dips over 90 are left out."""
    rows = pattern_rows(c, r"(\d{1,3}(?:\.\d+)?)\s*°?\s*∠\s*(\d{1,2}(?:\.\d+)?)\s*°?", ["direction", "dip"])
    typed = F.transform(rows, lambda r: F.struct(r["direction"].try_cast("double").alias("direction"), r["dip"].try_cast("double").alias("dip")))
    return F.filter(typed, lambda r: (r["direction"] <= 360) & (r["dip"] <= 90))


def terms_in(c, terms: list[str], *, longest_first: bool = False) -> Column:
    """Terms of a list that a text holds, in the list's order. With ``longest_first``, a found term is masked, so
    that a shorter one inside it isn't found too."""
    c = col(c)
    if not longest_first:
        return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(c, t))
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    zero = F.struct(c.alias("rest"), F.array().cast("array<string>").alias("found"))
    step = lambda a, t: F.when(F.contains(a["rest"], t), F.struct(F.replace(a["rest"], t, F.lit("\u0001")).alias("rest"), F.array_append(a["found"], t).alias("found"))).otherwise(a)
    return F.aggregate(F.array(*[F.lit(t) for t in ordered]), zero, step, lambda a: a["found"])


def hazard_label(labels) -> Column:
    """Distinct labels joined by 、 without those that are part of another."""
    labels = F.array_distinct(col(labels))
    return F.array_join(F.filter(labels, lambda x: ~F.exists(labels, lambda y: (y != x) & F.contains(y, x))), "、")


def clauses(c) -> Column:
    """Clauses of a text's sentences, without white space; sentences about computations are left out."""
    sentences = F.filter(F.split(col(c), "[。；;]"), lambda s: ~F.regexp_like(s, F.lit(COMPUTED)))
    parts = F.flatten(F.transform(sentences, lambda s: F.split(s, "[，,]|但是|但|然而")))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)\s+", "")), lambda p: p != "")


def positive_mention(clause, term: str) -> Column:
    """Whether a clause affirms a term: some mention without negation or prediction before it, nor one right after."""
    pieces = F.split(col(clause), rf"\Q{term}\E", -1)
    places = F.sequence(F.lit(0), F.size(pieces) - 2)

    def holds(i):
        before = F.array_join(F.slice(pieces, 1, i + 1), term)
        after = F.get(pieces, i + 1)
        last = i == F.size(pieces) - 2
        rest = F.when(last, after).otherwise(F.concat(after, F.lit(term)))
        return ~F.regexp_like(before, F.lit(f"{NEGATION}|{PREDICTION}")) & ~F.regexp_like(rest, F.lit(f"^{AFTER_NEGATION}"))

    return F.when(F.size(pieces) > 1, F.exists(places, holds)).otherwise(F.lit(False))


def alarm_affirmed(c, term: str, window: int = 18) -> Column:
    """Whether a text affirms an alarm term: some mention whose clause, within ``window`` characters before it, isn't
    negated in the 12 characters right before."""
    c = col(c)
    pieces = F.split(c, rf"\Q{term}\E", -1)
    places = F.sequence(F.lit(0), F.size(pieces) - 2)

    def holds(i):
        before = F.array_join(F.slice(pieces, 1, i + 1), term)
        near = F.substring(before, F.greatest(F.lit(1), F.length(before) - window + 1), F.lit(window))
        clause = F.element_at(F.split(near, r"[，。；;,.!?！？\n]", -1), -1)
        return ~F.regexp_like(clause, F.lit(ALARM_NEGATION + r"[^，。；;,.!?！？\n]{0,12}$"))

    return F.when(F.size(pieces) > 1, F.exists(places, holds)).otherwise(F.lit(False))


def alarm_terms(c, terms: list[str]) -> Column:
    """The affirmed terms, in the list's order."""
    return F.array_compact(F.array(*[F.when(alarm_affirmed(c, t), F.lit(t)) for t in terms]))


def quote_window(line, keyword, *, before: int = 240, after: int = 300) -> Column:
    """A keyword with its surroundings in a line."""
    line, at = col(line), F.instr(col(line), col(keyword))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(line, start, at - start + F.length(col(keyword)) + after))


def pages_selected(spec, total) -> Column:
    """Pages that ``all``, ``none`` or a list like ``1-3,5`` selects of ``total``; other specifications give null."""
    spec, total = F.lower(F.regexp_replace(col(spec), r"\s", "")), col(total).cast("int")
    every = F.when(total > 0, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>"))
    parts = F.transform(F.split(spec, ","), lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int").alias("a"), F.coalesce(F.regexp_extract(p, r"-(\d+)$", 1).try_cast("int"), F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")).alias("b")))
    valid = F.regexp_like(spec, F.lit(r"^\d+(-\d+)?(,\d+(-\d+)?)*$"))
    listed = F.array_sort(F.filter(every, lambda x: F.exists(parts, lambda p: x.between(F.least(p["a"], p["b"]), F.greatest(p["a"], p["b"])))))
    return F.when(spec == "all", every).when(spec == "none", F.array().cast("array<int>")).when(valid, listed)


@F.pandas_udf(StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    """NFKC, case-folded, without white space: names that people write differently."""
    return s.map(lambda x: None if x is None else re.sub(r"\s+", "", unicodedata.normalize("NFKC", x)).casefold())


@F.pandas_udf(BooleanType())
def literal_supported(text: pd.Series, literal: pd.Series) -> pd.Series:
    """Whether a text holds a number as a token of its own: 4.5 isn't in 4.51 or 14.5, m isn't in m²."""

    def one(t, x):
        if t is None or not x:
            return False
        edge = r"[0-9.]" if x[0].isdigit() or x[0] in "+-" else r"[A-Za-z]"
        last = r"[0-9]|\.[0-9]" if x[-1].isdigit() else r"[A-Za-z²³^/]"
        return re.search(rf"(?<!{edge}){re.escape(x)}(?!{last})", t) is not None

    return pd.Series([one(t, x) for t, x in zip(text, literal, strict=True)], dtype="boolean")


@F.pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two names, 0 to 1."""
    from difflib import SequenceMatcher

    return pd.Series([0.0 if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])
