"""Typed quantities from reported text: numbers, intervals, approximations and units, each proven by its quote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col, let

# Words for what isn't known, units of money and their factors to 10,000.
UNKNOWN = "未知|未统计|未调查|尚未统计|未给出|不详|未记录"
MONEY = {"元": 0.0001, "万元": 1.0, "亿元": 10000.0}
_NUMBER = r"\d+(?:\.\d+)?"


def quantity(value, unit, quote, *, kind: str = "number", units: dict[str, float] | None = None) -> Column:
    """A reported value as state, reason, lower, upper, qualifier.

    state is accepted, unknown (the source says so; the bounds are null, never zero) or rejected with a reason. ``kind``:
    number, people (whole) or money (in 10,000, by unit; the unit may be part of the text and must be in the quote).
    Intervals are kept, not averaged; the number must stand in the quote as a token of its own.
    """
    squeeze = lambda c: F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"(?U)\s+", "")
    units = units or (MONEY if kind == "money" else {})
    ending = "(" + "|".join(sorted(units, key=len, reverse=True)) + ")$" if units else "(?!)"
    span, one = rf"^({_NUMBER})[~～至-]({_NUMBER})$", rf"^{_NUMBER}$"

    def named(a):
        inner = a["inner"]
        own = F.when(inner != "", inner).otherwise(a["u"])
        bare = F.substring(a["text"], F.lit(1), F.length(a["text"]) - F.length(inner))
        bare = F.regexp_replace(bare, r"(?:人|persons?)$", "") if kind == "people" else bare
        return F.struct(a["text"].alias("text"), a["u"].alias("u"), a["q"].alias("q"), inner.alias("inner"), own.alias("own"), bare.alias("bare"))

    def parsed(b):
        plain = F.when(F.regexp_like(b["bare"], F.lit(r"\d,\d")), F.replace(b["bare"], F.lit(","), F.lit(""))).otherwise(b["bare"])
        digits = F.regexp_replace(plain, "^(?:大约|约|近)", "")
        factor = F.coalesce(*[F.when(b["own"] == k, v) for k, v in units.items()]) if units else F.lit(1.0)
        first = F.when(F.regexp_like(digits, F.lit(span)), F.regexp_extract(digits, span, 1)).otherwise(digits)
        last = F.when(F.regexp_like(digits, F.lit(span)), F.regexp_extract(digits, span, 2)).otherwise(digits)
        return F.struct(b.alias("b"), digits.alias("digits"), (plain != digits).alias("near"), first.alias("first"), first.try_cast("double").alias("low"), last.try_cast("double").alias("high"), factor.alias("factor"))

    def judged(c):
        b, q, digits = c["b"], c["b"]["q"], c["digits"]
        is_span = F.regexp_like(digits, F.lit(span))
        shown = F.regexp_like(F.replace(q, F.lit(","), F.lit("")), F.concat(F.lit(r"(?<![\d.])\Q"), c["first"], F.lit(r"\E(?![\d.])")))
        reason = F.when(q == "", "no_quote").when((b["inner"] != "") & (b["u"] != "") & (b["inner"] != b["u"]), "units_differ")
        if kind == "money":
            reason = reason.when(c["factor"].isNull(), "unknown_unit").when(~F.contains(q, b["own"]), "unit_not_in_quote")
        elif kind == "people":
            reason = reason.when(~b["u"].isin("", "人", "person", "persons"), "unit_is_not_people")
        else:
            reason = reason.when(~b["u"].isin("", "1"), "unit_mismatch")
        comma = F.regexp_like(b["bare"], F.lit(r"\d,\d")) & ~F.regexp_like(b["bare"], F.lit(r"^(?:大约|约|近)?\d{1,3}(?:,\d{3})+(?:\.\d+)?$"))
        reason = reason.when(comma, "ambiguous_comma").when(~is_span & ~F.regexp_like(digits, F.lit(one)), "not_a_number_or_interval").when(c["low"] > c["high"], "bounds_reversed")
        if kind == "people":
            reason = reason.when(c["low"] != F.floor(c["low"]), "fraction_of_people")
        reason = reason.when(~shown, "not_in_quote")
        unknown = F.regexp_like(b["text"], F.lit(UNKNOWN)) & (q != "")
        return F.struct(F.when(~unknown, reason).alias("reason"), unknown.alias("unknown"), c.alias("c"), is_span.alias("is_span"))

    def told(d):
        state = F.when(d["unknown"], "unknown").when(d["reason"].isNull(), "accepted").otherwise("rejected")
        c, ok = d["c"], ~d["unknown"] & d["reason"].isNull()
        how = F.when(c["near"], "approximate").when(d["is_span"], "reported_range").otherwise("exact_as_reported")
        return F.struct(state.alias("state"), d["reason"].alias("reason"), F.when(ok, c["low"] * c["factor"]).alias("lower"), F.when(ok, c["high"] * c["factor"]).alias("upper"), F.when(ok, how).alias("qualifier"))

    raw = F.struct(squeeze(value).alias("text"), squeeze(unit).alias("u"), squeeze(quote).alias("q"), F.regexp_extract(squeeze(value), ending, 1).alias("inner"))
    return let(let(let(let(raw, named), parsed), judged), told)


def interval_qualifier(low, high) -> Column:
    """exact, range, upper_bound, lower_bound or missing; reversed bounds raise an error."""
    low, high = col(low), col(high)
    bad = F.raise_error(F.lit("interval bounds are reversed")).cast("string")
    return F.when(low > high, bad).when(low.isNull() & high.isNull(), "missing").when(low.isNull(), "upper_bound").when(high.isNull(), "lower_bound").when(low == high, "exact").otherwise("range")
