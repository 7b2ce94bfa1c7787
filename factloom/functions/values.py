"""Scalar functions on presence, numbers, identities and canonical JSON. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """``body`` of a value that is computed once: long expressions stay small in the plan and in generated code."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constants(df: DataFrame, *columns: str, most: int = 10_000) -> list[tuple]:
    """Distinct rows of a small dimension, to become part of a plan; more than ``most`` of them are an error."""
    rows = df.select(*columns).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a table that a plan is to hold")
    return sorted((tuple(r) for r in rows), key=repr)


def is_present(c, kind: str = "string") -> Column:
    """Missing is null, the empty string, array or map; zero and false are values. ``kind``: string, collection, other."""
    c = col(c)
    filled = {"string": c.cast("string") != "", "collection": F.size(c) > 0}.get(kind)
    return c.isNotNull() if filled is None else F.coalesce(c.isNotNull() & filled, F.lit(False))


def any_present(*columns, kind: str = "string") -> Column:
    """Presence with alternative fields: one of them is enough."""
    out = F.lit(False)
    for c in columns:
        out = out | is_present(c, kind)
    return out


def finite(c) -> Column:
    """A double that is neither NaN nor infinite, else null."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def safe_float(c) -> Column:
    """Text as a finite double, else null; 'nan' and 'inf' are not numbers."""
    return finite(F.trim(col(c)).try_cast("double"))


def maximum_number(*columns) -> Column:
    """The greatest finite number of several fields; null if there is none."""
    cs = [safe_float(col(c).cast("string")) for c in columns]
    return cs[0] if len(cs) == 1 else F.greatest(*cs)


def numbers_in_text(c) -> Column:
    """Unsigned decimal numbers of a text, in order."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))


def stable_id(prefix, value) -> Column:
    """prefix_ and the first 12 hexadecimal digits of the value's SHA-1."""
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.lit("_"), F.substring(F.sha1(col(value).cast("binary")), 1, 12))


def content_digest(*columns: str) -> Column:
    """SHA-256 of canonical JSON of named columns: keys in order, nulls kept."""
    named = F.struct(*[F.col(c).alias(c) for c in sorted(columns)])
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}).cast("binary"), 256)


def map_digest(m) -> Column:
    """SHA-256 of a map's entries in key order (a map's own JSON keeps insertion order)."""
    return F.sha2(F.to_json(F.array_sort(F.map_entries(col(m)))).cast("binary"), 256)


def canonical_map(m) -> Column:
    """A map as text that doesn't depend on the order of its keys."""
    return F.to_json(F.array_sort(F.map_entries(col(m))))


def round_half_even(c, places: int = 2) -> Column:
    return F.bround(col(c), places)


def tolerant_equal(a, b, tolerance: float = 1e-6) -> Column:
    """Numbers equal within an absolute tolerance; null equals null only; NaN equals nothing."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)) & ~F.isnan(a) & ~F.isnan(b))


def same_text(a, b) -> Column:
    """Texts equal without white space; null equals null only."""
    strip = lambda c: F.regexp_replace(col(c), r"(?U)\s+", "")
    return F.coalesce(strip(a) == strip(b), col(a).isNull() & col(b).isNull())


def same_numbers(a, b, tolerance: float = 1e-6) -> Column:
    """Arrays of numbers of one length, equal place by place; order counts."""
    a, b = col(a), col(b)
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    near = F.forall(pairs, lambda p: F.coalesce(F.abs(p["a"] - p["b"]) <= tolerance, F.lit(False)))
    return F.coalesce((F.size(a) == F.size(b)) & near, F.lit(False))


def column_letter(i) -> Column:
    """The spreadsheet letter of a 1-based column: 1 is A, 27 is AA. For columns up to 18,278 (ZZZ)."""
    i = col(i).cast("int")
    letter = lambda n: F.char((n + 65).cast("int"))
    one, two, three = letter((i - 1) % 26), letter(F.floor((i - 27) / 26) % 26), letter(F.floor((i - 703) / 676) % 26)
    return F.when(i < 1, None).when(i <= 26, one).when(i <= 702, F.concat(two, one)).otherwise(F.concat(three, two, one))


def interval_text(low, high) -> Column:
    """``a-b``, ``≤b``, ``≥a`` or null of a pair of bounds."""
    low, high = col(low), col(high)
    text = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    return (
        F.when(low.isNotNull() & high.isNotNull(), F.when(low == high, text(low)).otherwise(F.concat(text(low), F.lit("-"), text(high))))
        .when(high.isNotNull(), F.concat(F.lit("≤"), text(high)))
        .when(low.isNotNull(), F.concat(F.lit("≥"), text(low)))
    )


def interval_meets(low, high, low_closed, high_closed, a, b, a_closed: bool, b_closed: bool) -> Column:
    """Whether an interval and a band share a point; null bounds of the interval are open ends."""
    inf = float("inf")
    low, high = F.coalesce(col(low).cast("double"), F.lit(-inf)), F.coalesce(col(high).cast("double"), F.lit(inf))
    a, b = F.lit(a).cast("double"), F.lit(b).cast("double")
    left, right = F.greatest(low, a), F.least(high, b)
    ends = ((left != low) | col(low_closed)) & ((left != a) | F.lit(a_closed)) & ((right != high) | col(high_closed)) & ((right != b) | F.lit(b_closed))
    return F.when(left == right, ends).otherwise(left < right)


def age_class(observed, as_of, *, current_days: int = 30, most_days: int = 90) -> Column:
    """Temporal validity of a dated record: current, aging, stale, future_date, undated or invalid_date. Dates are
    text; ``as_of`` is a parameter, never the clock."""
    text = col(observed).cast("string")
    day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    age = F.datediff(F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of, day)
    return (
        F.when(~is_present(text), "undated").when(day.isNull(), "invalid_date").when(age < 0, "future_date").when(age <= current_days, "current").when(age <= most_days, "aging").otherwise("stale")
    )


def parse_timestamp(c) -> Column:
    """An ISO time without zone, else null: an offset is refused rather than shifted."""
    text = F.trim(col(c).cast("string"))
    zoned = text.rlike(r"(?i)(?:z|[+-]\d{2}:?\d{2})$") & text.rlike(r"\d{2}:\d{2}")
    return F.when(~zoned, text.try_cast("timestamp_ntz"))


def parse_components(c) -> Column:
    """Numbers between commas (full-width ones too) as an array; null unless every part is finite."""
    parts = F.split(F.regexp_replace(col(c).cast("string"), "，", ","), ",")
    numbers = F.transform(parts, lambda x: finite(F.trim(x).try_cast("double")))
    return F.when(F.forall(numbers, lambda x: x.isNotNull()), numbers)


def rectangle(c) -> Column:
    """A box of four numbers as [left, top, right, bottom] with ordered corners; null if not four."""
    c = col(c)
    g = lambda i: F.get(c, F.lit(i))
    return F.when(F.size(c) == 4, F.array(F.least(g(0), g(2)), F.least(g(1), g(3)), F.greatest(g(0), g(2)), F.greatest(g(1), g(3))))


def rectangle_union(boxes) -> Column:
    """The least box around an array of boxes; null for none."""
    boxes = col(boxes)
    side = lambda i: F.transform(boxes, lambda b: F.get(b, F.lit(i)))
    return F.when(F.size(boxes) > 0, F.array(F.array_min(side(0)), F.array_min(side(1)), F.array_max(side(2)), F.array_max(side(3))))


def rectangles_meet(a, b) -> Column:
    a, b = rectangle(a), rectangle(b)
    g = lambda c, i: F.get(c, F.lit(i))
    return (g(a, 0) <= g(b, 2)) & (g(b, 0) <= g(a, 2)) & (g(a, 1) <= g(b, 3)) & (g(b, 1) <= g(a, 3))


def rectangle_inside(inner, outer, slack: float = 0.0) -> Column:
    a, b = rectangle(inner), rectangle(outer)
    g = lambda c, i: F.get(c, F.lit(i))
    return (g(a, 0) >= g(b, 0) - slack) & (g(a, 1) >= g(b, 1) - slack) & (g(a, 2) <= g(b, 2) + slack) & (g(a, 3) <= g(b, 3) + slack)


def overlap_share(a, b) -> Column:
    """Share of box a's area that box b covers."""
    a, b = rectangle(a), rectangle(b)
    g = lambda c, i: F.get(c, F.lit(i))
    wide = F.greatest(F.lit(0.0), F.least(g(a, 2), g(b, 2)) - F.greatest(g(a, 0), g(b, 0)))
    high = F.greatest(F.lit(0.0), F.least(g(a, 3), g(b, 3)) - F.greatest(g(a, 1), g(b, 1)))
    area = (g(a, 2) - g(a, 0)) * (g(a, 3) - g(a, 1))
    return F.when(area > 0, wide * high / area).otherwise(0.0)


def project_point(x, y, matrix) -> tuple[Column, Column]:
    """A pixel through the inverse of an affine matrix [a, b, c, d, e, f] (x' = a x + c y + e, y' = b x + d y + f);
    null where the matrix has no inverse."""
    m = [F.get(col(matrix), F.lit(i)).cast("double") for i in range(6)]
    det = m[0] * m[3] - m[1] * m[2]
    u, v = col(x) - m[4], col(y) - m[5]
    return F.when(det != 0, (m[3] * u - m[2] * v) / det), F.when(det != 0, (m[0] * v - m[1] * u) / det)
