"""Facts from document text: page classes, headings, sections, clauses, thresholds, observations and packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

HEADING = r"^\s*(\d+(?:\.\d+){0,4})[\s、.．]*(\S.{0,60})$"
THRESHOLD = r"[<>≤≥＜＞]|不(?:小于|大于|低于|高于|应小于|应大于|宜小于|宜大于)|大于|小于|超过"


def page_class(words, images, drawings, tables, *, few_words: int = 20) -> Column:
    """A page's type by a decision list: table, drawing, scanned, blank, mixed, native."""
    w, i, d, t = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) for c in (words, images, drawings, tables))
    return (
        F.when(t > 0, "table").when((d >= 50) & (w < few_words * 5), "drawing").when((w < few_words) & (i > 0), "scanned").when((w < few_words) & (i == 0), "blank").when(i > 0, "mixed").otherwise("native")
    )


def recognition_route(page_type) -> Column:
    """Whether a page needs recognition, and with what priority."""
    p = F.col(page_type) if isinstance(page_type, str) else page_type
    return F.struct(p.isin("scanned", "drawing", "table").alias("needed"), F.when(p == "scanned", 3).when(p == "table", 2).when(p == "drawing", 1).otherwise(0).alias("rank"))


def table_likeness(c, keywords: Sequence[str]) -> Column:
    """A score of a text's resemblance to a table: keywords, many numbers, stations."""
    c = F.col(c) if isinstance(c, str) else c
    hits = sum((F.contains(c, F.lit(k)).cast("int") for k in keywords), F.lit(0))
    return hits + F.when(F.regexp_count(c, F.lit(r"\d+(?:\.\d+)?")) >= 10, 2).otherwise(0) + F.when(F.regexp_count(c, F.lit(T.STATION)) >= 2, 2).otherwise(0)


def lines(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """key, line_no (from 0) and line."""
    return df.select(*key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def headings(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """Numbered headings: key, line_no, number, depth, title. Lines of a table of contents (dots or a page number at
    the end) aren't headings."""
    rows = lines(df, key, text)
    number, title = F.regexp_extract("line", HEADING, 1), F.trim(F.regexp_extract("line", HEADING, 2))
    toc = F.col("line").rlike(r"(?:\.{3,}|…|·{3,})|\s\d{1,3}\s*$")
    rows = rows.withColumn("number", number).withColumn("title", title).where((F.col("number") != "") & ~toc & ~F.col("title").rlike(r"[。；;]$"))
    return rows.select(*key, "line_no", "number", F.size(F.split("number", r"\.")).alias("depth"), "title")


def sections(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """Clauses: each heading with the text up to the next heading of its document."""
    rows = lines(df, key, text)
    h = headings(df, key, text)
    marked = rows.join(h.select(*key, "line_no", "number", "title"), [*key, "line_no"], "left")
    w = Window.partitionBy(*key).orderBy("line_no")
    start = F.last(F.when(F.col("number").isNotNull(), F.col("line_no")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    body = marked.withColumn("_start", start).where("_start is not null")
    out = body.groupBy(*key, "_start").agg(F.max("number").alias("number"), F.max("title").alias("title"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return out.select(*key, F.col("_start").alias("line_no"), "number", "title", F.array_join(F.transform(F.slice("l", 2, 1_000_000), lambda x: x["line"]), "\n").alias("body"))


def section_owner(df: DataFrame, key: Sequence[str], order: str, heading: str, depth: str) -> DataFrame:
    """Path of open headings at each row: a heading closes those of its depth and deeper. Depths 1 to 5, each carried
    on by a window, reset by any shallower heading; no state outside the engine."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df
    for d in range(1, 6):
        mark = F.when(F.col(depth) == d, F.struct(F.col(order).alias("at"), F.col(heading).alias("h"), F.lit(True).alias("open"))).when(F.col(depth) < d, F.struct(F.col(order).alias("at"), F.lit(None).cast("string").alias("h"), F.lit(False).alias("open")))
        out = out.withColumn(f"_d{d}", F.last(mark, ignorenulls=True).over(w))
    path = F.array_compact(F.array(*[F.when(F.col(f"_d{d}.open"), F.col(f"_d{d}.h")) for d in range(1, 6)]))
    return out.withColumn("path", path).drop(*[f"_d{d}" for d in range(1, 6)])


def threshold_lines(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """Lines that state a threshold, with one line before and after."""
    w = Window.partitionBy(*key).orderBy("line_no")
    rows = lines(df, key, text).withColumn("before", F.lag("line").over(w)).withColumn("after", F.lead("line").over(w))
    return rows.where(F.col("line").rlike(THRESHOLD) & F.col("line").rlike(r"\d"))


def formula_lines(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """Lines that look like a formula: an equals sign between a short left side and operators on the right."""
    return lines(df, key, text).where(F.col("line").rlike(r"^\s*[A-Za-zΑ-Ωα-ω][\w'′]{0,12}\s*=\s*.*[-+*/×÷^√∑].*\d?"))


def table_rules(tables: DataFrame, key: Sequence[str], rows: str) -> DataFrame:
    """One atomic rule per filled cell of a table of rows (array of maps): key, row_no, column, value."""
    e = tables.select(*key, F.posexplode(rows).alias("row_no", "_m"))
    e = e.select(*key, "row_no", F.explode("_m").alias("column", "value"))
    return e.where(F.trim("value") != "")


def deduplicate_quotes(df: DataFrame, quote: str, order: Sequence[str], *, width: int = 160) -> DataFrame:
    """The first row of each quote, compared by its first ``width`` characters without white space and case."""
    from .ordered import first_by

    out = df.withColumn("_q", F.substring(F.lower(T.compact(quote)), 1, width))
    return first_by(out, ["_q"], [F.col(c) for c in order]).drop("_q")


def observations(df: DataFrame, key: Sequence[str], text: str, terms: dict[str, Sequence[str]], *, most: int = 8) -> DataFrame:
    """Affirmed observations per text, at most ``most`` in order: key, place, type, clause."""
    rows = df.select(*key, F.posexplode(T.clauses(text)).alias("place", "clause"))
    kinds = F.array_compact(F.array(*[F.when(F.lit(False) | _any(T.positive_mention("clause", t) for t in ts), F.lit(k)) for k, ts in terms.items()]))
    rows = rows.withColumn("type", F.explode(kinds))
    n = F.row_number().over(Window.partitionBy(*key).orderBy("place", "type"))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def _any(columns) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def stability_mentions(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """Factors with their working condition in one sentence: key, place, condition, factor."""
    pattern = r"(天然|饱和|饱水|暴雨|地震)[^。；;\d]{0,30}?(?:稳定(?:性)?系数|Fs|FS|K)[^\d。；;]{0,10}(\d\.\d{1,3})"
    return df.select(*key, F.posexplode(T.pattern_rows(text, pattern, ["condition", "factor"])).alias("place", "m")).select(*key, "place", "m.condition", F.col("m.factor").try_cast("double").alias("factor"))


def classify_first(c, patterns: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern that a text has (scopes, titles, materials, rivers, vegetation)."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(default).cast("string")
    for label, pattern in reversed(patterns):
        out = F.when(c.rlike(pattern), label).otherwise(out)
    return out


def catalogue_sources(files: DataFrame, profiles: DataFrame, name: str, *, fallback: str) -> DataFrame:
    """Files with the first profile (profile, pattern, priority) whose pattern their name holds, else the fallback.
    Profiles are a small dimension, which becomes a constant of the plan."""
    from ..functions.values import constants

    rows = sorted(constants(profiles, "priority", "profile", "pattern"))
    kind = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(n).alias("profile"), F.lit(k).alias("priority")) for k, n, p in rows])
    first = F.get(F.filter(kind, lambda r: F.contains(F.lower(F.col(name)), F.lower(r["pattern"]))), F.lit(0)) if rows else F.struct(F.lit(None).cast("string").alias("profile"), F.lit(None).cast("int").alias("priority"))
    out = files.withColumn("_hit", first)
    return out.withColumns({"profile": F.coalesce("_hit.profile", F.lit(fallback)), "priority": F.col("_hit.priority")}).drop("_hit")


def pack_pieces(df: DataFrame, key: Sequence[str], order: str, size: str, budget: int) -> DataFrame:
    """Greedy packing in order: adds ``batch``; a batch closes when the next piece doesn't fit. Order matters, so it is
    a scan of each document's pieces, which one Arrow group holds (sizes only, not texts)."""
    import pandas as pd

    schema = df.withColumn("batch", F.lit(0)).schema

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out, batch, used = [], 0, 0
        for n in pdf[size]:
            if used and used + n > budget:
                batch, used = batch + 1, 0
            used += n
            out.append(batch)
        return pdf.assign(batch=pd.Series(out, index=pdf.index, dtype="int32"))

    return df.groupBy(*key).applyInPandas(fill, schema)


def text_pieces(c, mark: str = r"(?<=[。；;.!?\n])") -> Column:
    """Lossless pieces of a text, cut after sentence marks: joined they are the text."""
    return F.filter(F.split(c, mark, -1), lambda x: x != "")


def quote_located(quotes: DataFrame, pages: DataFrame, key: Sequence[str], quote: str, text: str) -> DataFrame:
    """Quotes with ``located``: whether the claimed page holds them, white space aside."""
    p = pages.select(*key, F.regexp_replace(F.col(text), r"(?U)\s+", "").alias("_t"))
    out = quotes.join(p, list(key), "left")
    return out.withColumn("located", F.coalesce(F.contains("_t", F.regexp_replace(F.col(quote), r"(?U)\s+", "")) & (F.col(quote) != ""), F.lit(False))).drop("_t")
