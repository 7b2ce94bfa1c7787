"""Readers and writers. Everything goes through Spark's file systems; edge formats hide behind optional imports."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the parsed tables.
PARSED_TABLES = ("documents", "pages", "text_blocks", "tables", "ocr_tasks", "ocr_results")
OBSERVATION = "source_file string, sheet string, row int, raw_time string, device_name string, raw_value string, cell string, error string"


def files(spark: SparkSession, folder: str, *, suffix: str = "pdf", recursive: bool = False, content: bool = False) -> DataFrame:
    """Files of a folder with a suffix in any case: path, size, modified (and sha256 and content, if asked for)."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    out = df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *([F.sha2("content", 256).alias("sha256"), "content"] if content else []))
    return out


def verified(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files (path, sha256) with ``intact``: whether their digest is the one expected; unknown files aren't."""
    return found.join(expected.select("path", F.col("sha256").alias("_e")), "path", "left").withColumn("intact", F.coalesce(F.col("sha256") == F.col("_e"), F.lit(False))).drop("_e")


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped, broken ones are kept in ``_corrupt``."""
    from pyspark.sql.types import StringType, StructType, _parse_datatype_string

    s = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    s = StructType([*s.fields]).add("_corrupt", StringType())
    return spark.read.schema(s).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def parsed_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parsed table by name; others are refused."""
    if name not in PARSED_TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(f"{folder}/{name}")


def read_xml_rows(spark: SparkSession, path: str, row_tag: str, schema=None) -> DataFrame:
    """Rows of an XML table, by the built-in reader."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def reconcile_xml(rows: DataFrame, expected: dict[str, int], label: str, ordinal: str) -> DataFrame:
    """Problems of an appendix table: ordinals that aren't 1 to n once each, and class counts other than published."""
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(ordinal).alias("d"), F.min(ordinal).alias("a"), F.max(ordinal).alias("b"))
    order = n.where("n <> d or a <> 1 or b <> n").select(F.lit("ordinals").alias("problem"), F.col("n").cast("string").alias("found"))
    published = rows.sparkSession.createDataFrame([*expected.items()], f"{label} string, _n long")
    counts = published.join(rows.groupBy(F.col(label).cast("string").alias(label)).agg(F.count(F.lit(1)).alias("n")), label, "full_outer")
    return order.unionByName(counts.where(~F.col("n").eqNullSafe(F.col("_n"))).select(F.concat(F.lit("class_count:"), label).alias("problem"), F.col("n").cast("string").alias("found")))


def current_records(files_: DataFrame, records: DataFrame) -> DataFrame:
    """Records whose file is unchanged (path, size, modified, sha256 where both have it)."""
    f = files_.select("path", F.col("size").alias("_s"), F.col("sha256").alias("_h"))
    return records.join(f, "path").where((F.col("size") == F.col("_s")) & (F.col("sha256").isNull() | F.col("_h").isNull() | (F.col("sha256") == F.col("_h")))).drop("_s", "_h")


def reuse_unchanged(old: DataFrame, unchanged: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of unchanged documents from before, and the rows of freshly parsed ones."""
    return old.join(unchanged.select(key).distinct(), key, "left_semi").unionByName(fresh, allowMissingColumns=True)


def directory_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """added, changed and removed files between two listings (path, size, modified): file streams miss removals."""
    a = before.select("path", F.struct("size", "modified").alias("a"))
    b = now.select("path", F.struct("size", "modified").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def read_series_workbooks(content: DataFrame, *, time_words: Sequence[str] = ("时间", "time"), value_words: Sequence[str] = ("值", "value"), device_words: Sequence[str] = ("设备", "device")) -> DataFrame:
    """Observations of spreadsheet files (path, content): columns found by header words, raw cells kept, a file that
    cannot be read becomes one row with its error. Needs a spreadsheet library on the executors; without it each file
    is such a row."""

    def run(frames):
        import io

        for pdf in frames:
            rows: list[tuple] = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    for sheet, table in pd.read_excel(io.BytesIO(data), sheet_name=None, header=0, dtype=str).items():
                        pick = lambda words, t=table: next((i for i, c in enumerate(t.columns) if any(w in str(c).lower() for w in words)), None)
                        t, v, d = pick(time_words), pick(value_words), pick(device_words)
                        for i, r in enumerate(table.itertuples(index=False), 2):
                            rows.append((path, sheet, i, _cell(r, t), _cell(r, d), _cell(r, v), None if v is None else f"{_letters(v)}{i}", None))
                except Exception as e:  # noqa: BLE001  a broken file is a row, not a failed job
                    rows.append((path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in OBSERVATION.split(", ")])

    return content.select("path", "content").mapInPandas(run, OBSERVATION)


def _letters(i: int) -> str:
    """The spreadsheet letters of a column counted from 0."""
    out = ""
    while i >= 0:
        i, rest = divmod(i, 26)
        out, i = chr(65 + rest) + out, i - 1
    return out


def _cell(row, i):
    return None if i is None or row[i] is None or row[i] != row[i] else str(row[i])


def read_pdf_pages(content: DataFrame) -> DataFrame:
    """Pages of PDF files (path, content): path, page, text, error. The PDF library is optional; a page or file that
    cannot be read becomes a row with its error."""

    def run(frames):
        import importlib.util

        engine = next((m for m in ("pypdf", "PyPDF2") if importlib.util.find_spec(m)), None)
        for pdf in frames:
            rows: list[tuple] = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                if engine is None:
                    rows.append((path, None, None, "engine_missing"))
                    continue
                import importlib
                import io

                try:
                    pages = importlib.import_module(engine).PdfReader(io.BytesIO(data)).pages
                    rows += [(path, i, p.extract_text(), None) for i, p in enumerate(pages, 1)]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"])

    return content.select("path", "content").mapInPandas(run, "path string, page int, text string, error string")


def write_series(df: DataFrame, path: str, *, series: str = "series_id", order: Sequence[str] = ("day", "time")) -> None:
    """Observations partitioned by series and sorted in files, so that a series and date range reads few row groups."""
    df.repartition(series).sortWithinPartitions(series, *order).write.mode("overwrite").partitionBy(series).parquet(path)


def compact_export(df: DataFrame, drop: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A projection without trace columns, and how many values of each were left out."""
    n = df.agg(*[F.count(c).alias(c) for c in drop]) if drop else df.limit(0)
    return df.drop(*drop), n
