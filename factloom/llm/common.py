"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators between words in these operators.
WORD_SPACE = r"[\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where that is unset, one of our own if
    driver and executors are one process (tests), else an error, as executors wouldn't see each other's files."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Stored:
    """A table written to the shared folder, so that lineage ends there and lost executors lose nothing."""

    def __init__(self, df: DataFrame, name: str, by: str | None = None):
        """``by``: a column whose values get folders of their own, which ``drop`` can take."""
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/factloom/{name}-{uuid.uuid4().hex}"
        self.schema = df.schema
        writer = df.write.option("compression", "zstd")
        # The table is what is read from here on: the shuffle files that made it can go when it is written.
        before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            (writer.partitionBy(by) if by else writer).parquet(self.path)
        finally:
            self.spark.conf.set(_CLEAN, before)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self, part: str = "") -> None:
        """Delete the files, or those of one folder (``by=value``); call only once nothing reads them any more."""
        with suppress(Exception):
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}" if part else self.path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def store(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, name).read()


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now rather than some time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """Rows joined to their groups, which have ``group_size``, their number of rows. Groups of over a thousandth of
    all rows, of which there are fewer than a thousand, go to every task; only the others' rows are dealt by key."""
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    big = F.col("group_size") * 1000 > F.lit(max(total, 10_000))
    hot = F.broadcast(groups.where(big))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(groups.where(~big), key))


def whole_rows(docs: DataFrame, **columns) -> DataFrame:
    """``docs`` with each whole row as one struct ``row``, beside ``columns`` (name: column of ``docs``), so that no
    column of the table can clash with those of an operator; ``select("row.*")`` gives the table back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def keep_rows(docs: DataFrame, kept: DataFrame, *, content: Column, id_col: str) -> DataFrame:
    """The rows of ``docs`` that ``kept`` names (doc_id, sha: the digest of ``content``, every: whether all rows of that
    id and content stay, or one of them). Columns may have any names, ids may be null or repeat."""
    key = ["_id", "_sha"]
    rows = whole_rows(docs, _id=F.col(f"`{id_col}`").cast("long"), _sha=F.unhex(F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256)))
    copies = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    named = kept.groupBy(F.col("doc_id").alias("k_id"), F.col("sha").alias("k_sha")).agg(F.max("every").alias("every"))
    same = lambda a, b: a["_id"].eqNullSafe(b["k_id"]) & (a["_sha"] == b["k_sha"])
    named = store(named.join(copies, same(copies, named), "left").select("k_id", "k_sha", (~F.col("every") & F.col("n").isNotNull()).alias("one")), "kept")
    out = rows.join(named, same(rows, named)).select("row", *key, "one")
    return out.where("not one").select("row.*").unionByName(out.where("one").dropDuplicates(key).select("row.*"))
