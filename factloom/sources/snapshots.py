"""Snapshots and tables in shared storage: content-addressed publishing, verified reads, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a folder of our own if driver and executors are one
    process (tests), else an error, as executors wouldn't see each other's files."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: it survives lost executors, and plans stay short."""
    path = f"{shared_folder(df.sparkSession)}/factloom/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def content_hash(df: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order: sums of 60-bit pieces of row digests, and the
    number of rows. Columns count in the order of their names."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)
    pieces = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    got = df.agg(F.count(F.lit(1)).cast("string"), *pieces).first()
    import hashlib

    return hashlib.sha256("|".join(x or "0" for x in got).encode()).hexdigest()


def publish(df: DataFrame, base: str) -> str:
    """Write an immutable snapshot named by its content, then append the pointer to it; publishing equal content again
    writes no second copy. Pointers are rows, not renames, so object stores without atomic rename do."""
    spark = df.sparkSession
    name = content_hash(df)
    path = f"{base}/snapshots/{name}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    pointers = f"{base}/pointers"
    last = spark.read.parquet(pointers).agg(F.max("version")).first()[0] if _exists(spark, pointers) else 0
    spark.createDataFrame([(int(last or 0) + 1, name)], "version long, name string").coalesce(1).write.mode("append").parquet(pointers)
    return name


def read_current(spark: SparkSession, base: str, *, verify: bool = False) -> DataFrame:
    """The snapshot that the newest pointer names; with ``verify``, its content must be what its name says."""
    name = spark.read.parquet(f"{base}/pointers").agg(F.max_by("name", "version")).first()[0]
    df = spark.read.parquet(f"{base}/snapshots/{name}")
    if verify and content_hash(df) != name:
        raise ValueError("snapshot content doesn't match its name")
    return df


@contextmanager
def run_lock(path: str):
    """One run at a time, for processes of one machine: a file that names its process. A file of a process that has ended
    is taken over; one of a live process is an error. Only the owner's file is removed at the end."""
    mine = str(os.getpid())
    for last in (False, True):
        try:
            with open(path, "x", encoding="utf-8") as f:
                f.write(mine)
            break
        except FileExistsError:
            owner = _owner(path)
            if last or owner is None or os.path.exists(f"/proc/{owner}"):
                raise RuntimeError(f"a run of process {owner or 'unknown'} holds {path}") from None
            with suppress(FileNotFoundError):
                os.unlink(path)
    try:
        yield
    finally:
        if _owner(path) == int(mine):
            os.unlink(path)


def _owner(path: str) -> int | None:
    try:
        with open(path, encoding="utf-8") as f:
            return int(f.read())
    except (FileNotFoundError, ValueError):
        return None


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
