"""Structured Streaming counterparts: windows, sessions, daily histories without imputation, log tails, watchers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, *, time: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums by key in tumbling or sliding windows; works on streams (with a watermark) and on tables."""
    df = events.withColumn(time, F.col(time).cast("timestamp"))
    df = df.withWatermark(time, late) if df.isStreaming else df
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return df.groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, *, time: str = "ts", key: str = "user_id", gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of a key: runs of events less than ``gap`` apart."""
    df = events.withColumn(time, F.col(time).cast("timestamp"))
    df = df.withWatermark(time, late) if df.isStreaming else df
    out = df.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


_OUT = "series string, day date, n long, value double, status string"
_STATE = "day date, n long, value double, at timestamp, bad boolean"


def _days(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Days of one series: a day is emitted once a later day has begun, days without record too; a record of a day
    that has been emitted is late and is emitted as such, never merged in."""
    day, n, value, at, bad = state.get if state.exists else (None, 0, None, None, False)
    out = []
    rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
    for ts, v in zip(rows["ts"], rows["value"], strict=True):
        d = ts.date()
        if day is not None and d < day:
            out.append((key[0], d, 1, v, "late"))
            continue
        if day is not None and d > day:
            out.append((key[0], day, n, None if bad else value, "ambiguous_or_invalid_day" if bad else "recorded"))
            gap = day + pd.Timedelta(days=1)
            while gap < d:
                out.append((key[0], gap, 0, None, "no_record"))
                gap += pd.Timedelta(days=1)
            n, bad = 0, False
        day, n, value, at, bad = d, n + 1, v, ts, bad or v is None or v != v
    if day is not None:
        state.update((day, n, value, at, bool(bad)))
    yield pd.DataFrame(out, columns=["series", "day", "n", "value", "status"])


def daily_history(events: DataFrame, *, series: str = "event_type", time: str = "ts", value: str = "value") -> DataFrame:
    """A stream's days per series as they close, with gaps kept; the state is one open day per series."""
    df = events.select(F.col(series).alias("series"), F.col(time).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value")).where("ts is not null")
    return df.groupBy("series").applyInPandasWithState(_days, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def late_rows(events: DataFrame, closed: DataFrame, *, time: str = "ts", series: str = "event_type") -> DataFrame:
    """Rows of days that are closed already (series, day): for a side table."""
    return events.withColumn("day", F.to_date(time)).join(closed.select(series, "day").distinct(), [series, "day"], "left_semi")


def pair_calls(starts: DataFrame, results: DataFrame, *, call: str = "call_id", time: str = "ts", within: str = "1 hour") -> DataFrame:
    """Calls with their later result by call id; a left outer join, so open calls stay. On streams, both need
    watermarks, and the join is bounded by time."""
    s = starts.select(F.col(call), F.col(time).alias("started"), *[c for c in starts.columns if c not in (call, time)])
    r = results.select(F.col(call).alias("_call"), F.col(time).alias("ended"), *[F.col(c).alias(f"result_{c}") for c in results.columns if c not in (call, time)])
    cond = (F.col(call) == F.col("_call")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {within}"))
    return s.join(r, cond, "left").drop("_call")


def tail_log(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of a log folder's JSON lines: raw line and parsed event (null: malformed); offsets are the query's
    checkpoint, and a partial last line comes once it is whole."""
    raw = spark.readStream.format("text").load(folder)
    return raw.select("value", F.from_json("value", "kind string, step string, call_id string, text string, ts timestamp").alias("event"))


def watch_folder(spark: SparkSession, folder: str, on_batch: Callable[[DataFrame, int], None], *, checkpoint: str, every: str = "2 seconds", suffix: str = "pdf"):
    """New files of a folder trigger ``on_batch``; removals need ``sources.readers.directory_changes``."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", f"*.{suffix}").load(folder)
    return stream.drop("content").writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def publish_twice(df: DataFrame, base: str, finish: Callable[[DataFrame], DataFrame]) -> tuple[str, str]:
    """Two-phase publication: what is native first, then the finished table; both are snapshots."""
    from ..sources.snapshots import publish

    return publish(df, f"{base}/native"), publish(finish(df), f"{base}/final")


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job from its event rows (job_id, seq, state): the newest, whether it may still run, and
    whether the transitions were legal (nothing follows a final state)."""
    final = ("completed", "partial", "failed", "cancelled", "prepared")
    out = events.groupBy("job_id").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("_last"), F.min(F.when(F.col("state").isin(*final), F.col("seq"))).alias("_final"))
    return out.select("job_id", "state", F.col("state").isin("queued", "running").alias("active"), (F.col("_final").isNull() | (F.col("_final") == F.col("_last"))).alias("legal"))
