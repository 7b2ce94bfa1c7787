"""Time series: calendar replay, statistics, islands, histories and back-tests. Nothing is imputed, smoothed or
dropped because it is zero; ambiguous days are refused, not averaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import finite

def calendar(df: DataFrame, day: str = "day", start=None, end=None) -> DataFrame:
    """Every date from the first to the last day of the data (or of given bounds): a few thousand rows."""
    first = F.lit(start).cast("date") if start else F.min(day)
    last = F.lit(end).cast("date") if end else F.max(day)
    bounds = df.agg(F.min(first).alias("a") if start else first.alias("a"), F.min(last).alias("b") if end else last.alias("b"))
    return bounds.where("a is not null").select(F.explode(F.sequence("a", "b")).alias(day))


def daily_replay(obs: DataFrame, series: str, time: str, tie: str, value: str, *, flags: str | None = None, start=None, end=None) -> DataFrame:
    """One row per series and calendar date: count, the last observation's value, and a status. Dates without record
    stay, with null; dates with a flagged record have no value."""
    rows = obs.where(F.col(time).isNotNull()).withColumn("day", F.to_date(time))
    bad = F.max(F.size(flags) > 0) if flags else F.lit(False)
    daily = rows.groupBy(series, "day").agg(F.count(F.lit(1)).alias("n"), F.max_by(value, F.struct(time, tie)).alias("value"), bad.alias("bad"))
    days = calendar(rows, "day", start, end)
    bounds = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).withColumn("_k", F.lit(0))
    named = rows.select(series).distinct().withColumn("_k", F.lit(0))
    spine = named.join(F.broadcast(bounds), "_k").select(series, F.explode(F.sequence("a", "b")).alias("day"))
    out = spine.join(daily, [series, "day"], "left")
    status = F.when(F.col("n").isNull(), "no_record").when(F.col("bad"), "ambiguous_or_invalid_day").otherwise("recorded")
    return out.select(series, "day", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(~F.coalesce("bad", F.lit(False)), F.col("value")).alias("value"), status.alias("status"))


def value_stats(obs: DataFrame, series: str, time: str, tie: str, value: str) -> DataFrame:
    """Per series: least, greatest, zeros, valid values and the largest change between adjacent observations of
    different times, with its ends."""
    rows = obs.withColumn("_v", finite(value)).where(F.col("_v").isNotNull() & F.col(time).isNotNull())
    w = Window.partitionBy(series).orderBy(time, tie)
    rows = rows.withColumn("_p", F.lag("_v").over(w)).withColumn("_pt", F.lag(time).over(w))
    change = F.when(F.col(time) != F.col("_pt"), F.abs(F.col("_v") - F.col("_p")))
    rows = rows.withColumn("_c", change)
    top = F.max_by(F.struct(F.col("_pt").alias("from_time"), F.col(time).alias("to_time"), F.col("_p").alias("from_value"), F.col("_v").alias("to_value")), F.when(F.col("_c").isNotNull(), F.struct("_c", time)))
    out = rows.groupBy(series).agg(F.min("_v").alias("min"), F.max("_v").alias("max"), F.count_if(F.col("_v") == 0).alias("zero_count"), F.count("_v").alias("valid_count"), F.max("_c").alias("largest_change"), top.alias("t"))
    return out.select(series, "min", "max", "zero_count", "valid_count", "largest_change", "t.from_time", "t.to_time", "t.from_value", "t.to_value")


def gap_stats(obs: DataFrame, series: str, time: str) -> DataFrame:
    """Exact median and maximum of the seconds between distinct times of a series."""
    stamps = obs.where(F.col(time).isNotNull()).select(series, time).distinct()
    gap = F.expr(f"unix_micros(cast({time} as timestamp))") - F.lag(F.expr(f"unix_micros(cast({time} as timestamp))")).over(Window.partitionBy(series).orderBy(time))
    rows = stamps.withColumn("gap", gap / 1e6)
    return rows.groupBy(series).agg(F.count(F.lit(1)).alias("n_times"), F.percentile("gap", 0.5).alias("median_seconds"), F.max("gap").alias("max_seconds"))


def islands(df: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """Runs of consecutive days per key: start_day, end_day, days."""
    days = df.where(F.col(day).isNotNull()).select(*keys, day).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(day))
    runs = days.withColumn("_run", F.date_sub(day, place))
    return runs.groupBy(*keys, "_run").agg(F.min(day).alias("start_day"), F.max(day).alias("end_day"), F.count(F.lit(1)).alias("days")).drop("_run")


def common_days(df: DataFrame, series: str, day: str = "day") -> DataFrame:
    """Days on which every series has a record."""
    n = df.agg(F.count_distinct(series).alias("n_series"))
    return df.groupBy(day).agg(F.count_distinct(series).alias("k")).join(F.broadcast(n), F.col("k") == F.col("n_series")).select(day)


def quality_counts(obs: DataFrame, series: str, time: str, value: str) -> DataFrame:
    """Rows, duplicate times (all rows that share one), invalid times and invalid values per series."""
    by_time = obs.groupBy(series, time).agg(F.count(F.lit(1)).alias("n"), F.count_if(finite(value).isNull()).alias("bad"))
    twice = F.when(F.col(time).isNotNull() & (F.col("n") > 1), F.col("n")).otherwise(0)
    return by_time.groupBy(series).agg(
        F.sum("n").alias("row_count"), F.sum(twice).alias("duplicate_time_rows"), F.sum(F.when(F.col(time).isNull(), F.col("n")).otherwise(0)).alias("invalid_time_rows"), F.sum("bad").alias("invalid_value_rows")
    )


def single_valued_days(obs: DataFrame, series: str, time: str, value: str, *, id_col: str | None = None) -> DataFrame:
    """Rows with ``day`` and ``reason``: null for the one row of a day, else why the row is refused. A day with several
    rows is ambiguous and refuses them all."""
    rows = obs.withColumn("day", F.to_date(time))
    many = F.count(F.lit(1)).over(Window.partitionBy(series, "day")) > 1
    reason = F.when(F.col("day").isNull(), "invalid_recorded_time").when(many, "ambiguous_source_date").when(finite(value).isNull(), "component_unavailable")
    return rows.withColumn("reason", reason)


def split_by_span(df: DataFrame, series: str, day: str = "day") -> DataFrame:
    """Adds train_end, validation_end, ``split`` and ``usable``: 60/20/20 of the calendar span, whole days, per
    series; usable if train has at least 7 days and both other parts have some."""
    w = Window.partitionBy(series)
    first, last = F.min(day).over(w), F.max(day).over(w)
    out = df.withColumn("_first", first).withColumn("_last", last).withColumn("_span", F.datediff("_last", "_first") + 1)
    out = out.withColumn("train_end", F.expr("date_add(_first, cast(_span * 3 div 5 as int) - 1)")).withColumn("validation_end", F.expr("date_add(_first, cast(_span * 4 div 5 as int) - 1)"))
    split = F.when(F.col(day) <= F.col("train_end"), "train").when(F.col(day) <= F.col("validation_end"), "validation").otherwise("test")
    usable = (F.datediff("train_end", "_first") + 1 >= 7) & (F.col("validation_end") > F.col("train_end")) & (F.col("_last") > F.col("validation_end"))
    return out.withColumn("split", split).withColumn("usable", usable).drop("_first", "_last", "_span")


def backtest(days: DataFrame, series: str, value: str = "value", day: str = "day", *, lookback: int = 7) -> DataFrame:
    """Targets of the validation and test parts with their forecasts: persistence and recent drift, both from the day
    before, both only where ``lookback`` consecutive days are there; else ``excluded`` says why. ``days`` has one
    valid row per series and day at most; calendar days without a row are targets too.
    """
    bounds = days.groupBy(series).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    spine = bounds.select(series, F.explode(F.sequence("a", "b")).alias(day))
    rows = split_by_span(spine.join(days.select(series, day, finite(value).alias("actual")), [series, day], "left"), series, day)
    w = Window.partitionBy(series).orderBy(day)
    before = w.rowsBetween(-lookback, -1)
    rows = rows.withColumn("origin", F.lag("actual").over(w)).withColumn("oldest", F.lag("actual", lookback).over(w)).withColumn("history", F.count("actual").over(before))
    excluded = F.when(F.col("actual").isNull(), "target_missing_or_invalid").when(F.col("origin").isNull(), "previous_date_missing_or_invalid").when(F.col("history") < lookback, "seven_day_history_missing_or_invalid")
    drift = F.col("origin") + (F.col("origin") - F.col("oldest")) / (lookback - 1)
    out = rows.where("usable and split <> 'train'").withColumn("excluded", excluded)
    ok = F.col("excluded").isNull()
    return out.select(series, day, "split", "actual", "excluded", F.when(ok, F.col("origin")).alias("persistence"), F.when(ok, drift).alias("recent_drift"))


def training_scale(days: DataFrame, series: str, value: str = "value", day: str = "day") -> DataFrame:
    """Mean absolute difference of training days that follow one another in the calendar, and their number."""
    w = Window.partitionBy(series).orderBy(day)
    rows = split_by_span(days, series, day).where(F.col(value).isNotNull())
    step = F.when(F.datediff(F.col(day), F.lag(day).over(w)) == 1, F.abs(F.col(value) - F.lag(value).over(w)))
    rows = rows.withColumn("_step", F.when(F.col("split") == "train", step))
    return rows.groupBy(series).agg(F.avg("_step").alias("scale"), F.count("_step").alias("pairs"))


def backtest_metrics(predictions: DataFrame, scale: DataFrame, series: str) -> DataFrame:
    """count, mae, rmse, bias and mase of both methods per series and part, and drift's improvement over persistence
    (null where that cannot be said)."""
    aggs = [F.count("persistence").alias("count")]
    for m in ("persistence", "recent_drift"):
        e = F.col(m) - F.col("actual")
        aggs += [F.avg(F.abs(e)).alias(f"{m}_mae"), F.sqrt(F.avg(e * e)).alias(f"{m}_rmse"), F.avg(e).alias(f"{m}_bias")]
    out = predictions.groupBy(series, "split").agg(*aggs).join(scale.select(series, "scale"), series, "left")
    mase = lambda m: F.when(F.col("scale") > 0, F.col(f"{m}_mae") / F.col("scale")).alias(f"{m}_mase")
    better = F.when(F.col("persistence_mae") != 0, 1 - F.col("recent_drift_mae") / F.col("persistence_mae"))
    return out.select("*", mase("persistence"), mase("recent_drift"), better.alias("improvement")).drop("scale")


def exclusion_counts(predictions: DataFrame, series: str) -> DataFrame:
    """How many calendar targets of each part were left out, by reason."""
    return predictions.where("excluded is not null").groupBy(series, "split", "excluded").agg(F.count(F.lit(1)).alias("n"))


def reconcile(df: DataFrame, value: str) -> DataFrame:
    """Published-statistics figures of a column: min, max, exact median, mean and sample deviation."""
    return df.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.percentile(value, 0.5).alias("median"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"))


def provenance_graph(series: DataFrame, site: Column, run: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of series (id, sensor_id, file): site, point, series, file, quality report and run."""
    node = lambda i, k: F.struct(i.alias("id"), F.lit(k).alias("type"))
    asset, report = F.concat(F.lit("mf_"), "id"), F.concat(F.lit("mq_"), "id")
    nodes = series.select(F.explode(F.array(node(site, "MonitoringSite"), node(run, "ProcessingRun"), node(F.col("sensor_id"), "MonitoringPoint"), node(F.col("id"), "MonitoringSeries"), node(asset, "DataTableAsset"), node(report, "QualityReport"))).alias("n")).select("n.*").distinct()
    edge = lambda a, b, r: F.struct(a.alias("src"), b.alias("dst"), F.lit(r).alias("relation"))
    i = F.col("id")
    links = [(site, F.col("sensor_id"), "HAS_MONITORING_POINT"), (F.col("sensor_id"), i, "HAS_MONITORING_SERIES"), (i, asset, "DERIVED_FROM"), (i, report, "HAS_QUALITY_REPORT"), (i, run, "GENERATED_BY"), (report, run, "GENERATED_BY")]
    return nodes, series.select(F.explode(F.array(*[edge(*x) for x in links])).alias("e")).select("e.*").distinct()
