"""Write speed and read latency per second from the start of a range, empty bins included.

Speed is the growth of the cumulative event count. Within a bin the differences telescope, so a
bin needs only its last count and the last one of the bin before; no window runs over the log.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _bins(spark: SparkSession, start_ms: int, end_ms: int) -> DataFrame:
    return spark.range(end_ms // 1000 - start_ms // 1000 + 1).withColumnRenamed("id", "bin")


def _binned(log: DataFrame, start_ms: int, end_ms: int, bin_ms: int = 1000) -> DataFrame:
    inside = log.where((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms))
    return inside.withColumn("bin", F.floor((F.col("ts_ms") - start_ms) / bin_ms).cast("long"))


def write_speed(log: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """(bin, events) from log(ts_ms, total_events); the first sample of the range only sets the base."""
    at = F.struct("ts_ms", "total_events")
    ends = _binned(log, start_ms, end_ms).groupBy("bin").agg(F.min_by("total_events", at).alias("first"), F.max_by("total_events", at).alias("last"))
    grown = ends.select("bin", (F.col("last") - F.coalesce(F.lag("last").over(Window.orderBy("bin")), "first")).alias("events"))
    return _bins(log.sparkSession, start_ms, end_ms).join(grown, "bin", "left").select("bin", F.coalesce("events", F.lit(0)).alias("events"))


def read_latency(log: DataFrame, start_ms: int, end_ms: int, bins: DataFrame | None = None, bin_ms: int = 1000) -> DataFrame:
    """(bin, delay_ms) from log(ts_ms, delay_ms): the mean, rounded toward zero, 0 without queries."""
    mean = _binned(log, start_ms, end_ms, bin_ms).groupBy("bin").agg(F.expr("sum(delay_ms) div count(1)").alias("delay_ms"))
    bins = _bins(log.sparkSession, start_ms, end_ms) if bins is None else bins
    return bins.join(mean, "bin", "left").select("bin", F.coalesce("delay_ms", F.lit(0)).cast("long").alias("delay_ms"))


def growth(log: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """(bin, events) from log(ts_ms, n), the events of each write: as write_speed of their running total, without the running sum."""
    inside = _binned(log, start_ms, end_ms)
    first = inside.agg(F.min("ts_ms").alias("base"))  # one row
    sums = inside.join(F.broadcast(first), F.col("ts_ms") > F.col("base")).groupBy("bin").agg(F.sum("n").alias("events"))
    return _bins(log.sparkSession, start_ms, end_ms).join(sums, "bin", "left").select("bin", F.coalesce("events", F.lit(0)).cast("long").alias("events"))


def last(seconds: int, now_ms: int | None = None) -> tuple[int, int]:
    """The range of the last seconds, now by default."""
    now_ms = int(time.time() * 1000) if now_ms is None else now_ms
    return now_ms - seconds * 1000, now_ms


def write_speed_of_last(log: DataFrame, seconds: int, now_ms: int | None = None) -> DataFrame:
    return write_speed(log, *last(seconds, now_ms))


def read_latency_of_last(log: DataFrame, seconds: int, now_ms: int | None = None) -> DataFrame:
    return read_latency(log, *last(seconds, now_ms))


def cumulative(log: DataFrame, by: str = "table") -> DataFrame:
    """log(table, ts_ms, n) with the running total of each table."""
    w = Window.partitionBy(by).orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("total_events", F.sum("n").over(w))
