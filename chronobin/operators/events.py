"""Buckets, totals and set operations over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_stats(events: DataFrame) -> DataFrame:
    """Events, first and last time of each bucket."""
    return events.groupBy("time_bucket").agg(F.count(F.lit(1)).alias("count"), F.min("time").alias("start_time"), F.max("time").alias("end_time"))


def prune_buckets(stored: DataFrame, first: int, last: int) -> DataFrame:
    """The buckets from first to last that hold events."""
    return stored.select("time_bucket").where(F.col("time_bucket").between(first, last)).distinct()


def ordinals(events: DataFrame, into: str = "pos") -> DataFrame:
    """Number events from 0 within their bucket, by time and then id."""
    w = Window.partitionBy("time_bucket").orderBy("time", "event_id")
    return events.withColumn(into, F.row_number().over(w) - 1)


def first_and_last(events: DataFrame, condition: Column) -> DataFrame:
    """Per bucket the ids of the first and last event that qualify."""
    key = F.struct("time", "event_id")
    return events.where(condition).groupBy("time_bucket").agg(F.min_by("event_id", key).alias("first_id"), F.max_by("event_id", key).alias("last_id"))


def table_totals(files: DataFrame) -> DataFrame:
    """Files and events of each table and, with a null table, of all."""
    return files.rollup("table").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("events"))


def merge_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """Late or re-sent events join what is stored."""
    return old.unionByName(new)


def merge_replace_overlap(old: DataFrame, new: DataFrame) -> DataFrame:
    """A bucket's new events are put before or after its old ones if their times don't overlap, and replace them if they do."""
    span = lambda df, p: df.groupBy("time_bucket").agg(F.min("time").alias(f"{p}_start"), F.max("time").alias(f"{p}_end"))
    both = span(old, "old").join(span(new, "new"), "time_bucket")
    overlapping = both.where((F.col("new_end") > F.col("old_start")) & (F.col("new_start") < F.col("old_end"))).select("time_bucket")
    return old.join(overlapping, "time_bucket", "left_anti").unionByName(new)


def merge_branches(old: DataFrame, new: DataFrame) -> DataFrame:
    """Which way each bucket of new goes: create, prepend, append or replace."""
    span = lambda df, p: df.groupBy("time_bucket").agg(F.min("time").alias(f"{p}_start"), F.max("time").alias(f"{p}_end"))
    branch = F.when(F.col("old_start").isNull(), "create").when(F.col("new_end") <= F.col("old_start"), "prepend").when(F.col("new_start") >= F.col("old_end"), "append").otherwise("replace")
    return span(new, "new").join(span(old, "old"), "time_bucket", "left").select("time_bucket", branch.alias("branch"))
