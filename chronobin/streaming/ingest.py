"""Streaming front ends: files of events merged batch by batch, and windowed counts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import mission_timestamp
from ..store import EventStore


def stream_into(store: EventStore, table: str, folder: str, checkpoint: str, mode: str = "merge", schema=None):
    """Start merging Parquet files of events that arrive in a folder; no watermark, so lateness is unbounded.

    A batch is written under the name of its stream, which the checkpoint holds, and its number,
    and committed with its events: repeated after a failure it is not written twice, and streams
    into one table, or one begun anew with another checkpoint, never take each other's batches
    for their own.
    """
    spark: SparkSession = store.spark
    source = spark.readStream.schema(schema or store.schema.spark()).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            stream = json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]
            store.write(table, batch, mode, batch=f"{stream}-{number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, seconds: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """Events per tumbling window of a stream (or table), dropping what is later than `late`."""
    at = mission_timestamp(F.col("time"))
    stamped = events.withColumn("at", at).withWatermark("at", late)
    return stamped.groupBy(F.window("at", f"{seconds} seconds")).agg(F.count(F.lit(1)).alias("events")).select("window.start", "window.end", "events")
