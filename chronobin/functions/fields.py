"""Columns derived from events; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DAY, HE, MISSION_EPOCH, EventSchema

TYPES = ("click", "error", "purchase", "signup", "view")


def time_bucket(time: Column, width: float) -> Column:
    return F.floor(time / F.lit(float(width))).cast("long")


def day(time: Column) -> Column:
    return F.floor(time / F.lit(DAY)).cast("int")


def unsigned(value: Column) -> Column:
    """The low byte of an integer, 0..255."""
    return value.bitwiseAND(F.lit(255).cast("long"))


def mission_timestamp(time: Column) -> Column:
    return F.timestamp_micros(F.round((time + MISSION_EPOCH) * 1_000_000).cast("long"))


def utc_micros(column: str, kind: str = "timestamp_ntz") -> Column:
    """Microseconds since 1970 of a timestamp column; one without a zone is UTC, whatever the session's zone is."""
    if kind != "timestamp_ntz":
        return F.unix_micros(F.col(column))
    gap = f"(`{column}` - timestamp_ntz'1970-01-01 00:00:00')"
    return F.expr(f"((extract(DAY FROM {gap}) * 24L + extract(HOUR FROM {gap})) * 60L + extract(MINUTE FROM {gap})) * 60000000L + cast(extract(SECOND FROM {gap}) * 1000000 AS long)")


def mission_time(micros: Column) -> Column:
    return (micros - MISSION_EPOCH * 1_000_000) / F.lit(1_000_000.0)


def csv_line(schema: EventSchema = HE) -> Column:
    """time with six decimals, then the properties."""
    return F.format_string("%f" + ",%d" * len(schema.props), *[F.col(c) for c in schema.columns])


def csv_header(schema: EventSchema = HE) -> str:
    return ",".join(schema.columns)


def volume_gb(events: Column, record_bytes: int = 16) -> Column:
    return F.floor(events * record_bytes / F.lit(1 << 30)).cast("long")


def he_events(events: DataFrame, width: float = HE.width) -> DataFrame:
    """A click-stream table in the shape of high-energy events, with event_id as tie-breaker."""
    out = events.select(
        "event_id",
        mission_time(utc_micros("ts", dict(events.dtypes)["ts"])).alias("time"),
        (F.col("user_id") % 256).cast("short").alias("detID"),
        F.get_json_object("props", "$.k").cast("short").alias("channel"),
        unsigned(F.floor("value").cast("long")).cast("short").alias("pulse"),
        F.coalesce(*[F.when(F.col("event_type") == t, F.lit(i)) for i, t in enumerate(TYPES[:-1])], F.lit(len(TYPES) - 1)).cast("short").alias("eventType"),
    )
    return out.withColumn("time_bucket", time_bucket(F.col("time"), width))
