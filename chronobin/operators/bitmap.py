"""A bitmap index by bucket, property and value in words of 64 bits.

Events are numbered from 0 within their bucket; word w holds positions 64 w to 64 w + 63, least
significant bit first. Only words with a bit set are rows, so an index has at most a row of
some bytes an event and property, whatever the number of values, and building it, OR, AND and
counting are plain aggregates on longs (bit_or, bit_and, bit_count) that combine before any
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.query import EventQuery
from ..schema import HE, EventSchema
from .events import ordinals


def build(events: DataFrame, schema: EventSchema = HE, also: list[str] = ()) -> DataFrame:
    """(time_bucket, prop, value, word, bits) of every value that occurs, and the columns `also`, constant in a bucket."""
    pairs = ", ".join(f"'{p}', {p}" for p in schema.props)
    rows = ordinals(events).select("time_bucket", *also, F.shiftright("pos", 6).alias("word"), F.expr("shiftleft(1L, pos & 63)").alias("bit"), F.expr(f"stack({len(schema.props)}, {pairs}) AS (prop, value)"))
    return rows.groupBy("time_bucket", *also, "prop", "value", "word").agg(F.bit_or("bit").alias("bits"))


def cardinality(index: DataFrame) -> DataFrame:
    """Events by bucket, property and value."""
    return index.groupBy("time_bucket", "prop", "value").agg(F.sum(F.bit_count("bits").cast("long")).alias("events"))


def union(index: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per bucket and property the events that have any of the values."""
    return index.groupBy(*by, "time_bucket", "prop", "word").agg(F.bit_or("bits").alias("bits"))


def evaluate(index: DataFrame, query: EventQuery, first: int | None = None, last: int | None = None, by: list[str] = ()) -> DataFrame:
    """(time_bucket, word, bits) of the events that satisfy the query's property clauses, in the buckets of its range or those given.

    Values of a property are OR-ed, properties AND-ed. A property without any match in a word
    has none there, so a word must have one from every property. by: columns that tell apart
    indexes of their own numbering.
    """
    low, high = query.buckets()
    rows = index.where(F.col("time_bucket").between(low if first is None else first, high if last is None else last))
    conditions, named = None, set(query.ranges) | set(query.lists)
    if not named:
        raise ValueError("no property clause: read the events themselves")
    for name in sorted(named):
        c = F.col("prop") == name
        if name in query.ranges:
            c &= F.col("value").between(*query.ranges[name])
        if name in query.lists:
            c &= F.col("value").isin(*query.lists[name])
        conditions = c if conditions is None else conditions | c
    per_property = union(rows.where(conditions), by)
    both = per_property.groupBy(*by, "time_bucket", "word").agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    return both.where((F.col("n") == len(named)) & (F.col("bits") != 0)).select(*by, "time_bucket", "word", "bits")


def positions(bitmaps: DataFrame) -> DataFrame:
    """(time_bucket, pos) of the set bits, positions from 0."""
    bits = bitmaps.select("time_bucket", "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b")).where("shiftright(bits, b) & 1 = 1")
    return bits.select("time_bucket", (F.col("word") * 64 + F.col("b")).alias("pos"))


def gather(events: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The events whose bits are set: each meets the one word that its position is in."""
    rows = ordinals(events).withColumn("word", F.shiftright("pos", 6))
    return rows.join(bitmaps.select("time_bucket", "word", "bits"), ["time_bucket", "word"]).where("shiftright(bits, pos & 63) & 1 = 1").drop("pos", "word", "bits")
