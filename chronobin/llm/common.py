"""What the operators share: the cluster's shared folder, lineage cuts and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_path, shared_dir

__all__ = ["WORD", "components", "materialise", "release", "scratch_path", "shared_dir", "spread", "tidy", "unused", "word_count"]

#: Words are runs of anything but ASCII blanks (space and 0x09-0x0D).
WORD = r"[^\x20\x09-\x0D]+"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df once as Parquet in the shared folder and read it from there.

    Unlike checkpoint() this computes the plan once, keeps columns prunable and gives the
    optimizer exact sizes. A lost executor costs a re-read, not a recomputation.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._chronobin_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete written tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "_chronobin_path", None)
        if path:
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: Rows and bytes of an Arrow batch of texts, of which some are very long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at a time. Plans read these settings when they run, so the session keeps them; smaller ones of its own stand."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)  # the second may be a size with a unit
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)


def tidy(run):
    """run(batches) for mapInArrow, after which the worker, which outlives its task, gives its free memory back."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library can
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


#: Bytes of input a core under which a scan is dealt out before Python work.
SMALL = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input, often one file and so one task, dealt evenly to all cores; larger inputs as they are."""
    small_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL else df


def unused(name: str, df: DataFrame) -> str:
    """The name, with as many underscores before it as it takes to be no column's."""
    while name in df.columns:
        name = "_" + name
    return name


def word_count(text: Column) -> Column:
    """Number of words of a text, null counting as empty; words shrink to a letter each, no string is made of any."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(inner, WORD + r"[\x20\x09-\x0D]*+", "w")).cast("long")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges(u, v) as (node, label): equal labels mean connected.

    Randomised contraction (Boegeholz, Brand and Todor, 2020): in each round every node points
    to the node of least hash among itself and its neighbours, and the edges are rewritten
    between those representatives. The hash order changes with the round, so chains shrink
    geometrically and stars collapse at once. Minima are partially aggregated before any
    shuffle and hub nodes meet only in joins, which AQE may split. Every round is written to
    the shared folder; the driver sees one count a round.
    """
    rounds: list[DataFrame] = []
    live = materialise(edges.select("u", "v").where("u <> v").distinct(), name)
    k = 0
    while live.count():
        rank = lambda c, k=k: F.xxhash64(c, F.lit(k))
        both = live.select("u", "v").unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.struct(rank(F.col("v")).alias("h"), F.col("v").alias("r"))).alias("m"))
        own = F.struct(rank(F.col("u")).alias("h"), F.col("u").alias("r"))
        points = materialise(least.select(F.col("u").alias("node"), F.least(own, "m")["r"].alias("r")), name)
        rounds.append(points)
        a = points.select(F.col("node").alias("u"), F.col("r").alias("ru"))
        b = points.select(F.col("node").alias("v"), F.col("r").alias("rv"))
        moved = live.join(a, "u").join(b, "v").where("ru <> rv")
        moved = moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        before, live = live, materialise(moved, name)
        release(before)
        k += 1
    release(live)
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("u").alias("label")).where("false")
    out = rounds[-1].select("node", F.col("r").alias("label"))
    for points in reversed(rounds[:-1]):
        up = out.select(F.col("node").alias("r"), "label")
        out = points.join(up, "r", "left").select("node", F.coalesce("label", "r").alias("label"))
    done = materialise(out, name)
    release(*rounds)
    return done
