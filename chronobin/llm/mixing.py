"""Mixing sources to target weights by hash-threshold histograms; DataFrame operations only.

Targets: the sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share the
whole volume; a target stops at max_epochs times its source's size and the excess is reshared
by weight until none is above: a water level, found by histograms of cap / weight.

A source takes floor(target / size) whole passes and, for the rest, the documents whose hash is
under a threshold. The threshold is found without sorting documents: sizes are summed by
(source, leading hash bits), the bucket in which the running sum passes the budget is refined
by the next bits, and only that bucket's documents are read again, until it holds one hash.
Smaller budgets give lower thresholds, so mixes of one corpus are nested. The document at the
threshold is taken if that brings the sum nearer.

Defined results: null texts have size 0 and are taken 0 times their words; null sources are a
source of their own; a null id hashes as the empty string; rows of equal id share a hash and
are taken or left together; rows that repeat are taken alike; very long texts only count; an
empty table gives an empty mix. Extra columns are kept by apply_mix and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, word_count

WEIGHTS = (5, 2, 1)
#: Hash bits a histogram level resolves, and bits of the hash.
LEVEL_BITS, HASH_BITS = 10, 60
#: Sources of a range, and classes of ratio that the driver sees at once.
LEVELS = 10_000
#: Sources up to which the plan, a row each, is broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 50_000


def row_hash(id_col: Column) -> Column:
    """60 bits of MD5, which any SQL engine has too."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """sources(source, source_size) with target.

    Sources are numbered by ranges of code points: each range is numbered by itself and starts
    after the counts of those before, so no task holds all sources.
    """
    n = sources.count()
    parts = max(1, -(-n // LEVELS))
    ranged = sources.repartitionByRange(parts, F.col("source").asc_nulls_last()) if parts > 1 else sources.coalesce(1)
    ranged = materialise(ranged.withColumn("_p", F.spark_partition_id()), "mix-sources")
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))  # a row a range
    before = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    rn = F.row_number().over(Window.partitionBy("_p").orderBy(F.col("source").asc_nulls_last())) + F.col("_from")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    df = ranged.join(F.broadcast(before), "_p").withColumn("rn", rn).withColumn("w", w).drop("_p", "_from")
    df = materialise(df.withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("w")), "mix-caps")
    release(ranged)
    level = _water_level(df)
    return df.select("source", "source_size", F.when(F.col("ratio") >= F.lit(level), F.lit(level) * F.col("w")).otherwise(F.col("cap").cast("double")).alias("target"))


def _water_level(df: DataFrame) -> float:
    """The level L at which the sum of min(cap, L w) over df(source_size, cap, w, ratio) is the sum of sizes.

    Classes of ratio are (sums of caps and weights); the level lies in the first class whose
    ratio reaches the level that would leave it and all after it open. While classes are more
    than LEVELS, they are summed in LEVELS equal spans of ratio and only spans that may hold the
    level are looked at again: the driver sees LEVELS rows a round.
    """
    all_ = df.agg(F.sum("source_size"), F.sum("w"), F.min("ratio"), F.max("ratio")).first()
    if all_[0] is None:
        return 0.0
    capped, open_w = 0, float(all_[1])

    def level() -> float:
        return (all_[0] - capped) / open_w if open_w else 0.0

    def scan(lo: float, hi: float) -> float | None:
        """The level if a class of lo..hi is the first to reach it; else its classes are capped."""
        nonlocal capped, open_w
        live = df.where(F.col("ratio").between(lo, hi))
        sums = (F.min("ratio").alias("low"), F.max("ratio").alias("high"), F.sum("cap").alias("cap"), F.sum("w").alias("w"))
        rows = live.groupBy("ratio").agg(*sums).orderBy("ratio").limit(LEVELS + 1).collect()
        if len(rows) > LEVELS:
            span = F.least(F.floor((F.col("ratio") - lo) / ((hi - lo) / LEVELS)), F.lit(LEVELS - 1)).alias("k")
            rows = live.groupBy(span).agg(*sums).orderBy("k").collect()
        for r in rows:
            if r["high"] >= level():
                if r["low"] == r["high"]:
                    return level()
                if (found := scan(r["low"], r["high"])) is not None:
                    return found
            else:
                capped, open_w = capped + r["cap"], open_w - r["w"]
        return None

    found = scan(float(all_[2]), float(all_[3]))
    return level() if found is None else found


def mix_plan(docs: DataFrame, source: Column, size: Column, key: Column, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """One row a source: source, source_size, target, passes (whole ones) and threshold (hashes under it are taken once more)."""
    rows = materialise(docs.select(source.alias("source"), size.cast("long").alias("size"), row_hash(key).alias("h")), "mix-rows")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    at = materialise(plan.withColumn("threshold", F.lit(0).cast("long")).withColumn("open", F.lit(True)), "mix-plan")
    few = at.count() <= BROADCAST_SOURCES
    left = HASH_BITS
    while left and not at.where("open").isEmpty():
        left -= LEVEL_BITS
        # Documents of the bucket under refinement: those whose leading bits are the threshold's.
        cut = at.where("open").select(F.col("source").alias("s"), "threshold")
        live = rows.join(F.broadcast(cut) if few else cut, F.col("source").eqNullSafe(F.col("s")))
        live = live.where(F.shiftright("h", left + LEVEL_BITS) == F.shiftright("threshold", left + LEVEL_BITS)).select("source", "size", "h")
        hist = live.groupBy("source", F.shiftright("h", left).alias("bucket")).agg(F.sum("size").alias("sum"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("cum", F.sum("sum").over(upto)).select(F.col("source").alias("s"), "bucket", "sum", "cum", "h0", "h1")
        crossing = hist.join(F.broadcast(at) if few else at, F.col("source").eqNullSafe(F.col("s"))).where("cum > budget")
        crossing = crossing.groupBy("s").agg(F.min(F.struct("bucket", "sum", "cum", "h0", "h1")).alias("x")).select("s", "x.*")
        joined = at.join(crossing, F.col("source").eqNullSafe(F.col("s")), "left")
        single = F.col("h0") == F.col("h1")
        rest = F.col("budget") - (F.col("cum") - F.col("sum"))
        over = F.when(single & (rest * 2 >= F.col("sum")), F.col("h1") + 1).otherwise(F.when(single, F.col("h0")).otherwise(F.shiftleft("bucket", left)))
        nxt = joined.select(
            "source", "source_size", "target", "passes",
            F.when(F.col("s").isNull(), F.col("budget")).otherwise(rest).alias("budget"),
            F.when(F.col("s").isNull(), F.col("threshold")).otherwise(over).alias("threshold"),
            (F.col("s").isNotNull() & ~single).alias("open"),
        )
        before, at = at, materialise(nxt, "mix-plan")
        release(before)
    release(rows)
    return at.select("source", "source_size", "target", "passes", "threshold")


def apply_mix(docs: DataFrame, plan: DataFrame, source: Column, key: Column) -> DataFrame:
    """docs with _mix_epochs, the times each is taken, and its source's row of the plan as _mix_*; a filter by threshold, no sort."""
    few = plan.count() <= BROADCAST_SOURCES
    p = plan.select(*[F.col(c).alias(f"_mix_{c}") for c in plan.columns])
    joined = docs.join(F.broadcast(p) if few else p, source.eqNullSafe(F.col("_mix_source")))
    return joined.withColumn("_mix_epochs", F.col("_mix_passes") + (row_hash(key) < F.col("_mix_threshold")).cast("long"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken; its columns as they were."""
    plan = mix_plan(docs, F.col(source_col), word_count(F.col(text_col)), F.col(id_col), weights, max_epochs)
    taken = apply_mix(docs, plan, F.col(source_col), F.col(id_col)).where("_mix_epochs > 0")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_epochs"))).alias("_mix_time")
    return taken.select(*docs.columns, times).select(*docs.columns)


def op2_query(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-docs")
    plan = mix_plan(docs, F.col("source"), F.col("size"), F.col("doc_id"))
    out = apply_mix(docs, plan, F.col("source"), F.col("doc_id"))
    return out.select("doc_id", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("size") * F.col("_mix_epochs")).alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM s),
w AS (SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3 AS cap FROM o),
r AS (SELECT *, cap / w AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(w) OVER (ORDER BY ratio, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
c AS (SELECT ratio AS cr, rn AS cn, level AS cl FROM l WHERE ratio >= level ORDER BY ratio, rn LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN ratio > cr OR (ratio = cr AND rn >= cn) THEN cl * w ELSE cap::DOUBLE END AS target FROM l, c),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
b AS (SELECT *, target - passes * source_size AS budget FROM q),
g AS (SELECT source, h, sum(size) AS here FROM d GROUP BY source, h),
u AS (SELECT *, sum(here) OVER (PARTITION BY source ORDER BY h) AS cum FROM g),
k AS (SELECT u.source, u.h, CASE WHEN cum <= budget OR (cum - here <= budget AND (budget - (cum - here)) * 2 >= here AND cum > budget) THEN 1 ELSE 0 END AS more
      FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, b.source_size, b.target, CAST(d.size * (b.passes + k.more) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""
