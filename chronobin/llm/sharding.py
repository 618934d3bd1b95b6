"""Sharding by a hierarchical weighted hash tree; DataFrame operations only.

A tree is a tuple of regions, a region a tuple of racks, a rack a tuple of shard weights;
shards are numbered in that order. A row descends region, rack and shard. At each level every
child draws -ln(u) / weight with u uniform from a hash of the row's id and the child's place,
and the least draw wins, so children win in proportion to their weights and a row costs one
draw a child on its path, not one a shard.

A draw depends on nothing but the id, the child's place and its own weight. If weights change,
rows move only into children whose weight grew or out of those whose weight fell: movement is
confined to those subtrees. `grown` adds a shard as a region of its own, so the only draw that
is new is that shard's and it alone takes rows (law `key`).

Defined results: null texts count 0 bytes and have the CRC of the empty string; rows with a
null id, like rows of one id, go to one shard and differ in slot; rows that repeat take a range
of slots; very long texts only count; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

Tree = tuple[tuple[tuple[float, ...], ...], ...]

#: Two regions of four racks of five equal shards: 40.
TREE: Tree = tuple(tuple((1.0,) * 5 for _ in range(4)) for _ in range(2))
OVERHEAD = 16
#: Rows that one slot bucket should hold at most on average, the least bits of a bucket, rows of a class's part, and bits of the hash that orders slots.
SLOT_ROWS, SLOT_BITS, PART_ROWS, HASH_BITS = 50_000, 6, 50_000, 60


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a new region."""
    return (*tree, ((weight,),))


def shard_count(tree: Tree) -> int:
    return sum(len(rack) for region in tree for rack in region)


def _draw(key: Column, *place: Column) -> Column:
    """-ln(u), u in (0, 1) of 52 bits of MD5, which any SQL engine has too."""
    text = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), *[p.cast("string") for p in place])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return -F.ln((bits + F.lit(0.5)) / F.lit(2.0**52))


def _winner(n: int, draw, weight) -> Column:
    """Number of the child, of n, with the least draw(j) / weight(j); children of weight 0 do not exist."""
    child = lambda j: F.struct(F.when(weight(j) > 0, draw(j) / weight(j)).otherwise(F.lit(float("inf"))).alias("d"), j.alias("k"))
    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), child))["k"]


def _table(values: list, *index: Column) -> Column:
    """A nested list as a literal, looked up by columns; missing places are 0."""

    def lit(v):
        return F.array(*[lit(x) for x in v]) if isinstance(v, list) else F.lit(v)

    out = lit(values)
    for i in index:
        out = F.get(out, i)
    return F.coalesce(out, F.lit(type(_first(values))(0)))


def _first(v):
    return _first(v[0]) if isinstance(v, list) else v


def assign(df: DataFrame, key: str, tree: Tree, into: str) -> DataFrame:
    """df with the shard of each row's key in column `into`; no shuffle."""
    region_w = [sum(sum(rack) for rack in region) for region in tree]
    racks = max(len(region) for region in tree)
    shards = max(len(rack) for region in tree for rack in region)
    rack_w = [[sum(region[j]) if j < len(region) else 0.0 for j in range(racks)] for region in tree]
    shard_w = [[[float(region[j][k]) if j < len(region) and k < len(region[j]) else 0.0 for k in range(shards)] for j in range(racks)] for region in tree]
    first, at = [], 0
    for region in tree:
        first.append([])
        for j in range(racks):
            first[-1].append(at)
            at += len(region[j]) if j < len(region) else 0
    k, r, q = F.col(key), F.col("_region"), F.col("_rack")
    out = df.withColumn("_region", _winner(len(tree), lambda j: _draw(k, F.lit(0), j), lambda j: _table([float(w) for w in region_w], j)))
    out = out.withColumn("_rack", _winner(racks, lambda j: _draw(k, F.lit(1), r, j), lambda j: _table(rack_w, r, j)))
    leaf = _winner(shards, lambda j: _draw(k, F.lit(2), r, q, j), lambda j: _table(shard_w, r, q, j))
    return out.withColumn(into, (_table(first, r, q) + leaf).cast("int")).drop("_region", "_rack")


def slots(rows: DataFrame, total: int, shards: int, into: str = "slot") -> DataFrame:
    """Each of rows(shard, ..., _h, _part, _n) _n times, with a gapless number from 0 within its shard, in order of _h.

    Rows are numbered in (shard, leading bits of _h) groups, which hold a bounded number of
    classes whatever the shard's size, and the groups' counts, a row each, give the offsets.
    Equal rows are one class in parts of up to PART_ROWS rows: a part takes a range of slots and
    parts are dealt out anew before they become rows, so a class of a third of all rows is no
    single task's.
    """
    bits = max(SLOT_BITS, math.ceil(math.log2(max(1.0, total / (shards * SLOT_ROWS)))))
    cols = [c for c in rows.columns if c not in ("_h", "_part", "_n")]
    parts = rows.withColumn("_bucket", F.shiftright("_h", HASH_BITS - bits))
    before = Window.partitionBy("shard", "_bucket").orderBy("_h", *[c for c in cols if c != "shard"], "_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = rows.groupBy("shard", F.shiftright("_h", HASH_BITS - bits).alias("_bucket")).agg(F.sum("_n").alias("_all"))
    earlier = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_from", F.coalesce(F.sum("_all").over(earlier), F.lit(0))).drop("_all")
    starts = parts.join(offsets, ["shard", "_bucket"]).withColumn("_first", (F.col("_from") + F.col("_at")).cast("long"))
    one = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n").cast("long") - 1)).alias(into)
    return starts.repartition("_h", "_part").select(*cols, one)


def shard_documents(docs: DataFrame, tree: Tree = TREE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # What repeats in a partition of the input is counted there, before any shuffle.
    rows = rows.withColumn("_task", F.spark_partition_id()).groupBy("doc_id", "size", "text_crc32", "_task").agg(F.count(F.lit(1)).alias("_count"))
    rows = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_count") / PART_ROWS) - 1)))
    rows = rows.withColumn("_n", F.least(F.lit(PART_ROWS), F.col("_count") - F.col("_chunk") * PART_ROWS)).withColumn("_part", F.struct("_task", "_chunk")).drop("_task", "_chunk", "_count")
    rows = assign(assign(rows, "doc_id", tree, "shard"), "doc_id", grown(tree), "grown_shard")
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32")
    rows = materialise(rows.withColumn("_h", F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")), "shards")
    out = slots(rows, rows.agg(F.sum("_n")).first()[0] or 0, shard_count(tree))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_query(spark, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 of all documents under the law `key`."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_sql() -> str:
    """The same over whole tables in DuckDB; CRC-32 is folded over the bytes, with its table made by its rule."""
    u = lambda *place: f"-ln((CAST('0x' || substr(md5(concat_ws(':', k, {', '.join(place)})), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
    least = lambda n, weights, *place: f"list_aggregate(list_transform(range({n}), lambda j: {{'d': {u(*place, 'CAST(j AS VARCHAR)')} / ({weights})[CAST(j AS INTEGER) + 1], 'j': j}}), 'min').j"
    return rf"""
WITH RECURSIVE t8(i, c, n) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM t8 WHERE n < 8),
tab AS (SELECT list(c ORDER BY i) AS v FROM t8 WHERE n = 8),
b AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, coalesce(text, '') AS text FROM documents),
h AS (SELECT doc_id, k, octet_length(encode(text)) AS n, hex(encode(text)) AS x FROM b),
c AS (SELECT doc_id, k, CAST(n + {OVERHEAD} AS BIGINT) AS size,
        xor(list_reduce(list_transform(regexp_extract_all(x, '..'), lambda y: CAST('0x' || y AS BIGINT)), lambda a, z: xor(a >> 8, v[CAST(xor(a, z) & 255 AS INTEGER) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM h, tab),
r AS (SELECT *, {least(2, '[20.0::DOUBLE, 20]', "'0'")} AS region, {least(3, '[20.0::DOUBLE, 20, 1]', "'0'")} AS grown FROM c),
q AS (SELECT *, {least(4, '[5.0::DOUBLE, 5, 5, 5]', "'1'", 'CAST(region AS VARCHAR)')} AS rack FROM r),
s AS (SELECT *, CAST(region * 20 + rack * 5 + {least(5, '[1.0::DOUBLE, 1, 1, 1, 1]', "'2'", 'CAST(region AS VARCHAR)', 'CAST(rack AS VARCHAR)')} AS INTEGER) AS shard,
        CAST('0x' || substr(md5(concat_ws(':', k, CAST(size AS VARCHAR), CAST(text_crc32 AS VARCHAR))), 1, {HASH_BITS // 4}) AS BIGINT) AS o FROM q)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY o, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  CASE WHEN grown = 2 THEN 40 ELSE shard END AS grown_shard FROM s
"""
