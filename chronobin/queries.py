"""Queries of the event store over the driver's tables, with the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bits, fields
from .operators import bitmap, events, metrics, ring
from .plans.query import QueryBuilder, parse
from .schema import HE
from .scratch import scratch_path
from .sources import fits
from .store import EventStore

#: Mission seconds of 2024-01-01 and of 30 days later.
START, END = 378_691_200, 381_283_200
EPOCH_MS = 1_704_067_200_000
HOUR = HE.with_width(3600.0)

_HE = """
he AS (SELECT event_id, (epoch_us(ts) - 1325376000000000) / 1000000.0 AS time,
  CAST(user_id % 256 AS SMALLINT) AS "detID", CAST(json_extract_string(props, '$.k') AS SMALLINT) AS channel,
  CAST(CAST(floor(value) AS BIGINT) & 255 AS SMALLINT) AS pulse,
  CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS SMALLINT) AS "eventType" FROM events),
h60 AS (SELECT *, CAST(floor(time / 60.0) AS BIGINT) AS time_bucket FROM he),
h3600 AS (SELECT *, CAST(floor(time / 3600.0) AS BIGINT) AS time_bucket FROM he)
"""
_COLS = 'time, "detID", channel, pulse, "eventType"'


def _he(spark: SparkSession, sf: str, width: float = 60.0) -> DataFrame:
    return fields.he_events(spark.read.parquet(f"{sf}/events.parquet"), width)


def _text(query: str):
    return lambda spark, sf: parse(query).run(_he(spark, sf))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a log: milliseconds and a running total in order of time."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    rows = e.select(F.floor(fields.utc_micros("ts", dict(e.dtypes)["ts"]) / 1000).alias("ts_ms"), F.col("event_id").alias("total_events"), F.floor("value").cast("long").alias("delay_ms"))
    return rows


_LOG = "lg AS (SELECT CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ts_ms, event_id AS total_events, CAST(floor(value) AS BIGINT) AS delay_ms FROM events)"
#: An hour and a second that begin off the whole second.
S0, S1 = EPOCH_MS + 3_600_250, EPOCH_MS + 7_200_250


def _write_speed(spark, sf):
    return metrics.write_speed(_log(spark, sf).groupBy("ts_ms").agg(F.max("total_events").alias("total_events")), S0, S1)


def _read_latency(spark, sf):
    n, bin_ms = 31, 86_400_000
    bins = spark.range(n).withColumnRenamed("id", "bin")
    return metrics.read_latency(_log(spark, sf), EPOCH_MS, EPOCH_MS + n * bin_ms, bins, bin_ms)


def _files(spark, sf):
    """Each user's events as a file of its region's table."""
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("rows")).select(F.col("event_type").alias("table"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), "rows")


_FILES = "fl AS (SELECT event_type AS \"table\", 'u' || CAST(user_id AS VARCHAR) AS file, count(*) AS rows FROM events GROUP BY 1, 2)"


def _split(spark, sf):
    """Old and new events whose buckets take all three ways of a merge."""
    he = _he(spark, sf, 3600.0)
    b, later = F.col("time_bucket"), F.col("time") - F.col("time_bucket") * 3600 >= 1800
    # All of every fifth bucket is old, so some buckets have no new events.
    old = F.when(b % 5 == 0, True).when(b % 3 == 0, later).when(b % 3 == 1, ~later).otherwise(F.col("event_id") % 2 == 0)
    return he.where(old), he.where(~old)


_SPLIT = """
sp AS (SELECT *, CASE WHEN time_bucket % 5 = 0 THEN true WHEN time_bucket % 3 = 0 THEN time - time_bucket * 3600 >= 1800 WHEN time_bucket % 3 = 1 THEN NOT (time - time_bucket * 3600 >= 1800) ELSE event_id % 2 = 0 END AS is_old FROM h3600),
old AS (SELECT * EXCLUDE is_old FROM sp WHERE is_old), new AS (SELECT * EXCLUDE is_old FROM sp WHERE NOT is_old),
so AS (SELECT time_bucket, min(time) AS os, max(time) AS oe FROM old GROUP BY 1), sn AS (SELECT time_bucket, min(time) AS ns, max(time) AS ne FROM new GROUP BY 1)
"""

_BITS = parse(f"time={START}~{END}&detID=0~60&channel=10~70&eventType=0,2,3", HOUR)
_BITS_SQL = f"time BETWEEN {START} AND {END} AND \"detID\" BETWEEN 0 AND 60 AND channel BETWEEN 10 AND 70 AND \"eventType\" IN (0, 2, 3)"


def _bitmap_and(spark, sf):
    found = bitmap.evaluate(bitmap.build(_he(spark, sf, 3600.0)), _BITS)
    return found.groupBy("time_bucket").agg(F.sum(F.bit_count("bits").cast("long")).alias("events"))


def _bitmap_or(spark, sf):
    index = bitmap.build(_he(spark, sf, 3600.0)).where((F.col("prop") == "pulse") & F.col("value").between(128, 255))
    return bitmap.union(index).groupBy("time_bucket").agg(F.sum(F.bit_count("bits").cast("long")).alias("events"))


def _bitmap_rows(spark, sf):
    he = _he(spark, sf, 3600.0)
    return bitmap.gather(he, bitmap.evaluate(bitmap.build(he), _BITS)).select("event_id", *HE.columns)


def _build_query(spark, sf):
    q = QueryBuilder().set_time_range(START, START + 864_000).set_property_range("channel", "2", "120").set_property_list("detID", ["1", "3", "5", "7", "9"]).build()
    return q.run(_he(spark, sf))


def _ring(n: int = 8) -> ring.Ring:
    return ring.Ring([str(i) for i in range(1, n + 1)], 5)


def _ring_sql(r: ring.Ring) -> str:
    points = ", ".join(f"({h}, '{n}')" for h, n in sorted(r.points.items()))
    return f"""WITH {_HE}, r(h, node) AS (VALUES {points}),
    k AS (SELECT DISTINCT time_bucket, CAST('0x' || substr(md5(CAST(time_bucket AS VARCHAR)), 1, 8) AS BIGINT) AS kh FROM h3600)
    SELECT k.time_bucket, coalesce(arg_min(node, h) FILTER (h >= kh), arg_min(node, h)) AS node FROM k, r GROUP BY k.time_bucket, kh"""


def _changed_ring() -> ring.Ring:
    """One node gone, another with more replicas."""
    r = _ring()
    r.remove("3")
    r.add("5", 7)
    return r


def _store(spark: SparkSession, splits: int = 4) -> EventStore:
    store = EventStore(spark, scratch_path(spark, "store"))
    store.init()
    store.create_table("he", splits, 3600.0)
    return store


def _store_replace(spark, sf):
    """Old events stored in two batches, new ones put over them; some buckets are overlapped, some not."""
    store = _store(spark)
    old, new = _split(spark, sf)
    store.write("he", old.where("event_id % 3 = 0"))
    store.write("he", old.where("event_id % 3 <> 0"))
    store.write("he", new, "replace_overlap")
    return store.events("he").select("event_id", "time_bucket")


def _store_compact(spark, sf):
    """Five batches become one, which then holds what all five held."""
    store = _store(spark)
    he = _he(spark, sf)
    for k in range(5):
        store.write("he", he.where(f"event_id % 5 = {k}"))
    store.compact("he")
    return store.events("he").select("event_id", *HE.columns)


def _store_index(spark, sf):
    """Counts from the stored index, with events at the edges of the range read themselves."""
    store = _store(spark)
    he = _he(spark, sf)
    store.write("he", he.where("event_id % 2 = 0"))
    store.build_index("he")
    store.write("he", he.where("event_id % 2 = 1"))
    n = store.count("he", f"time={START + 1800}~{END - 1800}&channel=10~50&eventType=0,1")
    return spark.createDataFrame([(n,)], "events long")


def _store_tables(spark, sf):
    """A table for each type of event, one of them dropped; how many events each has."""
    store = EventStore(spark, scratch_path(spark, "store"))
    store.init()
    he = _he(spark, sf)
    for k, kind in enumerate(fields.TYPES):
        store.create_table(kind, 2)
        store.write(kind, he.where(f"eventType = {k}"))
    store.drop_table("view")
    return spark.createDataFrame([(t,) for t in store.tables()], "table string").join(store.log("write_log").groupBy("table").agg(F.sum("n").alias("events")), "table")


def _fits_ingest(spark, sf):
    """FITS files ingested into a table, and the catalog's count of them."""
    folder = scratch_path(spark, "fits")
    fits.write_events(_he(spark, sf).repartition(4, "event_id"), folder)
    store = _store(spark)
    store.ingest("he", folder)
    total = store.totals().where("table = 'he'").select(F.col("events").alias("catalogued"))
    return store.query("he", f"time={START}~{END}&pulse=100~255").crossJoin(F.broadcast(total))


def _stream_ingest(spark, sf):
    """Events that arrive as files in two folders, merged by two streams into one table."""
    from .streaming.ingest import stream_into

    store = _store(spark)
    he = _he(spark, sf).select(*HE.columns, "event_id")
    for k in range(2):
        folder = scratch_path(spark, "arrive")
        he.where(f"event_id % 2 = {k}").drop("event_id").repartition(3).write.parquet(folder)
        stream_into(store, "he", folder, scratch_path(spark, "offsets")).awaitTermination()
    return store.query("he", f"time={START}~{END}")


def _bit_arrays(spark, sf):
    """Two-byte arrays of the properties, combined and read bit by bit."""
    hx = lambda a, b: F.unhex(F.concat(*[F.lpad(F.hex(F.col(c).cast("int")), 2, "0") for c in (a, b)]))
    rows = _he(spark, sf).select("event_id", hx("detID", "channel").alias("a"), hx("pulse", "eventType").alias("b"))
    show = lambda c: F.hex(c)
    return rows.select(
        "event_id", show(bits.bit_and("a", "b")).alias("a_and_b"), show(bits.bit_or("a", "b")).alias("a_or_b"), show(bits.bit_xor("a", "b")).alias("a_xor_b"), show(bits.bit_xnor("a", "b")).alias("a_xnor_b"),
        show(bits.bit_not(F.col("a"), F.lit(12))).alias("not_a"), show(bits.clear(F.col("a"))).alias("cleared"), bits.popcount(F.col("a")).alias("ones"), bits.to_string(F.col("a")).alias("text"), bits.bit_at(F.col("a"), F.lit(6)).alias("sixth"),
    )


def _he_sql(where: str, cols: str = _COLS, table: str = "h60") -> str:
    return f"WITH {_HE} SELECT {cols} FROM {table} WHERE {where}"


def _fits_scan(spark, sf):
    """Events written as FITS files and read back."""
    folder = scratch_path(spark, "fits")
    fits.write_events(_he(spark, sf).repartition(4, "event_id"), folder)
    return fits.read_events(spark, folder).select(*HE.columns)


def _fits_headers(spark, sf):
    folder = scratch_path(spark, "fits")
    fits.write_events(_he(spark, sf).repartition(4, "event_id"), folder)
    heads = fits.read_headers(spark, folder)
    return heads.agg(F.sum("rows").alias("rows"), F.max("evt_length").cast("long").alias("evt_length"), F.min("tstart").alias("tstart"), F.max("tstop").alias("tstop"))


def _store_query(spark, sf):
    """Two halves of the events ingested into a table, then a query with pruned partitions."""
    store = EventStore(spark, scratch_path(spark, "store"))
    store.init()
    store.create_table("he", 4)
    he = _he(spark, sf)
    store.write("he", he.where("event_id % 2 = 0"))
    store.write("he", he.where("event_id % 2 = 1"))
    return store.query("he", f"time={START}~{START + 864000}&channel=10~50&eventType=0,1")


_T = f"time BETWEEN {START} AND {END}"

#: name: (query, SQL)
_ALL: dict = {
    "md_query_full": (_text(f"time={START}~{END}&detID=1,2,3,5,8&channel=10~50&pulse=0~255&eventType=0~3"), _he_sql(_T + ' AND "detID" IN (1,2,3,5,8) AND channel BETWEEN 10 AND 50 AND pulse BETWEEN 0 AND 255 AND "eventType" BETWEEN 0 AND 3')),
    "time_range": (_text(f"time={START}~{START + 86400}"), _he_sql(f"time BETWEEN {START} AND {START + 86400}")),
    "time_range_empty": (_text("time=178797000~178797005&detID=1,2"), _he_sql("time BETWEEN 178797000 AND 178797005")),
    "prop_eq": (_text(f"time={START}~{END}&detID=8"), _he_sql(_T + ' AND "detID" = 8')),
    "prop_in": (_text(f"time={START}~{END}&detID=1,3,5,7,9"), _he_sql(_T + ' AND "detID" IN (1,3,5,7,9)')),
    "prop_range": (_text(f"time={START}~{END}&channel=2~20"), _he_sql(_T + " AND channel BETWEEN 2 AND 20")),
    "prop_range_and_list_same_prop": (_text(f"time={START}~{END}&channel=2~20&channel=1,5,9,21"), _he_sql(_T + " AND channel BETWEEN 2 AND 20 AND channel IN (1,5,9,21)")),
    "prop_range_empty": (_text(f"time={START}~{END}&channel=20~2"), _he_sql(_T + " AND channel BETWEEN 20 AND 2")),
    "prop_high_values": (_text(f"time={START}~{END}&pulse=200~255"), _he_sql(_T + " AND pulse BETWEEN 200 AND 255")),
    "md_query_nomatch_pred": (_text(f"time={START}~{END}&detID=255&channel=12"), _he_sql(_T + ' AND "detID" = 255 AND channel = 12')),
    "builder_query": (_build_query, _he_sql(f'time BETWEEN {START} AND {START + 864000} AND channel BETWEEN 2 AND 120 AND "detID" IN (1,3,5,7,9)')),
    "set_union": (lambda s, d: _he(s, d).where("detID = 1 OR channel = 12").select("event_id", *HE.columns), _he_sql('"detID" = 1 OR channel = 12', "event_id, " + _COLS)),
    "set_intersect": (lambda s, d: _he(s, d).where("eventType = 1").select("time_bucket").intersect(_he(s, d).where("channel < 50").select("time_bucket")), f'WITH {_HE} SELECT time_bucket FROM h60 WHERE "eventType" = 1 INTERSECT SELECT time_bucket FROM h60 WHERE channel < 50'),
    "set_complement": (lambda s, d: _he(s, d).select("event_id").exceptAll(_he(s, d).where("detID < 100").select("event_id")), f'WITH {_HE} SELECT event_id FROM h60 EXCEPT ALL SELECT event_id FROM h60 WHERE "detID" < 100'),
    "symmetric_difference": (lambda s, d: _he(s, d).where("(detID < 50) <> (channel < 50)").select("event_id"), _he_sql('("detID" < 50) <> (channel < 50)', "event_id")),
    "result_count": (lambda s, d: parse(f"time={START}~{END}&channel=2~50").run(_he(s, d)).agg(F.count(F.lit(1)).alias("events")), _he_sql(_T + " AND channel BETWEEN 2 AND 50", "count(*) AS events")),
    "bucket_assign": (lambda s, d: _he(s, d).select("event_id", "time", "time_bucket"), f"WITH {_HE} SELECT event_id, time, time_bucket FROM h60"),
    "bucket_stats": (lambda s, d: events.bucket_stats(_he(s, d)), f'WITH {_HE} SELECT time_bucket, count(*) AS "count", min(time) AS start_time, max(time) AS end_time FROM h60 GROUP BY 1'),
    "bucket_prune": (lambda s, d: events.prune_buckets(_he(s, d), START // 60, (START + 86400) // 60), f"WITH {_HE} SELECT DISTINCT time_bucket FROM h60 WHERE time_bucket BETWEEN {START // 60} AND {(START + 86400) // 60}"),
    "bucket_ordinals": (lambda s, d: events.ordinals(_he(s, d, 3600.0)).select("event_id", "time_bucket", "pos"), f"WITH {_HE} SELECT event_id, time_bucket, CAST(row_number() OVER (PARTITION BY time_bucket ORDER BY time, event_id) - 1 AS INTEGER) AS pos FROM h3600"),
    "first_last_qualifying": (lambda s, d: events.first_and_last(_he(s, d, 3600.0), F.col("channel") < 50), f"WITH {_HE} SELECT time_bucket, first(event_id ORDER BY time, event_id) AS first_id, last(event_id ORDER BY time, event_id) AS last_id FROM h3600 WHERE channel < 50 GROUP BY 1"),
    "bitmap_cardinality": (lambda s, d: bitmap.cardinality(bitmap.build(_he(s, d, 3600.0))), f"""WITH {_HE}, u AS (SELECT time_bucket, 'detID' AS prop, "detID" AS value FROM h3600 UNION ALL SELECT time_bucket, 'channel', channel FROM h3600 UNION ALL SELECT time_bucket, 'pulse', pulse FROM h3600 UNION ALL SELECT time_bucket, 'eventType', "eventType" FROM h3600) SELECT time_bucket, prop, value, count(*) AS events FROM u GROUP BY 1, 2, 3"""),
    "bitmap_or": (_bitmap_or, _he_sql("pulse BETWEEN 128 AND 255 GROUP BY time_bucket", "time_bucket, count(*) AS events", "h3600")),
    "bitmap_and": (_bitmap_and, _he_sql(_BITS_SQL + " GROUP BY time_bucket", "time_bucket, count(*) AS events", "h3600")),
    "bitmap_query_rows": (_bitmap_rows, _he_sql(_BITS_SQL, "event_id, " + _COLS, "h3600")),
    "table_totals": (lambda s, d: events.table_totals(_files(s, d)), f'WITH {_FILES} SELECT "table", count(*) AS files, CAST(sum(rows) AS BIGINT) AS events FROM fl GROUP BY ROLLUP ("table")'),
    "table_list": (lambda s, d: _files(s, d).select("table").distinct(), f'WITH {_FILES} SELECT DISTINCT "table" FROM fl'),
    "file_list": (lambda s, d: _files(s, d).where("table = 'click'").select("file"), f"WITH {_FILES} SELECT file FROM fl WHERE \"table\" = 'click'"),
    "volume_gb": (lambda s, d: _he(s, d).agg(F.count(F.lit(1)).alias("events")).select("events", fields.volume_gb(F.col("events") * 1_000_000).alias("gb")), f"WITH {_HE} SELECT count(*) AS events, count(*) * 1000000 * 16 // 1073741824 AS gb FROM h60"),
    "write_speed": (_write_speed, f"""WITH {_LOG}, w AS (SELECT ts_ms, max(total_events) AS total FROM lg WHERE ts_ms >= {S0} AND ts_ms < {S1} GROUP BY 1),
        g AS (SELECT (ts_ms - {S0}) // 1000 AS bin, total - lag(total) OVER (ORDER BY ts_ms) AS n FROM w)
        SELECT b.bin, CAST(coalesce(sum(n), 0) AS BIGINT) AS events FROM (SELECT unnest(generate_series(0, {S1 // 1000 - S0 // 1000})) AS bin) b LEFT JOIN g ON b.bin = g.bin GROUP BY b.bin"""),
    "read_latency": (_read_latency, f"""WITH {_LOG}, g AS (SELECT (ts_ms - {EPOCH_MS}) // 86400000 AS bin, CAST(sum(delay_ms) AS BIGINT) // count(*) AS delay_ms FROM lg WHERE ts_ms >= {EPOCH_MS} AND ts_ms < {EPOCH_MS + 31 * 86_400_000} GROUP BY 1)
        SELECT b.bin, CAST(coalesce(delay_ms, 0) AS BIGINT) AS delay_ms FROM (SELECT unnest(generate_series(0, 30)) AS bin) b LEFT JOIN g ON b.bin = g.bin"""),
    "cumulative_total": (lambda s, d: metrics.cumulative(s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("table"), F.col("event_id").alias("ts_ms"), F.lit(1).cast("long").alias("n"))).select("table", "ts_ms", "total_events"), 'SELECT event_type AS "table", event_id AS ts_ms, CAST(count(*) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_events FROM events'),
    "merge_union": (lambda s, d: events.merge_union(*_split(s, d)).select("event_id", "time_bucket"), f"WITH {_HE}, {_SPLIT} SELECT event_id, time_bucket FROM old UNION ALL SELECT event_id, time_bucket FROM new"),
    "merge_replace_overlap": (lambda s, d: events.merge_replace_overlap(*_split(s, d)).select("event_id", "time_bucket"), f"WITH {_HE}, {_SPLIT}, x AS (SELECT time_bucket FROM so JOIN sn USING (time_bucket) WHERE ne > os AND ns < oe) SELECT event_id, time_bucket FROM old WHERE time_bucket NOT IN (SELECT time_bucket FROM x) UNION ALL SELECT event_id, time_bucket FROM new"),
    "merge_branches": (lambda s, d: events.merge_branches(*_split(s, d)), f"WITH {_HE}, {_SPLIT} SELECT time_bucket, CASE WHEN os IS NULL THEN 'create' WHEN ne <= os THEN 'prepend' WHEN ns >= oe THEN 'append' ELSE 'replace' END AS branch FROM sn LEFT JOIN so USING (time_bucket)"),
    "ring_route": (lambda s, d: ring.route(_he(s, d, 3600.0).select("time_bucket").distinct(), "time_bucket", _ring()), _ring_sql(_ring())),
    "unsigned_wrap": (lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", fields.unsigned(F.col("event_id")).alias("low_byte"), fields.unsigned(-F.col("event_id")).alias("negative")), "SELECT event_id, event_id & 255 AS low_byte, (-event_id) & 255 AS negative FROM events"),
    "mission_time": (lambda s, d: _he(s, d).select("event_id", fields.mission_timestamp(F.col("time")).alias("at")).select("event_id", F.unix_micros("at").alias("at_us")), "SELECT event_id, epoch_us(ts) AS at_us FROM events"),
    "csv_line": (lambda s, d: _he(s, d).select("event_id", fields.csv_line().alias("line")), f"WITH {_HE} SELECT event_id, printf('%.6f,%d,%d,%d,%d', time, \"detID\", channel, pulse, \"eventType\") AS line FROM h60"),
    "tumbling_counts": (lambda s, d: _he(s, d, 3600.0).groupBy(F.window(fields.mission_timestamp(F.col("time")), "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("events")).select(F.unix_micros("w.start").alias("start_us"), "events"), "SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, count(*) AS events FROM events GROUP BY 1"),
    "fits_scan": (_fits_scan, f"WITH {_HE} SELECT {_COLS} FROM h60"),
    "fits_headers": (_fits_headers, f"WITH {_HE} SELECT count(*) AS rows, CAST(16 AS BIGINT) AS evt_length, CAST(floor(min(time)) AS BIGINT) AS tstart, CAST(floor(max(time)) AS BIGINT) AS tstop FROM h60"),
    "store_query": (_store_query, _he_sql(f'time BETWEEN {START} AND {START + 864000} AND channel BETWEEN 10 AND 50 AND "eventType" IN (0, 1)')),
    "store_replace_overlap": (_store_replace, f"WITH {_HE}, {_SPLIT}, x AS (SELECT time_bucket FROM so JOIN sn USING (time_bucket) WHERE ne > os AND ns < oe) SELECT event_id, time_bucket FROM old WHERE time_bucket NOT IN (SELECT time_bucket FROM x) UNION ALL SELECT event_id, time_bucket FROM new"),
    "store_compact": (_store_compact, f"WITH {_HE} SELECT event_id, {_COLS} FROM h60"),
    "store_index_count": (_store_index, _he_sql(f'time BETWEEN {START + 1800} AND {END - 1800} AND channel BETWEEN 10 AND 50 AND "eventType" IN (0, 1)', "count(*) AS events")),
    "store_tables": (_store_tables, "SELECT event_type AS \"table\", count(*) AS events FROM events WHERE event_type <> 'view' GROUP BY 1"),
    "fits_ingest": (_fits_ingest, f"WITH {_HE} SELECT {_COLS}, (SELECT count(*) FROM he) AS catalogued FROM h60 WHERE pulse BETWEEN 100 AND 255"),
    "stream_ingest": (_stream_ingest, f"WITH {_HE} SELECT {_COLS} FROM h60"),
    "bit_arrays": (_bit_arrays, f"""WITH {_HE}, w AS (SELECT event_id, CAST("detID" AS INTEGER) * 256 + channel AS a, CAST(pulse AS INTEGER) * 256 + "eventType" AS b FROM he)
        SELECT event_id, printf('%04X', a & b) AS a_and_b, printf('%04X', a | b) AS a_or_b, printf('%04X', xor(a, b)) AS a_xor_b, printf('%04X', 65535 - xor(a, b)) AS a_xnor_b,
        printf('%04X', (65535 - a) & 65520) AS not_a, '0000' AS cleared, CAST(bit_count(a) AS BIGINT) AS ones, lpad(bin(a), 16, '0') AS text, (a >> 9) & 1 = 1 AS sixth FROM w"""),
    "ring_changed": (lambda s, d: ring.route(_he(s, d, 3600.0).select("time_bucket").distinct(), "time_bucket", _changed_ring()), _ring_sql(_changed_ring())),
    "write_speed_of_last": (lambda s, d: metrics.write_speed_of_last(_log(s, d).groupBy("ts_ms").agg(F.max("total_events").alias("total_events")), 7200, S1), f"""WITH {_LOG}, w AS (SELECT ts_ms, max(total_events) AS total FROM lg WHERE ts_ms >= {S1 - 7_200_000} AND ts_ms < {S1} GROUP BY 1),
        g AS (SELECT (ts_ms - {S1 - 7_200_000}) // 1000 AS bin, total - lag(total) OVER (ORDER BY ts_ms) AS n FROM w)
        SELECT b.bin, CAST(coalesce(sum(n), 0) AS BIGINT) AS events FROM (SELECT unnest(generate_series(0, 7200)) AS bin) b LEFT JOIN g ON b.bin = g.bin GROUP BY b.bin"""),
    "read_latency_of_last": (lambda s, d: metrics.read_latency_of_last(_log(s, d), 7200, S1), f"""WITH {_LOG}, g AS (SELECT (ts_ms - {S1 - 7_200_000}) // 1000 AS bin, CAST(sum(delay_ms) AS BIGINT) // count(*) AS delay_ms FROM lg WHERE ts_ms >= {S1 - 7_200_000} AND ts_ms < {S1} GROUP BY 1)
        SELECT b.bin, CAST(coalesce(delay_ms, 0) AS BIGINT) AS delay_ms FROM (SELECT unnest(generate_series(0, 7200)) AS bin) b LEFT JOIN g ON b.bin = g.bin"""),
    "write_growth": (lambda s, d: metrics.growth(_log(s, d).select("ts_ms", F.lit(1).cast("long").alias("n")), S0, S1), f"""WITH {_LOG}, g AS (SELECT (ts_ms - {S0}) // 1000 AS bin FROM lg WHERE ts_ms < {S1} AND ts_ms > (SELECT min(ts_ms) FROM lg WHERE ts_ms >= {S0}))
        SELECT b.bin, CAST(count(g.bin) AS BIGINT) AS events FROM (SELECT unnest(generate_series(0, {S1 // 1000 - S0 // 1000})) AS bin) b LEFT JOIN g ON b.bin = g.bin GROUP BY b.bin"""),
    "time_order": (lambda s, d: _he(s, d).orderBy("time").select("event_id", "time"), f"WITH {_HE} SELECT event_id, time FROM h60"),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _ALL.items()}
