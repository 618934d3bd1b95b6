import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronobin.functions import bits
from chronobin.operators import bitmap, metrics
from chronobin.operators.ring import Ring, hash32, route
from chronobin.plans.query import parse

LOG = "ts_ms long, total_events long"


def test_write_speed(spark):
    log = spark.createDataFrame([(1250, 10), (1300, 15), (1800, 21), (4260, 100), (5249, 130), (6000, 999)], LOG)
    assert [r.events for r in metrics.write_speed(log, 1250, 5250).orderBy("bin").collect()] == [11, 0, 0, 109, 0]
    assert [r.events for r in metrics.write_speed(log, 9000, 10_000).orderBy("bin").collect()] == [0, 0]
    writes = spark.createDataFrame([(1250, 10), (1300, 5), (1800, 6), (4260, 79), (5249, 30), (6000, 869)], "ts_ms long, n long")
    assert [r.events for r in metrics.growth(writes, 1250, 5250).orderBy("bin").collect()] == [11, 0, 0, 109, 0] and [r.events for r in metrics.growth(writes, 9000, 10_000).orderBy("bin").collect()] == [0, 0]
    assert [r.events for r in metrics.write_speed_of_last(log, 1, 5250).orderBy("bin").collect()] == [30, 0]


def test_read_latency(spark):
    log = spark.createDataFrame([(1000, 3), (1999, 4), (3500, 7)], "ts_ms long, delay_ms long")
    assert [r.delay_ms for r in metrics.read_latency(log, 1000, 4000).orderBy("bin").collect()] == [3, 0, 7, 0]


def test_ring(spark):
    ring = Ring([str(i) for i in range(1, 9)], 5)
    df = spark.range(3000).selectExpr("id as k")
    got = {r.k: r.node for r in route(df, "k", ring).collect()}
    order = sorted(ring.points)
    for k in range(3000):
        h = hash32(str(k))
        assert got[k] == ring.node(str(k)) == ring.points[next((p for p in order if p >= h), order[0])]
    ring.remove("3")
    moved = [k for k in range(3000) if ring.node(str(k)) != got[k]]
    assert moved and all(got[k] == "3" for k in moved) and ring.replicas("3") == 0
    assert Ring().node("x") is None and route(df, "k", Ring()).where("node is not null").count() == 0


def test_bitmaps_equal_filters_beyond_one_bitmap(spark):
    rows = spark.range(70_000).selectExpr("id as event_id", "cast(id % 100 as double) as time", "cast(id % 7 as short) as detID", "cast(id % 11 as short) as channel", "cast(200 + id % 3 as short) as pulse", "cast(0 as short) as eventType", "cast(id % 2 as long) as time_bucket")
    index = bitmap.build(rows)
    q = parse("time=0~100&detID=1~3&channel=2,9&pulse=201,202")
    got = bitmap.gather(rows, bitmap.evaluate(index, q))
    want = rows.where(q.predicate())
    assert got.count() == want.count() > 0 and got.select("event_id").exceptAll(want.select("event_id")).count() == 0
    assert bitmap.evaluate(index, parse("time=0~100&detID=250&channel=2")).count() == 0
    with pytest.raises(ValueError):
        bitmap.evaluate(index, parse("time=0~1"))


@settings(max_examples=50, deadline=None)
@given(st.text("01", min_size=1, max_size=70))
def test_bit_strings(s):
    data = bits.pack(s)
    assert bits.unpack(data, len(s)) == s and [bits.get(data, i) for i in range(len(s))] == [c == "1" for c in s] and not bits.get(data, 8 * len(data))


def test_bit_columns(spark):
    a, b = "1100101011", "1010111100"
    df = spark.createDataFrame([(bytearray(bits.pack(a)), bytearray(bits.pack(b)), 10), (None, bytearray(b"\0\0"), 10)], "a binary, b binary, n int")
    r = df.select(bits.bit_and("a", "b").alias("and"), bits.bit_or("a", "b").alias("or"), bits.bit_xor("a", "b").alias("xor"), bits.bit_xnor("a", "b").alias("xnor"), bits.bit_not(F.col("a"), F.col("n")).alias("not"), bits.clear(F.col("a")).alias("clear"), bits.popcount(F.col("a")).alias("count")).collect()
    x, y = (np.array(list(map(int, s))) for s in (a, b))
    show = lambda v: bits.unpack(bytes(v), 10)
    word = lambda v: "".join(map(str, v))
    assert (show(r[0]["and"]), show(r[0]["or"]), show(r[0]["xor"]), show(r[0]["xnor"]), show(r[0]["not"])) == (word(x & y), word(x | y), word(x ^ y), word(1 - (x ^ y)), word(1 - x))
    t = df.select(bits.to_string(F.col("a")).alias("text"), *[bits.bit_at(F.col("a"), F.lit(k)).alias(f"b{k}") for k in (-1, 0, 2, 9, 16)]).collect()
    assert tuple(t[0]) == (a.ljust(16, "0"), False, True, False, True, False) and tuple(t[1]) == (None,) * 6
    assert bytes(r[0]["clear"]) == b"\0\0" and r[0]["count"] == 6 and r[1]["and"] is None
