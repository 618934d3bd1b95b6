import pytest

from chronobin.plans.query import QueryBuilder, QueryError, parse

T = "time=100~200"


def test_documented_queries():
    q = parse("time = 178890900 ~ 178891500 & detID = 8 & eventType = 1")
    assert (q.start, q.end, q.lists, q.ranges) == (178890900.0, 178891500.0, {"detID": (8,), "eventType": (1,)}, {})
    q = parse("time=178797000~178797005&detID=0~255&channel=0~255&pulse=97&eventType=0~255")
    assert q.ranges == {"detID": (0, 255), "channel": (0, 255), "eventType": (0, 255)} and q.lists == {"pulse": (97,)}
    assert q.buckets() == (2979950, 2979950)


def test_builder_equals_text():
    b = QueryBuilder().set_time_range(1, 5).set_property_range("channel", "2", "120").set_property_list("detID", ["1", "3"]).build()
    assert b == parse("time=1~5&channel=2~120&detID=1,3")


def test_repeats_and_tolerance():
    q = parse(f"{T}&detID=1&detID=2,3,&detID=4~5&")
    assert q.lists == {"detID": (2, 3)} and q.ranges == {"detID": (4, 5)}
    assert parse(f"{T}&detID=300", wrap=True).lists == {"detID": (44,)}


@pytest.mark.parametrize("text", ["", "detID=1", "time=5", "time=5~", "time=~5", f"{T}&detID=a", f"{T}&detID=-1", f"{T}&foo=1", f"{T}&DETID=1", f"{T}&detID=1,3~5", f"{T}&detID=1,,2", f"{T}&&detID=1", f"{T}&detID=300", f"{T}&{T}", f"{T}&detID=1.5", f"{T}&detID=1~2~3", f"{T}&detID=,"])
def test_rejects(text):
    with pytest.raises(QueryError):
        parse(text)


def test_conjunction_keeps_unmatched_predicates(spark):
    df = spark.createDataFrame([(100.0, 1, 12, 200, 0), (150.0, 2, 12, 130, 1), (201.0, 1, 12, 5, 0)], "time double, detID short, channel short, pulse short, eventType short")
    assert parse(f"{T}&detID=250&channel=12").run(df).count() == 0
    assert [r.time for r in parse(f"{T}&pulse=129~255").run(df).orderBy("time").collect()] == [100.0, 150.0]
    assert parse(f"{T}&detID=5~1").run(df).count() == 0


def test_pushdown(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")  # the plan is read as text
    df = spark.range(100).selectExpr("cast(id as double) * 1000 as time", "cast(id % 256 as short) as detID", "cast(0 as short) as channel", "cast(0 as short) as pulse", "cast(0 as short) as eventType", "cast(id div 86 as int) as day")
    df.write.partitionBy("day").parquet(str(tmp_path / "e"))
    plan = parse("time=1000~90000&detID=1,5&channel=0~3").run(spark.read.parquet(str(tmp_path / "e")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "In(detID" in plan and "GreaterThanOrEqual(time" in plan
