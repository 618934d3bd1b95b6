import urllib.request
from threading import Thread

import pytest

from chronobin import cli, config, rest
from chronobin.schema import HE, EventSchema
from chronobin.scratch import scratch_path
from chronobin.sources.fits import FitsError, fits_bytes, read_events, read_headers, table_header, write_events
from chronobin.store import EventStore, StoreError
from chronobin.streaming.ingest import stream_into, tumbling_counts

SHAPE = "time double, detID short, channel short, pulse short, eventType short"


@pytest.fixture()
def store(spark, tmp_path):
    s = EventStore(spark, f"file://{tmp_path}/store")
    s.init()
    s.create_table("he", 4)
    return s


def rows(*times):
    return [(float(t), int(t) % 256, 200, 255, 1) for t in times]


def fits_file(folder, name, data, **more):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(fits_bytes(data, start=1, stop=2, **more))


def test_fits_reads_what_was_written(spark, tmp_path):
    fits_file(tmp_path / "f", "a.fits", rows(59.5, 60.25, 119))
    fits_file(tmp_path / "f", "b.fits", rows(60.5, 300))
    (tmp_path / "f" / "sub").mkdir()
    got = read_events(spark, f"file://{tmp_path}/f").collect()
    assert sorted((r.time, r.detID, r.channel, r.pulse, r.eventType, r.source_file) for r in got) == sorted([(*x, "a.fits") for x in rows(59.5, 60.25, 119)] + [(*x, "b.fits") for x in rows(60.5, 300)])
    heads = {r.file: r for r in read_headers(spark, f"{tmp_path}/f").collect()}
    assert heads["a.fits"].rows == 3 and heads["a.fits"].evt_length == 16 and heads["a.fits"].type == "HE" and heads["a.fits"].date_start == "2017-08-31T00:00:00"


def test_fits_faults(spark, tmp_path):
    fits_file(tmp_path / "f", "wide.fits", rows(1), width=20)
    fits_file(tmp_path / "f", "ok.fits", rows(1, 2))
    assert read_events(spark, str(tmp_path / "f")).count() == 2
    assert {r.file: r.error for r in read_headers(spark, str(tmp_path / "f")).collect()} == {"wide.fits": "record width 20", "ok.fits": None}
    whole = fits_bytes(rows(*range(400)))
    (tmp_path / "short.fits").write_bytes(whole[: 2880 * 3])
    with pytest.raises(Exception, match="cut short"):
        read_events(spark, str(tmp_path / "short.fits")).count()
    with pytest.raises(FitsError), open(__file__, "rb") as f:
        table_header(f)


def test_ingest_catalog_and_metrics(spark, store, tmp_path):
    fits_file(tmp_path / "in", "a.fits", rows(59.5, 60.25, 119))
    fits_file(tmp_path / "in", "b.fits", rows(90000, 90001))
    fits_file(tmp_path / "in", "bad.fits", rows(1), width=20)
    rejected = store.ingest("he", f"{tmp_path}/in")
    assert [(r.file, r.error) for r in rejected.collect()] == [("bad.fits", "record width 20")]
    assert [tuple(r) for r in store.totals().orderBy("table").collect()] == [(None, 2, 5), ("he", 2, 5)]
    got, _ = store.timed_query("he", "time=60~90000 & pulse=129~255")
    assert [r.time for r in got] == [60.25, 119.0, 90000.0]
    assert store.log("read_log", "he").count() == 1 and store.log("write_log", "he").first().n == 5
    at = store.log("write_log").first().ts_ms
    assert [r.events for r in store.write_speed(at - 1000, at + 1000).orderBy("bin").collect()] == [0, 0, 0]
    plan = store.query("he", "time=60~100")._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_tables(store):
    store.create_table("heFits", 2)
    store.write("heFits", store.spark.createDataFrame(rows(1), SHAPE))
    store.drop_table("he")
    assert store.tables() == ["heFits"] and store.query("heFits", "time=0~5").count() == 1
    with pytest.raises(StoreError):
        store.query("he", "time=0~5")
    with pytest.raises(StoreError):
        store.init()
    store.create_table("heFits", 2)
    assert store.query("heFits", "time=0~5").count() == 0 and store.log("write_log", "heFits").count() == 0


def test_merge_modes(spark, store):
    df = lambda *t: spark.createDataFrame(rows(*t), SHAPE)
    store.write("he", df(10, 20, 70, 80, 130, 140, 400))
    # bucket 0: later, 1: earlier, 2: overlapping, 6: untouched
    store.write("he", df(30, 61, 135, 150), "replace_overlap")
    assert [r.time for r in store.query("he", "time=0~1000").orderBy("time").collect()] == [10, 20, 30, 61, 70, 80, 135, 150, 400]
    store.write("he", df(135))
    assert store.query("he", "time=135~135").count() == 2


def test_stream(spark, store, tmp_path):
    spark.createDataFrame(rows(10, 70), SHAPE).coalesce(1).write.parquet(f"{tmp_path}/arrive")
    for _ in range(2):
        stream_into(store, "he", f"{tmp_path}/arrive", f"{tmp_path}/ck").awaitTermination()
    spark.createDataFrame(rows(20), SHAPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/arrive")
    stream_into(store, "he", f"{tmp_path}/arrive", f"{tmp_path}/ck").awaitTermination()
    assert [r.time for r in store.query("he", "time=0~100").orderBy("time").collect()] == [10, 20, 70]
    assert [r.events for r in tumbling_counts(store.events("he")).orderBy("start").collect()] == [2, 1]


def test_rest(spark, store):
    store.write("he", spark.createDataFrame(rows(1, 2), SHAPE))
    server = rest.serve(store, 0)
    Thread(target=server.serve_forever, daemon=True).start()
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{p}").read().decode()
    assert get("/he/he?time=0~1.5&pulse=255") == "time,detID,channel,pulse,eventType\n1.000000,1,200,255,1\n"
    assert get("/info?op=tableList") == "he" and get("/info?op=totalEvents") == "0" and get("/info?op=volume") == "0GB"
    assert get("/info?op=writeSpeed&startTimeStamp=1000&endTimeStamp=3000") == "0,0,0"
    assert get("/info?op=readLatencyOfLast&lastSeconds=2").count(",") == 2
    assert "<form" in get("/index.html") and "polyline" in get("/static/charts.html") and rest.answer(store, "/static/../rest.py")[0] == rest.answer(store, "/static/no")[0] == 404
    assert rest.answer(store, "/he/he?detID=1")[0] == 400 and rest.answer(store, "/info?op=x")[0] == 404 and rest.answer(store, "/no")[0] == 404
    server.shutdown()


def test_streams_into_one_table_and_begun_anew(spark, store, tmp_path):
    """Each stream's batch 0 is its own."""
    for k, times in enumerate([(10, 70), (20,), (30,)]):
        spark.createDataFrame(rows(*times), SHAPE).coalesce(1).write.parquet(f"{tmp_path}/arrive{k}")
        stream_into(store, "he", f"{tmp_path}/arrive{k}", f"{tmp_path}/ck{k}").awaitTermination()
    assert [r.time for r in store.query("he", "time=0~100").orderBy("time").collect()] == [10, 20, 30, 70]
    df = spark.createDataFrame(rows(40), SHAPE)
    assert store.write("he", df, batch="s-7") == 1 and store.write("he", df, batch="s-7") == 0 and store.query("he", "time=40~40").count() == 1


def test_writers_side_by_side(spark, store):
    """No writer touches what another has begun, and every commit counts."""
    store.write("he", spark.createDataFrame(rows(5), SHAPE))
    errors = []

    def work(k):
        try:
            store.write("he", spark.createDataFrame(rows(100_000 * k, 100_000 * k + 1), SHAPE), "replace_overlap" if k % 2 else "merge")
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [Thread(target=work, args=(k,)) for k in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and store.events("he").count() == 9 and len(store._commits("he")) == 5
    fs, path = store._path("tables", "he", "events", "batch=lost", "day=0")
    fs.mkdirs(path)
    assert store.vacuum("he") == [] and store.vacuum("he", -60) == ["batch=lost"] and store.events("he").count() == 9


def test_compaction_and_index(spark, store):
    for k in range(6):
        store.write("he", spark.createDataFrame(rows(*range(k, 400, 7)), SHAPE))
    before = sorted(map(tuple, store.events("he").drop("source_file", "event_id").collect()))
    q = "time=61.5~299&detID=3~200&eventType=1"
    want = store.query("he", q).count()
    store.build_index("he")
    assert store.count("he", q) == want > 100 and store.count("he", "time=70~80&detID=71,72") == 2 and store.count("he", "time=0~1000&detID=255") == 1
    assert store.compact("he") == [0] and store.compact("he") == []
    assert sorted(map(tuple, store.events("he").drop("source_file", "event_id").collect())) == before
    assert store.count("he", q) == want
    store.build_index("he")
    assert store.count("he", q) == want
    assert store.write("he", spark.createDataFrame([], SHAPE)) == 0 and store.count("he", q) == want


def test_many_commits_are_read_from_a_checkpoint(store):
    for k in range(205):
        assert store._commit("he", None, f"b{k}", k)
    assert [c["batch"] for c in store._commits("he")] == [f"b{k}" for k in range(205)] and store._exists("tables", "he", "log", "upto-000000199.json")


def test_other_files_stay_and_other_layouts_are_read(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "precious.fits").write_bytes(b"x")
    small = EventSchema(props=("a", "b"), wire=(("a", "u1"), ("time", ">f8"), ("_x", "V2"), ("b", ">i2")))
    df = spark.createDataFrame([(float(t), t % 200, -t) for t in range(1000)], "time double, a short, b short").repartition(2)
    names = write_events(df, f"file://{tmp_path}/out", small, rows=300)
    assert len(names) >= 4 and {p.name for p in (tmp_path / "out").iterdir()} == {*names, "precious.fits"}
    (tmp_path / "out" / "precious.fits").unlink()
    got = read_events(spark, f"file://{tmp_path}/out", small)
    assert sorted(map(tuple, got.select("time", "a", "b").collect())) == [(float(t), t % 200, -t) for t in range(1000)]
    assert {r.error for r in read_headers(spark, f"{tmp_path}/out").collect()} == {"record width 13"}


def test_scratch_must_be_shared_on_a_cluster():
    class Context:
        master = "spark://h:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        scratch_path(Session(), "x")


def test_config(spark, tmp_path):
    (tmp_path / "c.properties").write_text(f"# where\nroot = file://{tmp_path}/c\nsplits=3\nwidth: 30\nspark.x=y\n")
    cli.main(["--config", f"{tmp_path}/c.properties", "init"], spark)
    cli.main(["--config", f"{tmp_path}/c.properties", "createTable", "t"], spark)
    assert EventStore(spark, f"file://{tmp_path}/c").properties("t") == {"width": 30.0, "splits": 3}
    cli.main(["--config", f"{tmp_path}/c.properties", "setSplits", "t", "9"], spark)
    assert EventStore(spark, f"file://{tmp_path}/c").properties("t")["splits"] == 9
    for bad in ("no sense", "unknown = 1"):
        (tmp_path / "c.properties").write_text(bad)
        with pytest.raises(ValueError):
            config.read(f"{tmp_path}/c.properties")


def test_cli_and_shell(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    fits_file(tmp_path / "in", "a.fits", rows(1, 2))
    for argv in (["init"], ["createTable", "t", "2"], ["insertHeFits", f"{tmp_path}/in/a.fits", "t", "4"]):
        assert cli.main(["--root", root, *argv], spark) == 0
    out = []
    cli.shell(EventStore(spark, root), "t", ["time=0~5", "detID=1", "quit", "never"], out.append)
    lines = out[0].split("\n")
    assert lines[0] == "1.0\t1\t200\t255\t1" and lines[2] == "\t".join(HE.columns) and lines[3].startswith("Retrieve 2 events in ") and out[1].startswith("error:") and len(out) == 2
    cli.main(["--root", root, "deleteTable", "t"], spark)
    assert EventStore(spark, root).tables() == []
