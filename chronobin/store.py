"""Event tables on Parquet with a commit log, and a catalog of tables, files and logs.

Layout under a root folder of any Hadoop file system:
    tables/<name>/properties                  one JSON line: width, splits
    tables/<name>/log/<n>.json                commits: the batch added, and days that it hides in earlier ones
    tables/<name>/events/<batch>/day=<n>/     events of a batch, sorted by time
    tables/<name>/index/<batch>/              bitmap words of a batch
    catalog/<log>/table=<name>/               files, write_log and read_log, a folder a table

A write fills a folder of its own and counts once its commit is there. Commits are numbered and
never overwritten, so of two writers one takes the next number; readers see a batch wholly or
not at all, and what failed is never read. A batch of a name that is committed is not written
again, which makes streams exact after a failure.
"""

from __future__ import annotations

import json
import logging
import math
import re
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.fields import day, time_bucket
from .operators import bitmap, metrics
from .operators import events as ops
from .plans.query import EventQuery, QueryBuilder, parse
from .progress import Progress
from .schema import DAY, HE, EventSchema
from .sources import fits

log = logging.getLogger("chronobin")

LOGS = {
    "files": "file string, rows long, evt_length int, tstart long, tstop long, date_start string, date_stop string, type string",
    "write_log": "ts_ms long, n long",
    "read_log": "ts_ms long, delay_ms long",
}
#: Events of a file at most, and attempts to commit beside other writers.
FILE_ROWS, ATTEMPTS = 64_000_000, 20


class StoreError(RuntimeError):
    """A table or store that is missing, or already there."""


class EventStore:
    def __init__(self, spark: SparkSession, root: str, schema: EventSchema = HE):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    # -- files ------------------------------------------------------------------------------

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, *parts: str) -> bool:
        fs, path = self._path(*parts)
        return fs.exists(path)

    def _delete(self, *parts: str) -> None:
        fs, path = self._path(*parts)
        fs.delete(path, True)

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._path(*parts)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def _put(self, text: str, *parts: str, overwrite: bool = False) -> bool:
        """Write a small file; False if it is there already and may not be overwritten."""
        fs, path = self._path(*parts)
        try:
            out = fs.create(path, overwrite)
        except Exception:
            if fs.exists(path):
                return False
            raise
        out.write(text.encode())
        out.close()
        return True

    # -- DDL --------------------------------------------------------------------------------

    def init(self) -> None:
        if self._exists("catalog"):
            raise StoreError("the store exists")
        for part in ("catalog", "tables"):
            fs, path = self._path(part)
            fs.mkdirs(path)

    def create_table(self, name: str, splits: int = 100, width: float | None = None) -> None:
        """Create a table anew: one of that name, with its catalog entries, is dropped. splits: parallelism of writes."""
        if not re.fullmatch(r"\w+", name):
            raise StoreError(f"not a table name: {name!r}")
        if not self._exists("catalog"):
            raise StoreError("init the store first")
        if self._exists("tables", name):
            self.drop_table(name)
        self._put(json.dumps({"width": width or self.schema.width, "splits": splits}), "tables", name, "properties", overwrite=True)
        log.info("created table %s", name)

    def drop_table(self, name: str) -> None:
        self.properties(name)
        self._delete("tables", name)
        for kind in LOGS:
            self._delete("catalog", kind, f"table={name}")
        log.info("dropped table %s", name)

    def set_splits(self, name: str, splits: int) -> None:
        """More or fewer parts for the writes to come."""
        self._put(json.dumps(self.properties(name) | {"splits": max(1, splits)}), "tables", name, "properties", overwrite=True)

    def properties(self, name: str) -> dict:
        if not self._exists("tables", name, "properties"):
            raise StoreError(f"no table {name!r}")
        return json.loads(self._text("tables", name, "properties"))

    def _text(self, *parts: str) -> str:
        fs, path = self._path(*parts)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def tables(self) -> list[str]:
        return self._names("tables")

    # -- commits ----------------------------------------------------------------------------

    def _commits(self, name: str) -> list[dict]:
        """Commits in order; a checkpoint every hundredth holds all that came before."""
        names = [n for n in self._names("tables", name, "log") if n.endswith(".json")]
        whole = [n for n in names if n.startswith("upto-")]
        out = json.loads(self._text("tables", name, "log", whole[-1])) if whole else []
        return out + [json.loads(self._text("tables", name, "log", n)) for n in names if not n.startswith("upto-") and int(n[:-5]) >= len(out)]

    def _live(self, commits: list[dict]) -> dict[str, set[int]]:
        """Batches that are read, with the days that later ones hide in them."""
        out: dict[str, set[int]] = {}
        for c in commits:
            for days in out.values():
                days.update(c["hides"])
            out[c["batch"]] = set()
        return out

    def _commit(self, name: str, at: int | None, batch: str, n: int, hides: list[int] = ()) -> bool:
        """Append a commit; at: its number where it depends on what came before, else the next free one. False if another took that number."""
        text = json.dumps({"batch": batch, "n": n, "hides": sorted(hides)})
        number = len(self._commits(name)) if at is None else at
        for _ in range(ATTEMPTS):
            if self._put(text, "tables", name, "log", f"{number:09d}.json"):
                if number % 100 == 99:
                    self._put(json.dumps(self._commits(name)[: number + 1]), "tables", name, "log", f"upto-{number:09d}.json")
                return True
            if at is not None:
                return False
            number += 1
        raise StoreError(f"too many writers of {name}")

    # -- reading ----------------------------------------------------------------------------

    def events(self, name: str) -> DataFrame:
        return self._events(name, self.properties(name), self._live(self._commits(name)))

    def _events(self, name: str, props: dict, live: dict[str, set[int]]) -> DataFrame:
        kinds = ", ".join(f"{p} short" for p in self.schema.props)
        layout = f"{self.schema.time} double, {kinds}, source_file string, event_id long, time_bucket long, batch string, day int"
        folders = [b for b in live if self._exists("tables", name, "events", f"batch={b}")]
        if not folders:
            return self.spark.createDataFrame([], layout).drop("batch")
        where = f"{self.root}/tables/{name}/events"
        out = self.spark.read.schema(layout).option("basePath", where).parquet(*[f"{where}/batch={b}" for b in folders])
        for b, days in live.items():
            if days:
                out = out.where(~((F.col("batch") == b) & F.col("day").isin(*sorted(days))))
        return out.drop("batch").withColumn("time_bucket", time_bucket(F.col(self.schema.time), props["width"]))

    def builder(self, wrap: bool = False) -> QueryBuilder:
        return QueryBuilder(self.schema, wrap)

    def query(self, name: str, query: str | EventQuery) -> DataFrame:
        """Matching events; partitions are pruned by day, and time and property bounds pushed to the scan."""
        q = parse(query, self.schema) if isinstance(query, str) else query
        return q.run(self.events(name))

    def iterate(self, name: str, query: str | EventQuery, columns: list | None = None) -> Iterator:
        """Rows in order of time, a partition at a time on the driver; the delay up to the last row is logged."""
        began = time.time()
        rows = self.query(name, query).orderBy(self.schema.time)
        yield from rows.select(*columns or self.schema.columns).toLocalIterator()
        self._log("read_log", name, [(int(time.time() * 1000), int((time.time() - began) * 1000))])

    def timed_query(self, name: str, query: str | EventQuery) -> tuple[list, float]:
        """Rows in order of time, for the edges, and seconds; the delay is logged."""
        began = time.time()
        rows = list(self.iterate(name, query))
        return rows, time.time() - began

    # -- the bitmap index ---------------------------------------------------------------------

    def build_index(self, name: str) -> None:
        """Bitmap words of every batch that has none yet; batches don't change, so neither do theirs."""
        props = self.properties(name)
        for batch in self._live(self._commits(name)):
            if not self._exists("tables", name, "index", batch, "_SUCCESS"):
                events = self._events(name, props, {batch: set()})
                bitmap.build(events.withColumn("day", day(F.col(self.schema.time))), self.schema, also=["day"]).write.mode("overwrite").parquet(f"{self.root}/tables/{name}/index/{batch}")

    def count(self, name: str, query: str | EventQuery) -> int:
        """Number of matching events: of whole buckets from the index alone where it is stored, of the two at the edges from the events."""
        q = parse(query, self.schema) if isinstance(query, str) else query
        props, live = self.properties(name), self._live(self._commits(name))
        width = props["width"]
        first, last = math.floor(q.start / width) + (q.start % width > 0), math.floor(q.end / width)  # whole buckets: first..last-1
        indexed = {b: d for b, d in live.items() if self._exists("tables", name, "index", b, "_SUCCESS")}
        if not indexed or first >= last or not (q.ranges or q.lists):
            return self.query(name, q).count()
        words = None
        for b, days in indexed.items():
            part = self.spark.read.parquet(f"{self.root}/tables/{name}/index/{b}").withColumn("batch", F.lit(b))
            part = part.where(~F.col("day").isin(*sorted(days))) if days else part
            words = part if words is None else words.unionByName(part)
        found = bitmap.evaluate(words.where(F.col("day").between(math.floor(q.start / DAY), math.floor(q.end / DAY))), q, first, last - 1, by=["batch"])
        n = found.agg(F.sum(F.bit_count("bits"))).first()[0] or 0
        t = F.col(self.schema.time)
        edges = q.run(self._events(name, props, indexed).where((t < first * width) | (t >= last * width))).count()
        rest = {b: d for b, d in live.items() if b not in indexed}
        return int(n + edges + (q.run(self._events(name, props, rest)).count() if rest else 0))

    # -- writing ----------------------------------------------------------------------------

    def _log(self, kind: str, name: str, rows: list[tuple]) -> None:
        """A small file of its own for each entry: appends through Spark would share a temporary folder with other writers."""
        columns = [c.split()[0] for c in LOGS[kind].split(", ")]
        self._put("".join(json.dumps(dict(zip(columns, r, strict=True))) + "\n" for r in rows), "catalog", kind, f"table={name}", f"{int(time.time() * 1000)}-{uuid.uuid4().hex}.json")

    def _fill(self, name: str, batch: str, df: DataFrame, props: dict) -> int:
        """Write a batch's folder, once; returns its events."""
        seen = Observation()
        laid = df.repartition(int(props["splits"]), "day", F.pmod("time_bucket", F.lit(64))).observe(seen, F.count(F.lit(1)).alias("n")).sortWithinPartitions("day", self.schema.time)
        laid.drop("time_bucket").write.mode("overwrite").option("compression", "snappy").option("maxRecordsPerFile", FILE_ROWS).partitionBy("day").parquet(f"{self.root}/tables/{name}/events/batch={batch}")
        return seen.get["n"]

    def write(self, name: str, new: DataFrame, mode: str = "merge", batch: str | None = None) -> int:
        """Add events(time, properties [, source_file, event_id]); returns their number.

        merge: union with what is stored. replace_overlap: a bucket whose new events overlap
        the old ones in time loses those; the batch holds the whole new state of its days and
        hides them in earlier batches. batch: a name under which the events are written at most
        once, however often this is called.
        """
        if mode not in ("merge", "replace_overlap"):
            raise ValueError(f"unknown mode {mode!r}")
        props = self.properties(name)
        t = F.col(self.schema.time)
        for c, kind in (("source_file", "string"), ("event_id", "long")):
            if c not in new.columns:
                new = new.withColumn(c, F.lit(None).cast(kind))
        new = new.select(*self.schema.columns, "source_file", "event_id", time_bucket(t, props["width"]).alias("time_bucket"), day(t).alias("day"))
        if batch is not None and any(c["batch"] == batch for c in self._commits(name)):
            return 0
        if mode == "merge":
            batch = batch or uuid.uuid4().hex
            n = self._fill(name, batch, new, props)
            self._commit(name, None, batch, n)
        else:
            n = self._replace(name, new, props, batch)
        self._log("write_log", name, [(int(time.time() * 1000), n)])
        log.info("wrote %d events to %s", n, name)
        return n

    def _replace(self, name: str, new: DataFrame, props: dict, batch: str | None) -> int:
        """The new events, staged once, and with them what stays of their days; done again if another writer came between."""
        stage = f"stage-{uuid.uuid4().hex}"
        n = self._fill(name, stage, new, props)
        staged = self._events(name, props, {stage: set()}).select(*new.columns)
        days = [r[0] for r in staged.select("day").distinct().collect()]
        try:
            for _ in range(ATTEMPTS):
                commits = self._commits(name)
                old = self._events(name, props, self._live(commits)).select(*new.columns).where(F.col("day").isin(*days)) if days else staged.limit(0)
                made = batch or uuid.uuid4().hex
                self._fill(name, made, ops.merge_replace_overlap(old, staged), props)
                if self._commit(name, len(commits), made, n, days):
                    return n
                self._delete("tables", name, "events", f"batch={made}")
        finally:
            self._delete("tables", name, "events", f"batch={stage}")
        raise StoreError(f"too many writers of {name}")

    def compact(self, name: str, batches: int = 4) -> list[int]:
        """Rewrite the days that lie in more than so many batches as one, in files of up to FILE_ROWS; returns those days."""
        props, commits = self.properties(name), self._commits(name)
        held: dict[int, int] = {}
        for b, hidden in self._live(commits).items():
            for folder in self._names("tables", name, "events", f"batch={b}"):
                if folder.startswith("day=") and int(folder[4:]) not in hidden:
                    held[int(folder[4:])] = held.get(int(folder[4:]), 0) + 1
        days = sorted(d for d, n in held.items() if n > batches)
        if days:
            made = uuid.uuid4().hex
            self._fill(name, made, self._events(name, props, self._live(commits)).where(F.col("day").isin(*days)), props)
            if not self._commit(name, len(commits), made, 0, days):
                self._delete("tables", name, "events", f"batch={made}")
                return []
            log.info("compacted %d days of %s", len(days), name)
        return days

    def vacuum(self, name: str, older_than_s: float = 7 * 86_400) -> list[str]:
        """Delete folders of writes that were never committed and are older; returns them."""
        live = {f"batch={c['batch']}" for c in self._commits(name)}
        fs, path = self._path("tables", name, "events")
        old = [x.getPath().getName() for x in fs.listStatus(path) if x.getModificationTime() < (time.time() - older_than_s) * 1000] if fs.exists(path) else []
        gone = [x for x in old if x not in live]
        for x in gone:
            self._delete("tables", name, "events", x)
        return gone

    def ingest(self, name: str, path: str, mode: str = "merge", on_progress=None) -> DataFrame:
        """Read FITS files into a table; returns headers of files that were rejected, with the reason.

        Headers are read by one job, whose findings plan the next one's tasks. Catalog entries
        follow the write, so a failed ingest counts nothing. on_progress: called with per cents.
        """
        headers = fits.read_headers(self.spark, path, self.schema).collect()
        good = [h for h in headers if h["error"] is None]
        for h in headers:
            if h["error"] is not None:
                log.warning("skipped %s: %s", h["file"], h["error"])
        if good:
            with Progress(self.spark, on_progress or (lambda p: log.info("ingest of %s: %d %%", path, p))):
                self.write(name, fits.read_events(self.spark, path, self.schema, planned=[(h["path"], h["offset"], h["rows"]) for h in good]), mode)
            self._log("files", name, [tuple(h[c.split()[0]] for c in LOGS["files"].split(", ")) for h in good])
        return self.spark.createDataFrame([h for h in headers if h["error"] is not None], fits.HEADER_SCHEMA)

    # -- catalog ----------------------------------------------------------------------------

    def log(self, kind: str, name: str | None = None) -> DataFrame:
        layout = f"{LOGS[kind]}, table string"
        if not self._exists("catalog", kind):
            df = self.spark.createDataFrame([], layout)
        else:
            df = self.spark.read.schema(layout).json(f"{self.root}/catalog/{kind}")
        return df if name is None else df.where(F.col("table") == name)

    def totals(self) -> DataFrame:
        return ops.table_totals(self.log("files"))

    def files_of(self, name: str) -> DataFrame:
        return self.log("files", name).select("file")

    def write_speed(self, start_ms: int, end_ms: int) -> DataFrame:
        return metrics.growth(self.log("write_log"), start_ms, end_ms)

    def read_latency(self, start_ms: int, end_ms: int) -> DataFrame:
        return metrics.read_latency(self.log("read_log"), start_ms, end_ms)
