"""FITS binary tables of events as a Spark data source (format "fits"), and a writer of such files.

FITS: header blocks of 2880 bytes with 80-character cards, then big-endian rows, padded to 2880.
The table is the first extension. A file is read in row ranges, a partition each. Events of any
fixed-width schema are read; option `layout` names it (EventSchema.to_json).
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import HE, EventSchema

BLOCK, CARD = 2880, 80
#: Rows of a partition.
ROWS = 4_000_000
HEADER_SCHEMA = "file string, rows long, evt_length int, tstart long, tstop long, date_start string, date_stop string, type string, error string, path string, offset long"


class FitsError(ValueError):
    """A file that is no FITS table, or is cut short."""


def read_header(f) -> dict:
    """The cards of the header at the file's position; leaves the position after its last block."""
    cards: dict = {}
    while True:
        block = f.read(BLOCK)
        if len(block) < BLOCK:
            raise FitsError("header is cut short")
        for at in range(0, BLOCK, CARD):
            card = block[at : at + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards
            if card[8:10] == "= ":
                cards.setdefault(key, _value(card[10:]))


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        end = 1
        while end < len(text) and not (text[end] == "'" and text[end + 1 : end + 2] != "'"):
            end += 2 if text[end] == "'" else 1
        return text[1:end].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E"))
        except ValueError:
            return text or None


def _data_bytes(cards: dict) -> int:
    n = int(cards.get("NAXIS", 0))
    size = abs(int(cards.get("BITPIX", 8))) // 8 if n else 0
    for i in range(1, n + 1):
        size *= int(cards[f"NAXIS{i}"])
    return size + int(cards.get("PCOUNT", 0) or 0)


def table_header(f) -> tuple[dict, int]:
    """Cards of the first extension, and where its rows begin."""
    primary = read_header(f)
    if primary.get("SIMPLE") is not True:
        raise FitsError("no FITS file")
    f.seek(f.tell() + -(-_data_bytes(primary) // BLOCK) * BLOCK)
    cards = read_header(f)
    if cards.get("XTENSION") != "BINTABLE":
        raise FitsError("first extension is no binary table")
    return cards, f.tell()


def _fs(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str):
    """A file, or a directory's direct children, in order of name."""
    fs, where = _fs(path)
    info = fs.get_file_info(where)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return fs, [info.path]
    return fs, sorted(x.path for x in fs.get_file_info(pafs.FileSelector(where)) if x.is_file)


@dataclass
class Rows(InputPartition):
    path: str
    offset: int
    first: int
    count: int


class EventReader(DataSourceReader):
    """planned: (path, offset of the rows, number of them) of each file, where a job has read the headers; else they are read here, side by side."""

    def __init__(self, path: str, schema: EventSchema, planned: list | None = None):
        self.path, self.events, self.planned = path, schema, planned

    def partitions(self):
        planned = self.planned
        if planned is None:
            fs, files = _files(self.path)

            def plan(path):
                with fs.open_input_file(path) as f:
                    cards, offset = table_header(f)
                    width, rows = int(cards["NAXIS1"]), int(cards["NAXIS2"])
                    if width != self.events.record_bytes:
                        return None  # in the headers' list of rejects
                    if f.size() < offset + width * rows:
                        raise FitsError(f"{path} is cut short")
                    return path, offset, rows

            with ThreadPoolExecutor(32) as pool:
                planned = [x for x in pool.map(plan, files) if x]
        return [Rows(p, offset, a, min(ROWS, rows - a)) for p, offset, rows in planned for a in range(0, rows, ROWS)] or [Rows("", 0, 0, 0)]

    def read(self, part):
        kind = np.dtype(list(self.events.wire))
        if not part.count:
            return
        fs = _fs(self.path)[0]
        with fs.open_input_file(part.path) as f:
            f.seek(part.offset + part.first * kind.itemsize)
            left = part.count
            while left:
                n = min(left, 1 << 16)
                raw = f.read(n * kind.itemsize)
                if len(raw) < n * kind.itemsize:
                    raise FitsError(f"{part.path} is cut short")
                rows = np.frombuffer(raw, kind)
                cols = [pa.array(rows[self.events.time].astype("<f8")), *[pa.array(rows[p].astype("<i2")) for p in self.events.props]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([part.path.rpartition("/")[2]] * n)], names=[*self.events.columns, "source_file"])
                left -= n


class HeaderReader(DataSourceReader):
    def __init__(self, path: str, schema: EventSchema):
        self.path, self.events = path, schema

    def partitions(self):
        _, files = _files(self.path)
        return [Rows(p, 0, 0, 0) for p in files] or [Rows("", 0, 0, 0)]

    def read(self, part):
        if not part.path:
            return
        fs = _fs(self.path)[0]
        name = part.path.rpartition("/")[2]
        try:
            with fs.open_input_file(part.path) as f:
                c, offset = table_header(f)
                width, rows = int(c["NAXIS1"]), int(c["NAXIS2"])
                error = None if width == self.events.record_bytes else f"record width {width}"
                if not error and f.size() < offset + width * rows:
                    error = "cut short"
                yield name, rows, width, int(c.get("TSTART") or 0), int(c.get("TSTOP") or 0), c.get("DATE-OBS"), c.get("DATE-END"), c.get("INSTRUME"), error, part.path, offset
        except (FitsError, KeyError) as e:
            yield name, None, None, None, None, None, None, None, str(e), part.path, None


class FitsSource(DataSource):
    """Events of a file or directory; option headers=true: a row a file instead; layout: the events' schema, by default the high-energy record's."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    @property
    def events(self) -> EventSchema:
        text = self.options.get("layout")
        return EventSchema.from_json(text) if text else HE

    def _headers(self) -> bool:
        return str(self.options.get("headers", "false")).lower() == "true"

    def schema(self):
        if self._headers():
            return HEADER_SCHEMA
        return f"{self.events.time} double, " + ", ".join(f"{p} short" for p in self.events.props) + ", source_file string"

    def reader(self, schema):
        if self._headers():
            return HeaderReader(self.options["path"], self.events)
        planned = self.options.get("planned")
        return EventReader(self.options["path"], self.events, json.loads(planned) if planned else None)


def read_events(spark: SparkSession, path: str, schema: EventSchema = HE, planned: list | None = None) -> DataFrame:
    spark.dataSource.register(FitsSource)
    reader = spark.read.format("fits").option("layout", schema.to_json())
    return (reader if planned is None else reader.option("planned", json.dumps(planned))).load(path)


def read_headers(spark: SparkSession, path: str, schema: EventSchema = HE) -> DataFrame:
    spark.dataSource.register(FitsSource)
    return spark.read.format("fits").option("headers", "true").option("layout", schema.to_json()).load(path)


def fits_bytes(rows: list[tuple] | np.ndarray, schema: EventSchema = HE, width: int | None = None, start: float = 0, stop: float = 0, instrument: str = "HE") -> bytes:
    """A FITS file of events given as (time, properties...), or as an array of records in wire layout."""

    def header(cards):
        text = "".join(f"{k:<8}= {v if isinstance(v, str) else str(v):>20}".ljust(CARD) for k, v in cards) + "END".ljust(CARD)
        return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode()

    kind = np.dtype(list(schema.wire))
    data = rows
    if not isinstance(rows, np.ndarray):
        data = np.zeros(len(rows), kind)
        for k, name in enumerate(schema.columns):
            data[name] = [r[k] for r in rows]
    raw = data.tobytes()
    primary = header([("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", "T")])
    table = header([("XTENSION", "'BINTABLE'"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width or kind.itemsize), ("NAXIS2", len(data)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 1), ("TSTART", start), ("TSTOP", stop), ("DATE-OBS", "'2017-08-31T00:00:00'"), ("DATE-END", "'2017-09-01T00:00:00'"), ("INSTRUME", f"'{instrument:<8}'")])
    return primary + table + raw.ljust(-(-len(raw) // BLOCK) * BLOCK, b"\0")


def write_events(events: DataFrame, folder: str, schema: EventSchema = HE, rows: int = ROWS) -> list[str]:
    """Write FITS files of up to so many rows, at least one a partition that has any; returns the names of the files.

    Each task attempt writes under names of its own, with this run's mark, and reports them
    when done; files with that mark that no attempt reported are removed, no others.
    """
    mark = uuid.uuid4().hex[:12]
    kind = np.dtype(list(schema.wire))

    def run(batches):
        fs, where = _fs(folder)
        held: list[np.ndarray] = []
        names: list[str] = []

        def flush():
            data = np.concatenate(held, dtype=kind)
            held.clear()
            fs.create_dir(where, recursive=True)
            names.append(f"events-{mark}-{uuid.uuid4().hex}.fits")
            with fs.open_output_stream(f"{where}/{names[-1]}") as out:
                out.write(fits_bytes(data, schema, start=int(data[schema.time].min()), stop=int(data[schema.time].max())))

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                data = np.zeros(part.num_rows, kind)
                for name in schema.columns:
                    data[name] = part.column(name).to_numpy(zero_copy_only=False)
                if held and sum(map(len, held)) + len(data) > rows:
                    flush()
                held.append(data)
        if sum(map(len, held)):
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    names = [r["file"] for r in events.select(*schema.columns).mapInArrow(run, "file string").collect()]
    fs, where = _fs(folder)
    for f in fs.get_file_info(pafs.FileSelector(where, allow_not_found=True)):
        name = f.path.rpartition("/")[2]
        if name.startswith(f"events-{mark}-") and name not in names:
            fs.delete_file(f.path)
    return names
