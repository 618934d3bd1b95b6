"""WARC archives as a Spark data source, and deduplicated archiving of pages.

`WarcSource` (format "warc") writes one gzip member a record and reads it back:
* planning: the manifest of each committed write lists its files and, every SPLIT bytes, a
  record boundary; a partition is such a range. Folders without manifests are read a file each
  (.warc and .warc.gz).
* push-down: predicates on header columns (record type, ids, uri, digest) are taken by the
  reader and tested as soon as a record's header block is inflated.
* skipping: a member names its own length in a gzip extra field, so a record that fails a
  predicate, or whose payload is not asked for (option payload=false), is skipped undecoded.
* archives of others: members without that field, one member of many records, and plain files
  are walked from header to header by Content-Length; plain files skip payloads by seeking.
  Header names are of any case, blanks after the colon optional, long lines may be folded.
  A record of HTTP has its body as payload, any other (warcinfo, metadata, resource) its block;
  a digest is compared where it is SHA-1 and no transfer coding hides the body.
Files of failed or repeated task attempts are in no manifest and are never read. Paths are
opened through pyarrow.fs, so the folder may be in any store that it knows.

Defined results: a null html is an empty payload; of equal payloads of at least min_bytes the
least page_id is the response (rows that repeat that id are each one) and all others revisit
it; null page ids revisit if their payload has a page with an id, else they are responses; a
payload whose digest does not match raises ValueError; very long payloads are one value each;
empty tables give an empty archive; extra columns are not archived. `register` switches the
session's push-down to Python sources on.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from .common import materialise, scratch_path

#: Bytes after which a file ends, bytes between split points, bytes read at a time, and payloads' compression level.
ROLL, SPLIT, CHUNK, LEVEL = 512 << 20, 128 << 20, 1 << 16, 5
#: Groups of equal payloads up to which they are broadcast; beyond it the join shuffles.
BROADCAST_GROUPS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "date": "WARC-Date"}
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, date string, payload_bytes long"
INPUT = "record_id string, record_type string, target_uri string, refers_to string, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, record_type: str, uri: str | None, refers_to: str | None, payload: bytes, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record as a gzip member whose extra field SL holds the member's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if record_type == "revisit" else head + payload
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if uri is not None:
        fields.append(("WARC-Target-URI", "".join(c if " " < c else f"%{ord(c):02X}" for c in uri)))
    if record_type == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    extra = b"SL" + struct.pack("<HI", 4, 10 + 2 + 8 + len(body) + 8)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _fs(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: list


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Written:
        fs, folder = _fs(self.path)
        fs.create_dir(folder, recursive=True)
        files, out, at = [], None, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                if out is None or at >= ROLL:
                    if out is not None:
                        out.close()
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    files.append({"file": name, "splits": [0]})
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                if at - files[-1]["splits"][-1] >= SPLIT:
                    files[-1]["splits"].append(at)
                data = record(row["record_id"], row["record_type"], row["target_uri"], row["refers_to"], row["payload"] or b"")
                out.write(data)
                at += len(data)
                files[-1]["size"] = at
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, folder = _fs(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages) -> None:
        fs, folder = _fs(self.path)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{folder}/{f['file']}")


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def _inflate_until(z, source, mark: bytes) -> bytearray | None:
    """Inflated bytes up to and beyond the first mark, reading as little as it takes."""
    out = bytearray()
    while out.find(mark) < 0:
        data = z.unconsumed_tail or source.read(2048)
        if not data and not z.unconsumed_tail:
            return None
        out += z.decompress(data, 1024)
    return out


def _headers(block: bytes) -> dict[str, str]:
    """Names in lower case to values, of a header block without its last blank line."""
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line.startswith((" ", "\t")) and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _parts(headers: dict, size: int, body: bytes, payload: bool):
    """(headers, HTTP head, payload or None, bytes of the payload) of a record whose block of `size` bytes begins with body."""
    cut = body.find(b"\r\n\r\n") + 4 if headers.get("content-type", "").lower().startswith("application/http") else 0
    head = bytes(body[: max(0, cut)]) if cut > 3 else b""
    return headers, head, bytes(body[len(head) : size]) if payload else None, size - len(head)


def _wanted(headers: dict, payload: bool, size: int) -> int:
    """Bytes of the block to read at first: all of it, or what an HTTP head may take."""
    return size if payload else min(size, 1 << 16 if headers.get("content-type", "").lower().startswith("application/http") else 0)


class _Inflated:
    """The concatenated contents of gzip members, read forward."""

    def __init__(self, source):
        self.source, self.z, self.raw = source, zlib.decompressobj(31), b""

    def read(self, n: int) -> bytes:
        while True:
            if not self.raw:
                self.raw = self.source.read(CHUNK)
                if not self.raw:
                    return b""
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(self.raw, n)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                return out


def _walk(source, end: int, keep, payload: bool, skip=None):
    """Records of a flow of them, from header to header. skip(n): jump ahead, where the source can."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            data = source.read(max(CHUNK, n - len(held)))
            if not data:
                return False
            held.extend(data)
        return True

    at = 0
    while at < end:
        while fill(2) and held[:2] == b"\r\n":
            del held[:2]
            at += 2
        if at >= end or not fill(1):
            return
        cut = -1
        while (cut := held.find(b"\r\n\r\n")) < 0:
            if len(held) > 1 << 20 or not fill(len(held) + 1):
                raise ValueError("truncated record")
        if held[:5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        headers = _headers(bytes(held[:cut]))
        if "content-length" not in headers:
            raise ValueError("record without Content-Length")
        size = int(headers["content-length"])
        del held[: cut + 4]
        if keep(headers):
            if not fill(want := _wanted(headers, payload, size)):
                raise ValueError("truncated record")
            yield _parts(headers, size, bytes(held[:want]), payload)
        at += cut + 4 + size
        left = size
        if skip and left > len(held):
            left -= len(held)
            held.clear()
            skip(left)
            left = 0
        while left:
            step = min(left, len(held) or 0)
            if not step and not fill(1):
                raise ValueError("truncated record")
            step = min(left, len(held))
            del held[:step]
            left -= step


def read_records(stream, start: int, end: int, keep, payload: bool):
    """(headers, HTTP head, payload or None, its bytes) of the records that begin in [start, end) and pass keep(headers)."""
    at = start
    while at < end:
        stream.seek(at)
        first = stream.read(12)
        if not first:
            return
        if first[:2] != b"\x1f\x8b":
            stream.seek(at)
            yield from _walk(stream, end - at, keep, payload, lambda n: stream.seek(stream.tell() + n))
            return
        extra = stream.read(struct.unpack("<H", first[10:12])[0]) if len(first) == 12 and first[3] & 4 else b""
        if b"SL" not in extra:
            stream.seek(at)
            yield from _walk(_Inflated(stream), 1 << 62, keep, payload)
            return
        length = struct.unpack("<I", extra[extra.index(b"SL") + 4 :][:4])[0]
        z = zlib.decompressobj(-15)
        got = _inflate_until(z, stream, b"\r\n\r\n")
        if got is None:
            raise ValueError(f"truncated record at byte {at}")
        cut = got.index(b"\r\n\r\n")
        headers = _headers(bytes(got[:cut]))
        if keep(headers):
            size = int(headers["content-length"])
            body = got[cut + 4 :]
            while len(body) < size and (payload or b"\r\n\r\n" not in body):
                data = z.unconsumed_tail or stream.read(CHUNK)
                if not data:
                    raise ValueError(f"truncated record at byte {at}")
                body += z.decompress(data, max(1, size - len(body)) if payload else 1024)
            yield _parts(headers, size, body, payload)
        at += length


class Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.taken = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull, IsNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.taken.append(f)
            else:
                yield f

    def partitions(self):
        fs, folder = _fs(self.path)
        names = [x.path for x in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if x.is_file]
        manifests = [x for x in names if x.rpartition("/")[2].startswith("manifest-")]
        out = []
        for m in sorted(manifests):
            with fs.open_input_stream(m) as f:
                listed = json.loads(f.read())
            for x in listed:
                ends = [*x["splits"][1:], x["size"]]
                out += [Range(f"{folder}/{x['file']}", a, b) for a, b in zip(x["splits"], ends, strict=True)]
        if not manifests:
            out = [Range(x, 0, 1 << 62) for x in sorted(names) if x.endswith((".warc.gz", ".warc"))]
        return out or [Range("", 0, 0)]

    def _keep(self, headers: dict) -> bool:
        for f in self.taken:
            x = _bare(headers.get(HEADERS[f.attribute[0]].lower()))
            if isinstance(f, IsNull):
                ok = x is None
            elif isinstance(f, IsNotNull):
                ok = x is not None
            elif isinstance(f, In):
                ok = x in f.value
            elif isinstance(f, StringStartsWith):
                ok = x is not None and x.startswith(f.value)
            else:
                ok = x == f.value and (x is not None or isinstance(f, EqualNullSafe))
            if not ok:
                return False
        return True

    def read(self, partition):
        if not partition.file:
            return
        fs, _ = _fs(self.path)
        rows: list = []
        held = 0
        with fs.open_input_file(partition.file) as stream:
            for headers, head, body, left in read_records(stream, partition.start, partition.end, self._keep, self.payload):
                values = [_bare(headers.get(h.lower())) for h in HEADERS.values()]
                http = _headers(head) if head else {}
                revisit = headers.get("warc-type") == "revisit"
                # A revisit has the head of what it doesn't repeat.
                n = (int(http["content-length"]) if http.get("content-length", "").isdigit() else None) if revisit else left
                whole = not revisit and body is not None
                if whole and "transfer-encoding" not in http and headers.get("warc-payload-digest", "").lower().startswith("sha1:") and values[4] and sha1_base32(body) != values[4].upper():
                    raise ValueError(f"payload of {values[1]} does not match its header")
                rows.append((*values, n, *([body if whole else None] if self.payload else [])))
                held += len(body or b"") + 500
                if held > 8 << 20:
                    yield _batch(rows, self.payload)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, self.payload)


def _bare(x: str | None) -> str | None:
    return None if x is None else x[1:-1] if x[:1] == "<" else x.removeprefix("sha1:").removeprefix("SHA1:")


def _batch(rows: list, payload: bool) -> pa.RecordBatch:
    names = [*HEADERS, "payload_bytes", *["payload"] * payload]
    types = [*[pa.string()] * len(HEADERS), pa.int64(), *[pa.binary()] * payload]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder); df(INPUT).write.format("warc").mode("append").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def _payload(self) -> bool:
        return str(self.options.get("payload", "true")).lower() == "true"

    def schema(self) -> str:
        return SCHEMA + ", payload binary" * self._payload()

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._payload())

    def writer(self, schema, overwrite) -> Writer:
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record a page: the first of equal payloads as response, the others as revisits of it.

    Only digests of repeated payloads, with their least id, are joined to the pages; pages
    themselves are not shuffled while those groups are few enough to broadcast.
    """
    spark = pages.sparkSession
    register(spark)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    firsts = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first")
    firsts = materialise(firsts, "warc-groups")
    few = firsts.count() <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(firsts) if few else firsts, "sha", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    made = joined.select(urn("id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.when(again, urn("first")).alias("refers_to"), "payload")
    made.write.format("warc").mode("append").save(folder)


def op10_query(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of all pages, as read back from their archive; payloads are read too, to hold them against their digests."""
    folder = scratch_path(spark, "warc")
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    read = spark.read.format("warc").load(folder).where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) AS bigint)")
    return read.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex FROM p),
b AS (SELECT page_id, n, hex, list_transform(range(0, 32), lambda i: (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) AS v FROM d),
e AS (SELECT page_id, n, array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x AS INTEGER) + 1, 1)), '') AS digest FROM b),
m AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM e)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM m
"""
