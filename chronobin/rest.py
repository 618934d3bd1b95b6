"""HTTP edge: query results as CSV, catalog figures as text, and the pages of `static`."""

from __future__ import annotations

import logging
import mimetypes
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import chain
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import functions as F

from .functions.fields import csv_header, csv_line, volume_gb
from .operators import metrics
from .store import EventStore

log = logging.getLogger("chronobin.rest")
STATIC = Path(__file__).parent / "static"
#: Path of the info operations.
INFO = "/info"
#: Lines sent at a time.
LINES = 1000


def info(store: EventStore, op: str, args: dict[str, str]) -> str | None:
    """Answer of an info operation, None if there is no such one."""

    def total(column: str, table: str | None) -> str:
        row = store.totals().where(F.col("table").eqNullSafe(F.lit(table))).first()
        return str(row[column] if row else 0)

    def series(df, column: str) -> str:
        return ",".join(str(r[column]) for r in df.orderBy("bin").collect())

    span = lambda: (int(args["startTimeStamp"]), int(args["endTimeStamp"]))
    answers = {
        "tableList": lambda: ",".join(store.tables()),
        "totalEvents": lambda: total("events", None),
        "totalFiles": lambda: total("files", None),
        "volume": lambda: f"{store.spark.range(1).select(volume_gb(F.lit(int(total('events', None))))).first()[0]}GB",
        "eventsOfTable": lambda: total("events", args["table"]),
        "filesOfTable": lambda: total("files", args["table"]),
        "fileListOfTable": lambda: ",".join(sorted(r[0] for r in store.files_of(args["table"]).collect())),
        "writeSpeed": lambda: series(store.write_speed(*span()), "events"),
        "writeSpeedOfLast": lambda: series(store.write_speed(*metrics.last(int(args["lastSeconds"]))), "events"),
        "readLatency": lambda: series(store.read_latency(*span()), "delay_ms"),
        "readLatencyOfLast": lambda: series(store.read_latency(*metrics.last(int(args["lastSeconds"]))), "delay_ms"),
    }
    return answers[op]() if op in answers else None


def _csv(store: EventStore, table: str, query: str) -> Iterator[str]:
    """Header and lines in order of time; rows come to the driver a partition at a time."""
    rows = store.iterate(table, query, [csv_line().alias("line")])
    first = next(rows, None)  # a fault of the query shows here, before anything is sent
    return chain([csv_header() + "\n"], (r["line"] + "\n" for r in chain([] if first is None else [first], rows)))


def answer(store: EventStore, target: str) -> tuple[int, str, str | bytes | Iterator[str]]:
    """(status, content type, body) of a GET; any fault of the request is 400."""
    url = urlsplit(target)
    try:
        if url.path in ("/", "/index", "/index.html"):
            return 200, "text/html", (STATIC / "index.html").read_bytes()
        if url.path.startswith("/static/"):
            file = (STATIC / url.path[8:]).resolve()
            if STATIC.resolve() in file.parents and file.is_file():
                return 200, mimetypes.guess_type(file.name)[0] or "application/octet-stream", file.read_bytes()
            return 404, "text/plain", "not found"
        if url.path == INFO:
            args = {k: v[0] for k, v in parse_qs(url.query).items()}
            body = info(store, args.get("op", ""), args)
            return (404, "text/plain", "no such operation") if body is None else (200, "text/plain", body)
        if url.path.startswith("/he/"):
            return 200, "text/plain", _csv(store, url.path[4:], unquote(url.query))
    except Exception as e:  # noqa: BLE001
        return 400, "text/plain", str(e)
    return 404, "text/plain", "not found"


def serve(store: EventStore, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_GET(self):  # noqa: N802
            status, kind, body = answer(store, self.path)
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            if isinstance(body, str | bytes):
                data = body.encode() if isinstance(body, str) else body
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)
                return
            self.send_header("Transfer-Encoding", "chunked")
            self.end_headers()
            held: list[str] = []
            for line in body:
                held.append(line)
                if len(held) == LINES:
                    self._chunk(held)
            if held:
                self._chunk(held)
            self.wfile.write(b"0\r\n\r\n")

        def _chunk(self, lines: list[str]) -> None:
            data = "".join(lines).encode()
            lines.clear()
            self.wfile.write(f"{len(data):x}\r\n".encode() + data + b"\r\n")

        def log_message(self, text, *args):
            log.info("%s " + text, self.address_string(), *args)

    return ThreadingHTTPServer(("", port), Handler)
