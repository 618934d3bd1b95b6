"""Command line: python -m chronobin.cli [--config FILE] [--root FOLDER] COMMAND ..."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from . import config
from .rest import serve
from .store import EventStore


def render(rows: list, columns: list[str], seconds: float) -> str:
    """Tab-separated rows, the header last, and how many there are."""
    lines = ["\t".join(str(r[c]) for c in columns) for r in rows]
    return "\n".join([*lines, "\t".join(columns), f"Retrieve {len(rows)} events in {seconds:.3f} S"])


def shell(store: EventStore, table: str, source=None, out=print) -> None:
    """Read a query a line until quit."""
    for line in source or sys.stdin:
        line = line.strip()
        if line == "quit":
            return
        if not line:
            continue
        try:
            rows, took = store.timed_query(table, line)
            out(render(rows, store.schema.columns, took))
        except Exception as e:  # noqa: BLE001
            out(f"error: {e}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="chronobin")
    p.add_argument("--config", help="a properties file; flags stand above it")
    p.add_argument("--root")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    c = sub.add_parser("createTable")
    c.add_argument("table")
    c.add_argument("splits", type=int, nargs="?")
    sub.add_parser("deleteTable").add_argument("table")
    c = sub.add_parser("setSplits", help="parts of the writes to come")
    c.add_argument("table")
    c.add_argument("splits", type=int)
    c = sub.add_parser("insertHeFits")
    c.add_argument("path")
    c.add_argument("table")
    c.add_argument("threads", type=int, nargs="?", help="accepted; Spark schedules the tasks")
    c.add_argument("--mode", choices=("merge", "replace_overlap"), default="merge")
    sub.add_parser("compact", help="one batch a day again, where there are many").add_argument("table")
    sub.add_parser("vacuum", help="delete what failed writes left").add_argument("table")
    sub.add_parser("buildIndex").add_argument("table")
    sub.add_parser("HeFitsQuery").add_argument("table")
    sub.add_parser("server").add_argument("port", type=int, nargs="?")
    a = p.parse_args(argv)
    settings = config.read(a.config) if a.config else {}
    root = a.root or settings.get("root")
    if not root:
        p.error("no root: give --root or a config with one")
    logging.basicConfig(level=settings.get("log.level", "INFO").upper(), format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    if spark is None:
        builder = SparkSession.builder.appName("chronobin").config("spark.sql.session.timeZone", "UTC")
        for k, v in settings.items():
            if k.startswith("spark."):
                builder = builder.config(k, v)
        spark = builder.getOrCreate()
    store = EventStore(spark, root)
    if a.command == "init":
        store.init()
    elif a.command == "createTable":
        store.create_table(a.table, a.splits or int(settings.get("splits", 100)), float(settings["width"]) if "width" in settings else None)
    elif a.command == "deleteTable":
        store.drop_table(a.table)
    elif a.command == "setSplits":
        store.set_splits(a.table, a.splits)
    elif a.command == "insertHeFits":
        for r in store.ingest(a.table, a.path, a.mode, on_progress=lambda n: print(f"{n} %", file=sys.stderr)).collect():
            print(f"skipped {r['file']}: {r['error']}", file=sys.stderr)
    elif a.command == "compact":
        print(f"compacted {len(store.compact(a.table))} days")
    elif a.command == "vacuum":
        print(f"deleted {len(store.vacuum(a.table))} folders")
    elif a.command == "buildIndex":
        store.build_index(a.table)
    elif a.command == "HeFitsQuery":
        shell(store, a.table)
    else:
        serve(store, a.port or int(settings.get("port", 8080))).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
