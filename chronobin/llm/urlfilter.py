"""URL filters by a sort-merge range join of reversed-host keys.

The canonical key of a host is its labels reversed ("a.b.com" -> "com.b.a."); all subdomains of
a host have its key as a prefix, so a rule's host is the interval [key, key + U+10FFFF] and
intervals nest or are disjoint. Urls sorted by key are merged with the sorted rules: one sweep
keeps a stack of the intervals that are open at the current key, innermost on top, each with
its path rules, and gallops over rules that no url meets. The paths of a rule's host that start
the url's are found by their lengths, of which there are few however many paths there are.

One law for any number of rules: the longest (host and path) wins, of equal ones that of the
longer host; of rules of one host and path the last stands.

Rules of at most RULES rows and RULE_BYTES are shipped to every task, and each Arrow batch of
urls is sorted and swept where it is: a hot host is no hot partition, and pages are not
shuffled. Beyond that, urls are range-partitioned by (key, path) at sampled bounds, equal ones
spread over equal bounds, and every rule goes to the partitions that its interval meets; the
sweep and its verdicts are the same.

Defined results: a null url or one without "://" has an empty host and path, fits no rule and
takes the default verdict; rules with null hosts fit nothing, null paths are empty; pages that
repeat are each judged; very long urls are taken whole; an empty table gives no rows; extra
columns are dropped.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Fixed values of the query: (action, host, path).
QUERY_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
DEFAULT = "allow"
#: Rules, and their bytes, that every task may hold; urls of a range, and sampled keys a range.
RULES, RULE_BYTES, RANGE_URLS, SAMPLED = 200_000, 32 << 20, 200_000, 20

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_HOST_END, _PATH_END = re.compile(r"[/?#]"), re.compile(r"[?#]")
_LAST = "\U0010ffff"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without "://"."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    host_end = m.start() if (m := _HOST_END.search(rest)) else len(rest)
    tail = rest[host_end:]
    return rest[:host_end].translate(_LOWER), tail[: m.start()] if (m := _PATH_END.search(tail)) else tail


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class Rules:
    """Rules (action, host, path), the last of equal ones, by sorted key."""

    def __init__(self, rules):
        self.paths: dict[str, dict[str, str]] = {}
        for action, host, path in rules:
            if host is not None:
                self.paths.setdefault(host_key(host.translate(_LOWER)), {})[path or ""] = action
        self.keys = sorted(self.paths)
        self.lengths = {k: sorted({len(p) for p in v}, reverse=True) for k, v in self.paths.items()}

    def sweep(self, urls: list[tuple[str, str]]) -> list[tuple[str, str] | None]:
        """For each (host, path) the winning (rule, action)."""
        out: list[tuple[str, str] | None] = [None] * len(urls)
        stack: list[str] = []
        at = 0
        for key, i in sorted((host_key(h), i) for i, (h, _) in enumerate(urls) if h):
            while stack and not key.startswith(stack[-1]):  # intervals that ended before this key
                stack.pop()
            ahead = bisect_right(self.keys, key, at)
            if ahead > at:  # intervals that begin up to it: of those, the ones that are open are its labels' prefixes
                dot = key.find(".", len(stack[-1]) if stack else 0)
                while dot >= 0:
                    if key[: dot + 1] in self.paths:
                        stack.append(key[: dot + 1])
                    dot = key.find(".", dot + 1)
                at = ahead
            best = None
            for host in stack:
                path = self.longest(host, urls[i][1])
                if path is not None and (best is None or (len(host) + len(path), len(host)) > (len(best[0]) + len(best[1]), len(best[0]))):
                    best = host, path
            if best:
                out[i] = ".".join(reversed(best[0][:-1].split("."))) + best[1], self.paths[best[0]][best[1]]
        return out

    def longest(self, host: str, path: str) -> str | None:
        paths = self.paths[host]
        return next((path[:n] for n in self.lengths[host] if n <= len(path) and path[:n] in paths), None)


def _judged(batch: pa.RecordBatch | pa.Table, rules: Rules, default: str) -> list:
    """Arrays host, path, rule and verdict of a batch with a column url."""
    urls = [split_url(u) for u in batch.column("url").to_pylist()]
    found = rules.sweep(urls)
    text = lambda xs: pa.array(xs, pa.string())
    return [text([u[0] for u in urls]), text([u[1] for u in urls]), text([f[0] if f else None for f in found]), text([f[1] if f else default for f in found])]


def judge(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]], default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every page. rules: (action, host, path) in order, or a table of them with that order in `n`."""
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    fields = f"id {dict(urls.dtypes)['id']}, host string, path string, rule string, verdict string"
    names = ["id", "host", "path", "rule", "verdict"]
    if isinstance(rules, list):
        few = len(rules) <= RULES and sum(len(h or "") + len(p or "") + 64 for _, h, p in rules) <= RULE_BYTES
        table = None if few else spark.createDataFrame([(*r, n) for n, r in enumerate(rules)], "action string, host string, path string, n long")
    else:
        table = rules.select("action", "host", "path", F.col("n").cast("long").alias("n"))
        size = table.agg(F.count(F.lit(1)), F.sum(F.length(F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit("")))) + 64)).first()
        few = size[0] <= RULES and (size[1] or 0) <= RULE_BYTES
        rules = [tuple(r)[:3] for r in table.orderBy("n").collect()] if few else rules
    if few:
        shared = spark.sparkContext.broadcast(Rules(rules))

        def step(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("id"), *_judged(batch, shared.value, default)], names=names)

        return urls.mapInArrow(tidy(step), fields)
    return _by_ranges(urls, table, default, fields, names)


def _by_ranges(urls: DataFrame, rules: DataFrame, default: str, fields: str, names: list[str]) -> DataFrame:
    """The join for rules that no task may hold: ranges of urls, each with the rules that it meets."""
    spark = urls.sparkSession
    ranges = max(1, -(-urls.count() // RANGE_URLS), -(-rules.count() // RULES))

    def place(url: str | None) -> str:
        host, path = split_url(url)
        return f"{host_key(host)}\0{path}" if host else ""

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([place(u) for u in batch.column("url").to_pylist()], pa.string())], names=["key"])

    # At most about SAMPLED keys a range.
    share = min(1.0, SAMPLED * ranges / max(1, urls.count()))
    picked = urls.where(F.pmod(F.xxhash64("url", "id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("url").mapInArrow(tidy(keys), "key string").orderBy("key").toArrow()["key"].to_pylist()
    bounds = spark.sparkContext.broadcast([picked[k * len(picked) // ranges] for k in range(1, ranges)] if picked else [])

    def deal_urls(batches):
        for n, batch in enumerate(batches):
            parts = []
            for k, u in enumerate(batch.column("url").to_pylist()):
                key = place(u)
                lo, hi = bisect_left(bounds.value, key), bisect_right(bounds.value, key)
                parts.append(lo if lo == hi else lo + zlib.crc32(f"{n}:{k}".encode()) % (hi - lo + 1))  # equal bounds share what is equal
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int32())], names=["id", "url", "part"])

    def deal_rules(batches):
        for batch in batches:
            rows, parts = [], []
            for k, host in enumerate(batch.column("host").to_pylist()):
                if host is not None:
                    low = host_key(host.translate(_LOWER))
                    here = range(bisect_left(bounds.value, low), bisect_right(bounds.value, low + _LAST) + 1)
                    rows += [k] * len(here)
                    parts += here
            out = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(parts, pa.int32())], names=["action", "host", "path", "n", "part"])

    def judge_range(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("n")
        rules = Rules(zip(*[right.column(c).to_pylist() for c in ("action", "host", "path")], strict=True))
        return pa.table([left.column("id"), *_judged(left, rules, default)], names=names)

    kind = dict(urls.dtypes)["id"]
    dealt = urls.mapInArrow(tidy(deal_urls), f"id {kind}, url string, part int").groupBy("part")
    return dealt.cogroup(rules.mapInArrow(tidy(deal_rules), "action string, host string, path string, n long, part int").groupBy("part")).applyInArrow(judge_range, fields)


def op6_query(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of all pages under the five fixed rules."""
    found = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), QUERY_RULES)
    return found.withColumnRenamed("id", "page_id")


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
r(action, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
      FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.action, 'allow') AS verdict FROM u LEFT JOIN f ON u.page_id = f.page_id
"""
