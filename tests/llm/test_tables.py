"""Mixing, sharding, url filters and licenses against plain Python."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronobin.llm import licenses, mixing, queries, sharding, urlfilter

SHAPE = "doc_id long, text string, source string, size int, h string, slot int, _mix_x int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "h", 2, 3) for i, t, s in rows], SHAPE)


def rows_of(n=400):
    out = [(i, " ".join(["w"] * (1 + i * 7 % 23)), "abcde"[min(4, i % 9)]) for i in range(n)]
    return [*out, (900, None, "a"), (901, "", None), (902, "x y", None), (903, "huge " * 9000, "big"), (None, "n u l l", "b"), (3, out[3][1], out[3][2]), (904, "tail\x1fword \x85 x", "z")]


def water_fill(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    rest = float(total)
    while True:
        level = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if level[s] > cap * sizes[s]]
        if not over:
            return target | level
        for s in over:
            target[s] = float(cap * sizes[s])
            rest -= target[s]
            open_.remove(s)


def test_mixing(spark):
    rows = rows_of()
    df = table(spark, rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    plan = mixing.mix_plan(df, F.col("source"), mixing.word_count(F.col("text")), F.col("doc_id"))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = water_fill(sizes)
    got = {r.source: r for r in plan.collect()}
    assert {s: r.source_size for s, r in got.items()} == dict(sizes)
    assert all(math.isclose(got[s].target, want[s], rel_tol=1e-9) for s in want)
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    taken = mixed.collect()
    times = Counter((r.doc_id, r.text, r.source) for r in taken)
    assert max(times.values()) <= 6  # a row that is there twice, three times each
    by = defaultdict(int)
    largest = defaultdict(int)
    for r in taken:
        by[r.source] += size(r.text)
    for _, t, s in rows:
        largest[s] = max(largest[s], size(t))
    assert all(abs(by[s] - want[s]) <= largest[s] for s in want)
    # The threshold is a hash cut: whoever is taken more often has the smaller hash.
    for s, p in got.items():
        for i, t, src in rows:
            if src == s and size(t):
                h = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
                assert times.get((i, t, s), 0) // (2 if i == 3 else 1) == p.passes + (h < p.threshold)
    assert mixing.mixed(df.limit(0)).count() == 0


@pytest.mark.parametrize("levels", [3, 10_000])
def test_targets_of_many_sources(spark, monkeypatch, levels):
    """The water level is the same whether classes are seen at once or span by span."""
    monkeypatch.setattr(mixing, "LEVELS", levels)
    rng = random.Random(5)
    sizes = {f"s{k:03}": rng.choice([0, 1, 7, 100, rng.randint(1, 10_000), 1_000_000 * (k % 40 == 0)]) for k in range(120)} | {None: 50}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = water_fill(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)
    assert mixing.targets(spark.createDataFrame([], "source string, source_size long")).count() == 0


def test_mixing_reruns_agree(spark):
    df = table(spark, rows_of())
    a, b = (mixing.mix_plan(x, F.col("source"), mixing.word_count(F.col("text")), F.col("doc_id")).orderBy("source").collect() for x in (df, df.repartition(3)))
    assert a == b


def test_sharding(spark):
    rows = rows_of()
    got = sharding.shard_documents(table(spark, rows)).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"key"} and {r.shard for r in got} <= set(range(40))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(table(spark, rows).limit(0)).count() == 0


def test_sharding_of_a_row_repeated_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 700)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
    hot = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "'same' as text").repartition(5)
    rest = spark.range(3000).selectExpr("cast(if(id < 1000, null, id) as long) as doc_id", "cast(id as string) as text")
    got = sharding.shard_documents(hot.unionByName(rest)).collect()
    assert len(got) == 23_000 and len({r.shard for r in got if r.doc_id is None}) == 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    copies = sorted(r.slot for r in got if r.text_crc32 == zlib.crc32(b"same"))
    assert copies == list(range(copies[0], copies[0] + 20_000))


def test_sharding_is_even_and_confines_movement(spark):
    ids = spark.range(40_000)
    even = Counter(r.s for r in sharding.assign(ids, "id", sharding.TREE, "s").collect())
    assert len(even) == 40 and max(abs(n - 1000) for n in even.values()) < 200
    tree = (((1.0, 3.0), (2.0,)), ((1.0, 1.0),))
    heavier = (((1.0, 3.0), (4.0,)), ((1.0, 1.0),))
    both = sharding.assign(sharding.assign(ids, "id", tree, "a"), "id", heavier, "b")
    a = Counter(r.a for r in both.collect())
    assert all(abs(a[k] / 40_000 - w / 8) < 0.02 for k, w in enumerate((1, 3, 2, 1, 1)))
    moved = Counter((r.a, r.b) for r in both.where("a <> b").collect())
    # Rows leave the other region only for the region that grew, and its first rack only for its second.
    assert all(b in (0, 1, 2) for a_, b in moved if a_ in (3, 4)) and all(b == 2 for a_, b in moved if a_ in (0, 1)) and not any(a_ == 2 for a_, b in moved)


RULES = [*urlfilter.QUERY_RULES, ("block", "a.example.net", "/de/"), ("allow", "Example.net", "/de/8/x")]


def brute_url(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), n, h + p, a) for n, (a, h, p) in enumerate((a, h.lower(), p) for a, h, p in rules) if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/7", "https://a.example.com/en/71?x", "http://xexample.com/en/7", "http://com/en/", "http://net/de/", "http://example.net/de/8/x", "http://a.example.net/de/8/x", "http://b.a.example.net/de/8", "http://example.org?q=/es/", "http://example.org/es/#top", "x://y://z.org/es/", "http://example.com:80/en/7", "http://.com/en/", "http://com./en/", "http://é.org/es/é", "http://İ.COM/en/"]


#: Equal lengths (the longer host wins), repeated rules (the last stands), paths within paths.
TIES = [("block", "b", "/xx"), ("allow", "a.b", "/"), ("allow", "q.b", "/x"), ("block", "q.b", "/x"), ("allow", "b", "/xx/y"), ("block", "a.b", "/xx"), ("allow", "a.b", "/xx"), ("block", "z.a.b", "")]
TIED = [f"http://{h}{p}" for h in ("b", "a.b", "q.b", "c.q.b", "z.a.b", "y.z.a.b", "ab", "B") for p in ("", "/", "/x", "/xx", "/xx/y/z", "/xy?q=/xx")]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_url_rules(spark, monkeypatch, block):
    """Few rules, shipped to the tasks, and many, by ranges, give the same verdicts."""
    monkeypatch.setattr(urlfilter, "RULES", block)
    monkeypatch.setattr(urlfilter, "RANGE_URLS", 10)
    rules, table = RULES + TIES, None
    rows = [(k, u, "h", "r") for k, u in enumerate(URLS * 2 + TIED + [URLS[4]] * 30)] + [(None, URLS[4], "h", "r"), (0, URLS[0], "h", "r"), (5000, "http://a.b/xx" + "x" * 100_000, "h", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    want = Counter((k, *brute_url(u, rules)) for k, u, _, _ in rows)
    table = spark.createDataFrame([(*r, n) for n, r in enumerate([*rules, ("block", None, "/en")])], "action string, host string, path string, n int").repartition(3)
    for given in (rules, table):
        assert Counter(tuple(r) for r in urlfilter.judge(df, given).select("id", "host", "path", "rule", "verdict").collect()) == want
    assert urlfilter.judge(df.limit(0), rules).count() == 0 and {r.verdict for r in urlfilter.judge(df, [], "block").collect()} == {"block"}


def test_many_url_rules_take_no_longer_a_url():
    """200,000 hosts and 100,000 paths of one host: a sweep gallops over the rules and tries paths by their lengths."""
    import time

    many = urlfilter.Rules([*[("block", f"h{k}.com", "/a") for k in range(200_000)], *[("block", "one.org", f"/p/{k}") for k in range(100_000)]])
    urls = [(f"x.h{k * 37 % 200_000}.com", "/ab") for k in range(1000)] + [("www.one.org", f"/p/{k}/q") for k in range(1000)]
    began = time.perf_counter()
    found = many.sweep(urls)
    assert time.perf_counter() - began < 1 and all(found) and found[1001] == ("one.org/p/1", "block")


def units_of(text):
    paragraphs, lines = re.split(licenses.PARAGRAPH, text), re.split(licenses.LINE, re.sub(licenses.SENTENCE, r"\1\n", text))
    kinds = {}
    for kind, u in [(0, text), (1, paragraphs[0]), *[(2, u) for u in paragraphs + lines]]:
        kinds.setdefault(u, kind)
    return kinds


def brute_license(text):
    """((cosine, -template, -kind), whether the whole text is a license, whether its last line is) over every unit, no bound."""
    idf, unknown, units = licenses.vectors()
    best, whole, closed = None, False, False
    ends = re.split(licenses.LINE, re.sub(licenses.SENTENCE, r"\1\n", (text or "").rstrip(" ").split("\n")[-1]))
    for unit, kind in units_of(text or "").items():
        c = Counter(w for w in re.findall(licenses.TOKEN, unit.lower()) if w not in licenses.STOP)
        v = {w: n * idf.get(w, unknown) for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        found = max(((min(1.0, round(sum(x * u.get(w, 0) for w, x in v.items()) / norm / licenses.NORM, 6)), -k, -kind) for k, u in enumerate(units)), default=None) if norm else None
        if found and found[0] >= licenses.THRESHOLD:
            best = max(best or found, found)
            whole |= kind == 0
            closed |= unit in ends
    return best, whole, closed


def test_licenses(spark):
    mit = licenses.TEMPLATES[2][1]
    files = [
        ("a/LICENSE", "Released under the MIT License.", 1), ("a/x.txt", "nothing", 2), ("a/b/y.txt", "", 3), ("a/b/c/z.txt", None, 4),
        ("a/b/COPYING", "Intro.\nLicensed under CC BY-NC 4.0. More words follow here.", 5), ("a/b/own.txt", "Text. This work is licensed under the GNU General Public License, version 2. End", 6),
        ("d/f.txt", "A licence to kill is a different thing altogether", 7), ("top.txt", "w", 8), (None, "Released under the MIT License.", 9), (None, "none", None), (None, "plain words only", None), (None, "Some.\nReleased under the MIT License.", None), ("e/LICENSE", "no notice", 10),
        ("a/dup.txt", "Licensed under the Apache License, Version 2.0.", 11), ("a/dup.txt", "Licensed under the Apache License, Version 2.0.", 11), ("a/dup.txt", "another text under the same key and path", 11), ("a/long.txt", "word " * 20_000 + ". Released under the MIT License. " + "more " * 20_000, 12),
        ("g/whole.txt", mit, 13), ("g/h/i.c", "int main;", 14), ("k/head.c", licenses.TEMPLATES[5][1].replace(". ", ".\n# ") + "\n \nbody of the file, with words", 15), ("m/mit.txt", "mit\n\nmit der Hand", 16), ("tie/a.txt", "x y\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.", 17),
    ]
    df = spark.createDataFrame([(k, p, t, "x", 1, "u") for p, t, k in files], "k long, path string, text string, license string, t int, unit string")
    for closing in (False, True):
        spoken = {}
        for p, t, _ in files:
            own, whole, closed = brute_license(t)
            if p and own and (re.search(licenses.LICENCE_FILE, p) or whole or (closing and closed)):
                spoken[p.rpartition("/")[0]] = max(own, spoken.get(p.rpartition("/")[0], own))
        want = Counter()
        for p, t, k in files:
            own, origin, where = brute_license(t)[0], "own", None
            kind = own and licenses.KINDS[-own[2]]
            if own is None:
                origin, up = "none", p.split("/")[:-1] if p else None
                while up is not None:
                    if "/".join(up) in spoken:
                        own, origin, where = spoken["/".join(up)], "inherited", "/".join(up)
                        break
                    up = up[:-1] if up else None
            want[k, p, own and licenses.TEMPLATES[-own[1]][0], own and own[0], kind, origin, where] += 1
        got = licenses.scan(df, F.col("path"), F.col("text"), F.col("k"), closing=closing)
        assert Counter(tuple(r) for r in got.collect()) == want
        by = {x[:2]: x for x in want}
        assert by[14, "g/h/i.c"][2:] == ("MIT", 1.0, None, "inherited", "g") and by[15, "k/head.c"][2] == "Apache-2.0" and by[15, "k/head.c"][4] == "header" and by[16, "m/mit.txt"][2] is None and by[13, "g/whole.txt"][4] == "file"
    assert licenses.scan(df.limit(0), F.col("path"), F.col("text"), F.col("k")).count() == 0


def test_licenses_score_every_unit_that_can_reach_the_threshold(spark):
    notices = [
        ("CC BY 4.0, Creative Commons Attribution", "CC-BY-4.0"), ("Available under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("CC0 1.0 Universal", "CC0-1.0"),
        ("Permission is granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "MIT"),
        ("Use and redistribution in source and binary forms, with or without modification, are permitted", "BSD-3-Clause"), ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", None),
    ]
    df = spark.createDataFrame([(k, f"d{k}/f", f"Some prose.\n{t}") for k, (t, _) in enumerate(notices)], "k long, path string, text string")
    got = {r.key: r.license for r in licenses.scan(df, F.col("path"), F.col("text"), F.col("k")).collect()}
    assert got == {k: n for k, (_, n) in enumerate(notices)}
    # Any words of a template that reach the threshold hold one of those that the bound asks for.
    rng = random.Random(4)
    must = set(licenses.needed())
    for unit in licenses.vectors()[2]:
        for _ in range(2000):
            some = rng.sample(sorted(unit), rng.randint(1, len(unit)))
            if sum((unit[w] / licenses.NORM) ** 2 for w in some) >= licenses.THRESHOLD**2:
                assert must & set(some)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(spark, name):
    """Every query that SQL can express agrees with DuckDB over the small tables."""
    duckdb, sf = pytest.importorskip("duckdb"), "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
