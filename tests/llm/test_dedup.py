import random

import numpy as np
import pytest
import xxhash

from chronobin.llm import embeddings, simhash
from chronobin.llm.common import components

SHAPE = "doc_id long, text string, fp long, row string, label string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], SHAPE)


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(fps, radius):
    """fps: [(id, fp)] to the least id of each row's component."""
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (i, _), x in zip(fps, label, strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return [least.get(x) for x in label]


def corpus(n=80):
    rng = random.Random(1)
    words = ["Alpha", "beta", "GAMMA", "delta\u00c9", "eps", "zeta", "eta", "theta"]
    base = [" ".join(rng.choices(words, k=rng.randint(3, 60))) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        t = rng.choice(base).split(" ")
        if i % 3:
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, rng.choice([" ", "\t", "\n"]).join(t)))
    return [*rows, (500, None), (501, ""), (502, " \n\t"), (503, "one"), (504, "ONE"), (505, "two words"), (None, rows[0][1]), (7, rows[7][1]), (506, "word " * 50_000)]


@pytest.mark.parametrize(("shingle", "radius"), [(3, 3), (5, 3), (3, 6)])
def test_simhash_against_brute_force(spark, shingle, radius):
    rows = corpus()
    got = simhash.near_duplicates(docs(spark, rows), shingle, radius).collect()
    fps = {}
    for i, t in rows:
        fps.setdefault(i, brute_fingerprint(t, shingle) if t is None or len(t) < 9999 else simhash.fingerprint(t.encode(), shingle))
    assert sorted((str(r.id), r.fp & (1 << 64) - 1) for r in got) == sorted((str(i), fps[i]) for i, _ in rows)
    want = dict(zip([str(i) for i, _ in rows], brute_components([(i, fps[i]) for i, _ in rows], radius), strict=True))
    assert {str(r.id): r.component for r in got} == want


def test_covering_masks_miss_nothing():
    rng = random.Random(2)
    for radius in (1, 2, 3, 4):
        tables = simhash.masks(radius)
        assert len(tables) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            diff = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(diff & m == 0 for m in tables)


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    fps = [(1 << a) ^ (1 << b) for a in range(10) for b in range(a)] + [(1 << 60) + (15 << 30)]
    edges = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 3)
    labels = {r.node: r.label for r in components(edges).collect()}
    want = brute_components(list(enumerate(fps)), 3)
    groups = {}
    for f, w in zip(fps, want, strict=True):
        groups.setdefault(w, set()).add(labels.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({g for s in groups.values() for g in s}) == len(groups)


def test_deduplicate_keeps_one_of_each_group_and_all_columns(spark):
    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (1, "A b c d e f"), (9, "something else that is quite long enough"), (None, "x y z"), (None, "x y z"), (20, None), (21, "")]
    df = docs(spark, rows)
    got = simhash.deduplicate(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted([("1", "A b c d e f"), ("9", rows[3][1]), ("None", "x y z"), ("20", None)])
    assert simhash.deduplicate(df.limit(0)).count() == 0


def test_deduplicate_against_jaccard(spark):
    """Groups are those of five-word shingles of a Jaccard similarity of 0.8 or more; the texts leave a gap around it."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for k in range(60):
        base = rng.choices(words, k=rng.choice([150, 400]))
        rows.append((len(rows), " ".join(base)))
        for edits in (1, 2, 9 if len(base) < 200 else 25):  # similarities over 0.85, and under 0.7
            t = list(base)
            for at in range(edits):
                t[(at * len(t)) // edits + rng.randrange(6)] = f"x{k}"
            rows.append((len(rows), " ".join(t)))
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    first = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            similar = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            assert not 0.7 < similar < 0.85
            if similar >= 0.8:
                first[i] = min(first[i], first[j])
    got = {r.doc_id for r in simhash.deduplicate(docs(spark, rows)).select("doc_id").collect()}
    assert got == set(first) and 60 < len(got) < len(rows)


def test_deduplicate_judges_repeated_lines_by_distinct_shingles(spark, monkeypatch):
    """A repeated line neither links texts that share nothing else nor parts near copies."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    line = rng.choices(words, k=12)
    a, b, c = (rng.choices(words, k=300) for _ in range(3))
    texts = [a + line * 40, b + line * 40, c + line, c + line * 20]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    for _ in range(2):
        assert {r.doc_id for r in simhash.deduplicate(docs(spark, rows)).select("doc_id").collect()} == {0, 1, 2}
        monkeypatch.setattr(simhash, "PIECES", 200)
        monkeypatch.setattr(simhash, "BLOCK", 2)


def test_deduplicate_decides_by_exact_similarity(spark):
    """Pairs just over and just under 0.8, which fingerprints cannot tell apart."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(5000)]
    rows, want = [], set()
    for k in range(40):
        base = rng.choices(words, k=204)  # 200 shingles; the last m of the words changed: (200 - m) / (200 + m)
        for m in (0, 22 if k % 2 else 23):
            rows.append((len(rows), " ".join(base[: 204 - m] + [f"x{k}.{i}" for i in range(m)])))
            if m != 22:
                want.add(rows[-1][0])
    got = {r.doc_id for r in simhash.deduplicate(docs(spark, rows)).select("doc_id").collect()}
    assert got == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5001), (5001, 5000), (6000, 6000)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[i] for i in range(1000, 1100)}) == 1 and len(set(got.values())) == 3 and 6000 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows = []
    for i in range(300):
        v = base[rng.integers(30)] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.3])
        rows.append((i, [float(x) for x in v.astype("f4")], int(i % 3)))
    rows += [(400 + k, rows[5][1], rows[5][2]) for k in range(20)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [float("inf")] + [1.0] * 15, 1), (504, [None] + [1.0] * 15, 1), (505, rows[0][1], None), (506, [2 * x for x in rows[0][1]], rows[0][2]), (507, [1.0, 0.0], 0), (508, [1.0, 0.01], 0), (509, [], 0), (None, rows[9][1], rows[9][2])]
    return rows


def test_embeddings_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, node int, copies int")
    got = sorted(((r.id, r.n_links, r.component, r.kept) for r in embeddings.near_duplicates(df).collect()), key=str)
    good = [k for k, (_, v, lab) in enumerate(rows) if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], "f4").astype(float), np.array(rows[b][1], "f4").astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[a].add(b)
    want, seen = [None] * len(rows), set()
    for k in range(len(rows)):
        if k not in seen:
            group, todo = {k}, [k]
            while todo:
                for j in links[todo.pop()] - group:
                    group.add(j)
                    todo.append(j)
            seen |= group
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            for j in group:
                c = min(ids) if ids else None
                want[j] = (rows[j][0], len(links[j]), c, c is not None and c == rows[j][0])
    assert got == sorted(want, key=str)


def test_embeddings_lists_are_split(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=8)
    rows = [(i, [float(x) for x in v + rng.normal(size=8) * 0.01], 1) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "CHUNK", 8)
    assert {(r.n_links, r.component) for r in embeddings.near_duplicates(df, lists=2).collect()} == {(59, 0)}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("lists", [64, 256, 1024])
def test_embeddings_find_links_just_over_the_threshold(spark, monkeypatch, lists):
    """Links between vectors of different lists, however many lists there are; found ones are right in count and component."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1100, 64))
    v /= np.sqrt((v * v).sum(1))[:, None]
    side = rng.normal(size=v.shape)
    side -= (side * v).sum(1)[:, None] * v
    side /= np.sqrt((side * side).sum(1))[:, None]
    both = np.concatenate([v, 0.932 * v + np.sqrt(1 - 0.932**2) * side])
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(both)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embeddings, "BLOCK", 900)
    monkeypatch.setattr(embeddings, "SAMPLE", 1200)
    got = {r.id: (r.n_links, r.component) for r in embeddings.near_duplicates(df, lists=lists).collect()}
    linked = {i for i, (n, _) in got.items() if n}
    assert len(linked) >= 0.97 * 2200 and all(got[i] == ((1, i % 1100) if i in linked else (0, i)) for i in range(2200))


def recall(spark, x, lists=None, every=1):
    """Share of the brute-force links of the queries, every so manyth row, that are found; no row has more than its own."""
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.id: r.n_links for r in embeddings.near_duplicates(df, lists=lists).collect()}
    u = x / np.sqrt((x * x).sum(1))[:, None]
    want = {i: int((u @ u[i] >= 0.93).sum()) - 1 for i in range(0, len(x), every)}
    assert all(got[i] <= n for i, n in want.items())
    return sum(got[i] for i in want) / sum(want.values())


@pytest.mark.parametrize(("spread", "lists"), [(0.1, None), (0.25, 64), (0.25, 256)])
def test_embeddings_in_a_dense_cluster_link(spark, spread, lists):
    """Half of all vectors in one cluster, whose links lie far over the threshold or around it."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    x = np.concatenate([rng.normal(size=(1500, 16)), centre + spread * rng.normal(size=(1500, 16))])
    assert recall(spark, x, lists, every=100 if lists is None else 1) >= 0.99


def test_embeddings_of_one_component_link(spark):
    x = np.concatenate([np.arange(1, 11), -np.arange(1, 4)]).astype(float)[:, None]
    assert recall(spark, x, 4) == 1


def test_embeddings_of_rare_lengths_link(spark, monkeypatch):
    """Few vectors of one length among many of another, and more lengths than get an index."""
    monkeypatch.setattr(embeddings, "SAMPLE", 40)
    monkeypatch.setattr(embeddings, "INDEXED", 3, raising=False)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=64).tolist(), 1) for i in range(4000)]
    want = {i: (0, i) for i in range(4000)}
    for dim in range(8, 33):
        x = rng.normal(size=dim)
        for k in range(2):
            at = len(rows)
            rows.append((at, (x + rng.normal(size=dim) * 0.01).tolist(), 1))
            want[at] = (1, at - k)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r.id: (r.n_links, r.component) for r in embeddings.near_duplicates(df).collect()} == want
