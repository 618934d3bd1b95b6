"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint has 64 bits: bit i is 1 if more than half of the XXH64 hashes (seed 42) of the
text's word shingles have it set. Fingerprints link at Hamming distance <= radius.

Covering LSH (Pagh, 2016): give bit i the non-zero vector phi(i) of radius + 1 bits, and let
table v (any non-zero vector) keep the bits with <phi(i), v> = 1. For any set of at most
radius differing bits some v is orthogonal to all their phi(i): radius vectors cannot span a
space of radius + 1 dimensions. That table masks all differing bits, so the pair collides
there. No pair within the radius is missed; collisions are checked exactly.

Defined results: null, empty and blank texts have no words and fingerprint zero, which links
like any other; texts with fewer words than a shingle hash their whole word sequence; equal
fingerprints are one node, so copies never form pairs; repeated rows stay; a null id is never
the least of its component unless all of its ids are null. Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, release, spread, tidy, unused

#: Fingerprints of one bucket that one task compares; larger buckets are dealt out as pairs of blocks.
BLOCK = 1024
#: Shingles of a block of texts, on average at most.
PIECES = 1 << 19


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text; bytes.lower and bytes.split act on ASCII alone."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i : i + shingle]), 42) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, fp) of every row; row is a hash of id and text, fp the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            values = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], names=["id", "row", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).cast("binary").alias("text"))
    return spread(rows).mapInArrow(tidy(run), "id long, row long, fp long")


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def masks(radius: int = 3, bits: int = 64) -> list[int]:
    """The bit mask of each covering table, 2 ** (radius + 1) - 1 of them."""
    size = 2 ** (radius + 1) - 1
    phi = [1 + i % size for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what is within the radius in one block, or between two: a spanning forest."""
    nodes = left if right is None else np.concatenate([left, right])
    parent = np.arange(len(nodes))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i in range(len(left)):
        base, others = (i + 1, left[i + 1 :]) if right is None else (len(left), right)
        near = np.nonzero(np.bitwise_count(others ^ left[i]) <= radius)[0]
        for j in near:
            a, b = root(i), root(base + int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((int(nodes[i]), int(nodes[base + int(j)])))
    return edges


def _links(radius: int):
    """Reads rows (t, key, i, j, side, fp) sorted by bucket and block pair; yields spanning edges."""

    def flush(left, right, own, out):
        a = np.asarray(left, np.int64).view(np.uint64)
        found = _forest(a, None if own else np.asarray(right, np.int64).view(np.uint64), radius)
        out.extend(found)

    def run(batches):
        at, left, right, out = None, [], [], []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for t, key, i, j, side, fp in zip(*cols, strict=True):
                if (t, key, i, j) != at:
                    if at is not None:
                        flush(left, right, at[2] == at[3], out)
                    at, left, right = (t, key, i, j), [], []
                (right if side else left).append(fp)
            if out:
                u, v = np.array(out, np.uint64).T
                yield pa.RecordBatch.from_arrays([pa.array(u.copy().view(np.int64)), pa.array(v.copy().view(np.int64))], names=["u", "v"])
                out = []
        if at is not None:
            flush(left, right, at[2] == at[3], out)
        if out:
            u, v = np.array(out, np.uint64).T
            yield pa.RecordBatch.from_arrays([pa.array(u.copy().view(np.int64)), pa.array(v.copy().view(np.int64))], names=["u", "v"])

    return run


def near_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (u, v) between distinct fingerprints fps(fp) that connect exactly what links within the radius.

    A bucket of n fingerprints gives at most n - 1 edges a block pair, never all its pairs.
    Buckets over BLOCK fingerprints are split into blocks, whose pairs are compared by
    different tasks.
    """
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.lit(_signed(m)).alias("m")) for k, m in enumerate(masks(radius))])
    rows = fps.select("fp", F.explode(tables).alias("x")).select("fp", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    shared = rows.join(sizes, ["t", "key"]).withColumn("b", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("b")).cast("int"))
    shared = shared.select("t", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("o"))
    dealt = shared.select("t", "key", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).cast("int").alias("side"), "fp")
    dealt = dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return dealt.mapInArrow(tidy(_links(radius)), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, fp, component, leader) of every row.

    component is the least id reachable through links, the row's own included; leader is the
    row key of the one document that stands for the component (of those with its least id).
    """
    rows = materialise(fingerprints(docs, shingle, id_col, text_col), "simhash")
    lead = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    nodes = materialise(rows.groupBy("fp").agg(F.min(lead).alias("first")), "simhash-nodes")
    labels = components(near_links(nodes.select("fp"), radius), "simhash-cc")
    grouped = nodes.join(labels.select(F.col("node").alias("fp"), "label"), "fp")
    least = grouped.groupBy("label").agg(F.min("first").alias("lead"))
    joined = materialise(grouped.join(least, "label").select("fp", "lead"), "simhash-least")
    classes = nodes.join(joined, "fp", "left").select("fp", F.coalesce("lead", "first").alias("lead"))
    classes = materialise(classes.select("fp", F.col("lead.id").alias("component"), F.col("lead.row").alias("leader")), "simhash-class")
    release(nodes, labels, joined)
    return rows.join(classes, "fp").select("id", "row", "fp", "component", "leader")


# -- similarity beyond a few bits ----------------------------------------------------------------

#: Words of 64 bits of a wide fingerprint: 1024 bits tell a similarity of 0.8 to about 0.03.
WIDE = 16
#: What the shingles' hashes are mixed with for each word.
STEP = 0x9E3779B97F4A7C15


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + shingle]), 42) for i in range(n)), np.uint64, n))


def wide_fingerprint(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """SimHash of WIDE words over the distinct shingles; each word but the first takes their hashes mixed anew."""
    found = shingle_set(text, shingle)
    if not len(found):
        return np.zeros(WIDE, np.uint64)
    mix = np.arange(WIDE, dtype=np.uint64) * np.uint64(STEP)
    ones = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(found), 1 << 12):
        hashes = found[at : at + (1 << 12)]
        h = hashes[:, None] + mix
        # The finaliser of SplitMix64.
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        h[:, 0] = hashes
        bits = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # a byte counts so many
            ones += bits[k : k + 255].sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(found), bitorder="little").view("<u8")


def _wide_rows(shingle: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            values = np.array([wide_fingerprint(t.as_py(), shingle) for t in texts], np.uint64).reshape(-1, WIDE).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(values[:, k]) for k in range(WIDE)]], names=["id", "row", *[f"w{k}" for k in range(WIDE)]])

    return run


def sampling(similarity: float, n: int) -> tuple[int, int, int]:
    """(radius, bits of a key, tables) for a Jaccard similarity of shingles among n fingerprints.

    Keys grow with log n, so buckets of unrelated texts stay small, and tables with them, so
    that a pair at the threshold meets with probability 1 - exp(-4), closer ones more surely.
    The radius only makes candidates: sets of few shingles differ in up to 0.04 more of their
    bits (4 of 5 shingles: 3/16), and five standard deviations are added.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    far = min(0.5, share + 0.04)
    radius = math.ceil(64 * WIDE * far + 5 * math.sqrt(64 * WIDE * far * (1 - far)))
    bits = min(48, max(12, math.ceil(math.log2(max(2, n))) + 3))
    return radius, bits, math.ceil(4 / (1 - share) ** bits)


def _wide_links(radius: int):
    """As _links, over rows (key, i, j, side, node, w0, w1, ...)."""

    def pairs(left, right):
        nodes = left if right is None else left + right
        if len(nodes) <= 12:
            values = [int.from_bytes(f) for _, f in nodes]
            for i in range(len(left)):
                for j in range(i + 1 if right is None else len(left), len(nodes)):
                    if (values[i] ^ values[j]).bit_count() <= radius:
                        yield i, j
            return
        m = np.frombuffer(b"".join(f for _, f in nodes), np.uint64).reshape(-1, WIDE)
        for i in range(len(left)):
            base = i + 1 if right is None else len(left)
            for j in np.nonzero(np.bitwise_count(m[base:] ^ m[i]).sum(1) <= radius)[0].tolist():
                yield i, base + j

    def flush(left, right, own, out):
        nodes = left if own else left + right
        parent = list(range(len(nodes)))
        for i, j in pairs(left, None if own else right):
            while parent[i] != i:
                i = parent[i]
            while parent[j] != j:
                j = parent[j]
            if i != j:
                parent[max(i, j)] = min(i, j)
                out.append((nodes[i][0], nodes[j][0]))

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    def run(batches):
        at, left, right, out = None, [], [], []
        for batch in batches:
            raw = np.column_stack([batch.column(f"w{k}").to_numpy() for k in range(WIDE)]).tobytes()
            rows = zip(*[batch.column(c).to_pylist() for c in ("key", "i", "j", "side", "node")], strict=True)
            for n, (key, i, j, side, node) in enumerate(rows):
                if (key, i, j) != at:
                    if at is not None:
                        flush(left, right, at[1] == at[2], out)
                    at, left, right = (key, i, j), [], []
                (right if side else left).append((node, raw[8 * WIDE * n : 8 * WIDE * (n + 1)]))
            if out:
                yield batch_of(out)
                out = []
        if at is not None:
            flush(left, right, at[1] == at[2], out)
        if out:
            yield batch_of(out)

    return run


def similar_links(nodes: DataFrame, similarity: float, n: int) -> DataFrame:
    """Candidate edges between nodes(node, w0, w1, ...) whose fingerprints differ in no more bits than the radius."""
    radius, bits, tables = sampling(similarity, n)
    rng = np.random.default_rng(5)
    literal = []
    for t in range(tables):
        mask = [0] * WIDE
        for b in rng.choice(64 * WIDE, bits, replace=False).tolist():
            mask[b // 64] |= 1 << b % 64
        literal.append(F.struct(F.lit(t).alias("t"), *[F.lit(_signed(m)).alias(f"m{k}") for k, m in enumerate(mask)]))
    words = [f"w{k}" for k in range(WIDE)]
    rows = nodes.select("node", *words, F.explode(F.array(*literal)).alias("x"))
    rows = rows.select(F.xxhash64("x.t", *[F.col(f"w{k}").bitwiseAND(F.col(f"x.m{k}")) for k in range(WIDE)]).alias("key"), "node", *words)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Only the keys travel in the join; fingerprints follow for those that share a bucket.
    shared = rows.select("key", "node").join(sizes, "key").withColumn("b", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    shared = shared.withColumn("own", F.pmod(F.xxhash64("node"), F.col("b")).cast("int")).select("key", "node", "own", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("o"))
    dealt = shared.join(nodes.select("node", *words), "node")
    dealt = dealt.select("key", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).cast("int").alias("side"), "node", *words)
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(tidy(_wide_links(radius)), "u long, v long")


def _exact_links(similarity: float):
    """Reads rows (label, i, j, side, node, found) sorted by group and block pair; yields a spanning forest of the pairs at or over the similarity."""

    def flush(left, right, out):
        both = left + right
        nodes, sizes = [n for n, _ in both], np.array([len(f) for _, f in both])
        ids = np.unique(np.concatenate([f for _, f in both]), return_inverse=True)[1]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        held, group = np.zeros(len(ids), np.int32), np.arange(len(both))
        for a in range(len(left)):
            base = len(left) if right else a + 1
            if base == len(both):
                break
            own = ids[starts[a] : starts[a + 1]]
            held[own] = 1
            shared = np.add.reduceat(held[ids[starts[base] :]], starts[base:-1] - starts[base])
            held[own] = 0
            near = base + np.nonzero(shared / (sizes[a] + sizes[base:] - shared) >= similarity)[0]
            tied, one = np.unique(group[near], return_index=True)
            for g, k in zip(tied.tolist(), one.tolist(), strict=True):
                if g != group[a]:
                    out.append((nodes[a], nodes[near[k]]))
            if len(tied):
                group[np.isin(group, tied)] = group[a]

    def run(batches):
        at, left, right, out = None, [], [], []
        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in ("label", "i", "j", "side", "node")], strict=True)
            for (label, i, j, side, node), found in zip(keys, batch.column("found"), strict=True):
                if (label, i, j) != at:
                    if left and (right or at[1] == at[2]):
                        flush(left, right, out)
                    at, left, right = (label, i, j), [], []
                if raw := found.as_py():  # a text without words is like no other
                    (right if side else left).append((node, np.frombuffer(raw, np.uint64)))
            if out:
                yield batch_of(out)
                out = []
        if left and (right or at[1] == at[2]):
            flush(left, right, out)
        if out:
            yield batch_of(out)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def exact_links(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges that connect exactly the texts(label, node, text) of one label whose Jaccard similarity is at least this.

    The shingle sets are written once. A label of many texts, or of long ones, is split into
    blocks, whose pairs are compared by different tasks; n texts of two blocks give at most
    n - 1 edges, never all their pairs.
    """

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["label", "node", "found"])

    sets = materialise(spread(texts).mapInArrow(tidy(run), "label long, node long, found binary"), "wide-sets")
    sizes = sets.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("found") / 8).alias("s")).where("n > 1")
    sizes = sizes.select("label", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / PIECES)).cast("int").alias("b"))
    shared = sets.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64("node"), F.col("b")).cast("int"))
    shared = shared.select("label", "node", "found", "own", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("o"))
    dealt = shared.select("label", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).cast("int").alias("side"), "node", "found")
    links = materialise(dealt.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(tidy(_exact_links(similarity)), "u long, v long"), "wide-exact")
    release(sets)
    return links


def deduplicate(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component of near-duplicates; its columns as they were.

    Texts link if the Jaccard similarity of their sets of word shingles is at least this.
    Covering tables exist for a few bits only, so wide SimHashes meet in tables of sampled
    bits, whose number grows with the input. Those within a wide radius make groups, and
    every pair of a group is decided by its shingle sets.
    """
    words = [f"w{k}" for k in range(WIDE)]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), row_key(id_col, text_col).alias("row"))
    rows = materialise(spread(texts).mapInArrow(tidy(_wide_rows(shingle)), "id long, row long, " + ", ".join(f"{w} long" for w in words)), "wide")
    lead = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    nodes = materialise(rows.groupBy(*words).agg(F.min(lead).alias("first")).withColumn("node", F.xxhash64(*words)), "wide-nodes")
    release(rows)
    near = materialise(similar_links(nodes.select("node", *words), similarity, nodes.count()), "wide-near")
    groups = components(near, "wide-groups")
    chosen = nodes.join(groups, "node").select(F.col("first.row").alias("row"), "node", "label")
    grouped_texts = texts.join(chosen, "row").dropDuplicates(["node"]).select("label", "node", "text")
    links = exact_links(grouped_texts, shingle, similarity)
    labels = components(links, "wide-cc")
    grouped = nodes.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    keep = materialise(grouped.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_simhash_row")), "wide-keep")
    release(nodes, near, groups, links, labels)
    mark = unused("_simhash_row", docs)
    out = docs.withColumn(mark, row_key(id_col, text_col)).join(keep.withColumnRenamed("_simhash_row", mark), mark, "left_semi")
    return out.dropDuplicates([mark]).select(*docs.columns)


def op1_query(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
