"""Embedding near-dedup by product quantisation within inverted lists.

Vectors that can be compared (not null, finite, not zero) are normalised in double precision;
copies of one vector collapse to one node. For each length a coarse quantiser and residual
codebooks are fitted on a sample bounded by SAMPLE. The number of lists grows with the largest
label of the length, so a label's list holds about LIST vectors at any size.

Every vector is a member of its nearest list, and visits the lists after it that may hold a
link: those whose halving plane towards the own list is no farther than `slack`. Sufficient
probes are measured, not guessed: for pairs of the sample that link, and for pairs made at the
threshold itself, slack is the distance that reaches the partner's list in RECALL of the
cases, for which a few lists do, while the exact bound (the distance of a link) would take
nearly all in many dimensions. So a link at the threshold is found with about that
probability, closer ones more surely, and the work is far from quadratic.

A label's list is one task. Members and visitors of a list over BLOCK rows are dealt to
blocks, and each pair of blocks is a task. There, distances come from asymmetric table lookups
on the members' residual codes; what is not clearly too far is compared by exact cosine, so
no link below the threshold is returned. Links are summed per vector and joined by a spanning
forest, so a task of n vectors gives at most n - 1 edges, never their pairs.

Defined results: vectors with null or non-finite components, zero vectors, null vectors, other
lengths and null labels link with nothing and are components of their own; copies link with
each other; a null id counts as a row but leads no component unless alone; an empty table
gives no rows; very long vectors make smaller blocks; extra columns are ignored. Lengths with
fewer than LEAST vectors, and those after the INDEXED most frequent ones, have one list, in
which all pairs of blocks are compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, release, tidy

#: Bound on the rows of a length that its quantisers are fitted on, and rows of it that the slack is measured on.
SAMPLE, MEASURED = 65_536, 2000
#: Vectors of a label's list, sampled vectors a list needs, parts of a residual and codes of a part.
LIST, PER_LIST, PARTS, CODES = 1024, 16, 8, 256
#: Share of the links at the threshold that the probes reach.
RECALL = 0.998
CHUNK, BLOCK = 1024, 4096
#: Components of a block at most, and the cells of a distance matrix held at once.
WIDTH, CELLS = 1 << 20, 1 << 20
#: Lengths that get an index at most, and the vectors under which a length gets none.
INDEXED, LEAST = 64, 256


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(0)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, CELLS // len(centres))
    return np.concatenate([_squares(x[at : at + step], centres).argmin(1) for at in range(0, len(x), step)])


class Index:
    """Coarse centroids, the slack of their planes, and the codebooks of the residual's parts."""

    def __init__(self, sample: np.ndarray, lists: int, threshold: float, parts: int = PARTS, codes: int = CODES):
        dim = sample.shape[1]
        self.cuts = np.linspace(0, dim, min(parts, dim) + 1).astype(int)
        self.coarse = _kmeans(sample, lists)
        self.apart = np.sqrt(_squares(self.coarse, self.coarse))
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.books = [_kmeans(np.ascontiguousarray(rest[:, a:b]), codes) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        self.slack = self._measure(sample, threshold)

    def planes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own list, distance from each vector to the plane that halves the way from its own list's centre to each other's)."""
        d = _squares(x, self.coarse)
        own = d.argmin(1)
        out = (d - d.min(1)[:, None]) / np.maximum(2 * self.apart[own], 1e-12)
        out[np.arange(len(x)), own] = 0
        return own, out

    def _measure(self, sample: np.ndarray, threshold: float) -> float:
        """The slack that reaches the partner's list in RECALL of the links at the threshold, and of those within the sample."""
        rng = np.random.default_rng(1)
        dim = sample.shape[1]
        far = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        if len(self.coarse) == 1 or dim == 1:
            return far
        some = sample[rng.choice(len(sample), min(MEASURED, len(sample)), replace=False)]
        side = rng.normal(size=some.shape)
        side -= (side * some).sum(1)[:, None] * some
        made = threshold * some + np.sqrt(max(0.0, 1 - threshold**2)) * side / np.maximum(np.sqrt((side**2).sum(1)), 1e-12)[:, None]
        _, planes = self.planes(some)
        needs = [planes[np.arange(len(some)), _nearest(made, self.coarse)]]
        others = sample[rng.choice(len(sample), min(8 * MEASURED, len(sample)), replace=False)]
        homes = _nearest(others, self.coarse)
        found = []
        for at in range(0, len(some), 64):
            q, other = np.nonzero(some[at : at + 64] @ others.T >= threshold)
            found.append(planes[at + q, homes[other]])
        needs.append(np.concatenate(found))
        return min(far, max(float(np.quantile(n, RECALL)) for n in needs if len(n)))

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the length of what the codes leave out."""
        codes = np.empty((len(rest), len(self.books)), np.uint8)
        left = np.zeros(len(rest))
        for p, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:], strict=False)):
            d = _squares(rest[:, a:b], book)
            codes[:, p] = d.argmin(1)
            left += d.min(1)
        return codes, np.sqrt(left)

    def lookup(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(query, member): squared distances of the queries' residuals to the coded ones, a table a part."""
        out = np.zeros((len(rest), len(codes)), np.float32)
        for p, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:], strict=False)):
            out += np.take(_squares(rest[:, a:b], book).astype(np.float32), codes[:, p], axis=1)
        return out


def _unit(raw: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _places(shared):
    """Rows (dim, label, node, copies, v) once as members of their list (visits false) and once for each list that they visit."""

    def run(batches):
        indexes: dict[int, Index] = shared.value
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = np.nonzero(dims == dim)[0]
                for at in range(0, len(rows), CHUNK):
                    some = rows[at : at + CHUNK]
                    part = batch.take(pa.array(some))
                    who, lists, visits = np.arange(len(some)), np.zeros(len(some), np.int64), np.zeros(len(some), bool)
                    if index := indexes.get(dim):
                        own, planes = index.planes(_unit(part.column("v")))
                        # The later list is visited by the earlier one's vectors, so a pair meets once.
                        q, to = np.nonzero((planes <= index.slack + 1e-9) & (np.arange(planes.shape[1]) > own[:, None]))
                        who, lists, visits = np.concatenate([who, q]), np.concatenate([own, to]), np.concatenate([visits, np.ones(len(q), bool)])
                    out = part.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(lists.astype(np.int32)), pa.array(visits)], names=[*out.schema.names, "list", "visits"])

    return run


def _links(shared, threshold: float):
    """One (dim, label, list, i, j): exact links between two blocks of a list, or within one."""
    r = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    def run(key, table):
        import pyarrow.compute as pc

        dim, place, within = key[0].as_py(), key[2].as_py(), key[3] == key[4]
        table = table.combine_chunks()
        sides, visits = table["side"].to_numpy(), table["visits"].to_numpy(zero_copy_only=False)
        nodes, copies, x = table["node"].to_numpy(), table["copies"].to_numpy(), _unit(table["v"]) if table.num_rows else np.zeros((0, 1))
        total, group, made = np.zeros(len(nodes), np.int64), np.arange(len(nodes)), []
        rounds = [(np.nonzero(~visits)[0], np.arange(len(nodes)))] if within else [(np.nonzero((sides == 0) & ~visits)[0], np.nonzero(sides == 1)[0]), (np.nonzero((sides == 1) & ~visits)[0], np.nonzero((sides == 0) & visits)[0])]
        for members, queries in rounds:
            if not len(members) or not len(queries):
                continue
            for q, near in _near(shared.value.get(dim), place, x, members, queries, r, threshold):
                if within and not visits[q]:
                    near = near[near > q]  # members of one block meet once
                total[q] += copies[near].sum()
                total[near] += copies[q]
                tied, one = np.unique(group[near], return_index=True)
                for g, k in zip(tied.tolist(), one.tolist(), strict=True):
                    if g != group[q]:
                        made.append((int(nodes[q]), int(nodes[near[k]]), 0))
                if len(tied) and (len(tied) > 1 or tied[0] != group[q]):
                    group[np.isin(group, tied)] = group[q]
        found = np.nonzero(total)[0]
        made += zip(nodes[found].tolist(), [None] * len(found), total[found].tolist(), strict=True)
        return pa.table({n: pa.array([m[k] for m in made], pa.int64()) for k, n in enumerate(("node", "other", "n"))})

    return run


def _near(index: Index | None, place: int, x: np.ndarray, members: np.ndarray, queries: np.ndarray, r: float, threshold: float):
    """(query, members) of exact cosines of at least the threshold; without an index every member is compared."""
    mx = x[members]
    if index:
        codes, left = index.encode(mx - index.coarse[place])
        # An asymmetric distance is off by the length of what the member's codes leave out, at most.
        bound = ((r + left) ** 2 + 1e-4).astype(np.float32)
    step = max(1, min(CHUNK, CELLS // len(members)))
    for at in range(0, len(queries), step):
        some = queries[at : at + step]
        close = index.lookup(x[some] - index.coarse[place], codes) <= bound if index else x[some] @ mx.T >= threshold - 1e-9
        for i in np.nonzero(close.any(1))[0].tolist():
            q = int(some[i])
            near = close[i].nonzero()[0]
            near = near[(mx[near] * x[q]).sum(1) >= threshold]
            near = members[near]
            near = near[near != q]
            if len(near):
                yield q, near


def _indexes(nodes: DataFrame, threshold: float, lists: int | None) -> dict[int, Index]:
    """An index for each of the most frequent lengths; its lists grow with the length's largest label."""
    sizes = nodes.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("m"))
    common = sizes.groupBy("dim").agg(F.sum("m").alias("n"), F.max("m").alias("m")).where(F.col("n") >= (0 if lists else LEAST)).orderBy(F.desc("n"), "dim").limit(INDEXED).collect()
    out = {}
    for dim, n, m in [(x["dim"], x["n"], x["m"]) for x in common]:
        share = min(1.0, SAMPLE / n)
        picked = nodes.where(F.col("dim") == dim).where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).select("node", "v").limit(2 * SAMPLE)
        sample = picked.toArrow().sort_by("node")
        if sample.num_rows:
            out[dim] = Index(_unit(sample["v"]), lists or max(1, min(-(-m // LIST), sample.num_rows // PER_LIST)), threshold)
    return out


def near_duplicates(df: DataFrame, threshold: float = 0.93, lists: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component, kept) of every row."""
    kind = "array<float>" if dict(df.dtypes)[vec_col] == "array<float>" else "array<double>"
    v = F.col(vec_col).cast(kind)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    good = F.col(vec_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.when(good, v).alias("v"))
    # A node is a distinct vector of a label; two hashes, 128 bits, of both are its key, so all rows find it without their vectors.
    plain = F.transform("v", lambda x: x.cast("double") + F.lit(0.0))
    there = F.col("v").isNotNull()
    rows = rows.withColumn("a", F.when(there, F.xxhash64("label", plain))).withColumn("b", F.when(there, F.xxhash64(F.lit("b"), "label", plain)))
    firsts = rows.where(there).groupBy("a", "b").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = materialise(firsts.withColumn("dim", F.size("v")).withColumn("node", F.monotonically_increasing_id()), "pq-nodes")
    shared = df.sparkSession.sparkContext.broadcast(_indexes(nodes, threshold, lists))
    fields = f"dim int, label string, node long, copies long, v {kind}, list int, visits boolean"
    placed = materialise(nodes.select("dim", "label", "node", "copies", "v").mapInArrow(tidy(_places(shared)), fields), "pq-places")
    most = F.least(F.lit(BLOCK), F.greatest(F.lit(64), F.floor(F.lit(WIDTH) / F.col("dim"))))
    sizes = placed.groupBy("dim", "label", "list").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("dim", "label", "list", F.ceil(F.col("m") / most).cast("int").alias("b"))
    dealt = placed.join(sizes, ["dim", "label", "list"]).withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), F.col("b")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    split = dealt.select("dim", "label", "list", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).cast("int").alias("side"), "visits", "node", "copies", "v")
    # Dealt anew: else the join's partitioning by list, which also satisfies the grouping, would keep a hot list together.
    split = split.repartition("dim", "label", "list", "i", "j")
    found = materialise(split.groupBy("dim", "label", "list", "i", "j").applyInArrow(_links(shared, threshold), "node long, other long, n long"), "pq-links")
    release(placed)
    counts = found.groupBy("node").agg(F.sum("n").alias("links"))
    labels = components(found.where("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v")), "pq-cc")
    grouped = nodes.select("node", "a", "b", "first", "copies").join(labels.select("node", F.col("label").alias("cc")), "node", "left").withColumn("cc", F.coalesce("cc", "node"))
    least = grouped.groupBy("cc").agg(F.min("first").alias("component"))
    facts = materialise(grouped.join(least, "cc").join(counts, "node", "left").select("a", "b", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"), "pq-facts")
    release(nodes, found, labels)
    shared.destroy()
    out = rows.select("id", "a", "b").join(facts, ["a", "b"], "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def op7_query(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of all embeddings."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")
