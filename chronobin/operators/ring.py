"""Consistent-hash routing: a key goes to the next virtual node clockwise.

A ring is how many virtual nodes each node has; its points follow from that. Each of its arcs is
cut at the multiples of 2**20, so that rows meet arcs in one broadcast equi-join on the cell,
and only the arcs of a cell are compared.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 20


def hash32(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "big")


def hash_column(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


class Ring:
    """Nodes with virtual replicas, named node:0, node:1 and so on in lower case; of equal hashes the node that came later stands."""

    def __init__(self, nodes: list[str] | None = None, replicas: int = 5):
        self.counts: dict[str, int] = {}
        self.names: dict[str, str] = {}
        for n in nodes or []:
            self.add(n, replicas)

    def add(self, node: str, replicas: int) -> None:
        """More replicas of a node, new or there."""
        key = node.lower()
        self.names.setdefault(key, node)
        self.counts[key] = self.replicas(node) + replicas

    def remove(self, node: str) -> None:
        self.counts.pop(node.lower(), None)
        self.names.pop(node.lower(), None)

    def replicas(self, node: str) -> int:
        return self.counts.get(node.lower(), 0)

    @property
    def points(self) -> dict[int, str]:
        """Node by hash."""
        return {hash32(f"{key}:{i}"): self.names[key] for key, n in self.counts.items() for i in range(n)}

    def node(self, key: str) -> str | None:
        points = self.points
        if not points:
            return None
        order = sorted(points)
        return points[order[bisect_left(order, hash32(key)) % len(order)]]

    def arcs(self) -> list[tuple[int, int, int, str]]:
        """(cell, low, high, node): hashes of low..high, all of one cell, go to node."""
        points = self.points
        order = sorted(points)
        spans = [(order[i - 1] + 1 if i else 0, h, points[h]) for i, h in enumerate(order)]
        spans.append((order[-1] + 1, (1 << 32) - 1, points[order[0]]))
        return [(c, max(lo, c << CELL), min(hi, (c + 1 << CELL) - 1), n) for lo, hi, n in spans if lo <= hi for c in range(lo >> CELL, (hi >> CELL) + 1)]


#: Arcs up to which they are broadcast; a ring of more is joined by shuffling.
BROADCAST_ARCS = 500_000


def route(df: DataFrame, key: str, ring: Ring, into: str = "node") -> DataFrame:
    """df with the node of each key; null keys have none."""
    if not ring.counts:
        return df.withColumn(into, F.lit(None).cast("string"))
    rows = ring.arcs()
    arcs = df.sparkSession.createDataFrame(rows, f"_cell long, _low long, _high long, `{into}` string")
    arcs = F.broadcast(arcs) if len(rows) <= BROADCAST_ARCS else arcs
    keyed = df.withColumn("_h", hash_column(F.col(key).cast("string")))
    found = keyed.join(arcs, (F.shiftright("_h", CELL) == F.col("_cell")) & F.col("_h").between(F.col("_low"), F.col("_high")), "left")
    return found.drop("_h", "_cell", "_low", "_high")
