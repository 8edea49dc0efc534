"""Connected components of a large graph, in a few rounds of joins.

Alternates two steps until nothing changes: every node tells its larger neighbours
about the smallest node it knows, then its smaller ones. Each round is written to
the shared folder. A node with very many neighbours is no hot task: minima are
combined before they are shuffled, and the joins go by a key of their own, so
adaptive execution may split them.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.runtime import durable


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each edge (x, y) with the least node ``m`` of x."""
    left = edges.withColumn("_k", F.bitwise_not("x"))
    right = least.select(F.bitwise_not("x").alias("_k"), "m")
    return left.join(right, "_k").drop("_k")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): the component is its smallest node."""
    now = durable(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(),
        "edges",
    )
    before = None
    while True:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = durable(
            _with_least(both, least).filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct(),
            "edges",
        )
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = _with_least(large, least).filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        now = durable(small.unionByName(least.select("x", F.col("m").alias("y"))).distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(
        now.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct()
    )


class Forest:
    """Union-find over 0..n-1; ``edges`` are the unions that joined something."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, pairs: Iterable[tuple[int, int]]) -> None:
        for a, b in pairs:
            x, y = self.root(a), self.root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.edges.append((a, b))


def spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a square matrix of links: at most n - 1 edges."""
    forest = Forest(len(links))
    a, b = np.nonzero(np.triu(links | links.T, 1))
    if len(a) > 4 * len(links):  # hubs first, so most pairs need not be looked at
        hub = np.argsort(-links.sum(axis=1), kind="stable")[:8]
        for h in hub.tolist():
            forest.join((h, j) for j in np.flatnonzero(links[h] | links[:, h]).tolist() if j != h)
        roots = np.array([forest.root(i) for i in range(len(links))])
        differ = roots[a] != roots[b]
        a, b = a[differ], b[differ]
    forest.join(zip(a.tolist(), b.tolist(), strict=True))
    return forest.edges


class Joined:
    """Union-find over any numbers; ``take`` gives and forgets the unions that joined something."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(i, i)) != i:
            parent[i] = i = parent[up]
        return i

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.edges.append((a, b))

    def take(self) -> list[tuple[int, int]]:
        out, self.edges = self.edges, []
        return out
