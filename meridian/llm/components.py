"""Connected components of a graph held as a table of edges: large-star and small-star steps until nothing changes.

Each step is a partial aggregation and a join on a node; the few nodes with very many neighbours are broadcast, so no
task gathers one's edges. Every round is written to the shared folder and replaces the one before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_groups, materialize


class UnionFind:
    """Over hashable nodes; the root of a set is its smallest node."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        p, root = self.parent, x
        while (up := p.get(root, root)) != root:
            root = up
        while x != root:
            p[x], x = root, p.get(x, x)
        return root

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            a, b = min(a, b), max(a, b)
            self.parent[b] = a


def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace the edges of a partition by stars with the same components."""
    sets = UnionFind()
    for pdf in batches:
        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            sets.union(a, b)
    nodes = list(sets.parent)
    for k in range(0, len(nodes), 10_000):
        part = nodes[k : k + 10_000]
        yield pd.DataFrame({"u": np.array(part, dtype=np.int64), "v": np.array([sets.find(x) for x in part], dtype=np.int64)})


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an edge between two nodes; component is the smallest node reachable."""
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = materialize(e.mapInPandas(contract, "u long, v long").filter("u <> v").distinct(), "edges")
    last = (e.count(), None)
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_groups(both.filter("v > u"), low, "u", "n", 2 * last[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        after = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(e)
        e = after
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
