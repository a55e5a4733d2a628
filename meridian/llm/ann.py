"""Nearest neighbours with a vantage-point tree per shard.

Vectors are dealt to shards of bounded size by a hash of their id; a task meets a shard's vectors first and builds its
tree, then streams the queries through it in blocks. Every query visits every shard, and the shards' answers are
merged by a top-k per query. Largest inner product becomes least distance by one added coordinate,
sqrt(M^2 - |x|^2) with M the largest norm (0 for queries), so that the triangle inequality may prune. A subtree is left
out if ``factor`` times its least possible distance exceeds the k-th best found: factor 1 gives exact search, more
visits less. Scores are summed in double precision on the original vectors, component by component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Production value: recall against brute force on the test tables is in the README.
FACTOR = 4.0
LEAF = 512


class _Node:
    __slots__ = ("rows", "vantage", "children")

    def __init__(self, rows=None, vantage=None, children=None):
        self.rows, self.vantage, self.children = rows, vantage, children


class VPTree:
    """Over the rows of ``vectors``; ``bound`` is at least the largest norm of all shards' vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bound: float, leaf: int = LEAF, seed: int = 1):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], np.ascontiguousarray(vectors[order], dtype=np.float64)
        norm = np.einsum("ij,ij->i", self.x, self.x)
        self.aug = np.column_stack((self.x, np.sqrt(np.maximum(bound * bound - norm, 0))))
        self.bound, self.leaf = bound, leaf
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(self.x)))

    def _build(self, rows: np.ndarray) -> _Node:
        if len(rows) <= self.leaf:
            return _Node(rows=rows)
        # Of a few random points, the one whose distances spread most.
        trial = self.rng.choice(rows, size=min(5, len(rows)), replace=False)
        probe = self.rng.choice(rows, size=min(100, len(rows)), replace=False)
        spread = [np.linalg.norm(self.aug[probe] - self.aug[t], axis=1).var() for t in trial]
        v = int(trial[int(np.argmax(spread))])
        d = np.linalg.norm(self.aug[rows] - self.aug[v], axis=1)
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        children = []
        for part in (order[:half], order[half:]):
            children.append((float(d[part].min()), float(d[part].max()), self._build(rows[part])))
        return _Node(vantage=v, children=children)

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, vector id, score), at most k of each query, without vectors of the query's own id."""
        self._q = np.ascontiguousarray(queries, dtype=np.float64)
        m = len(self._q)
        self._qid, self._k, self._factor = qids, k, factor
        self._score, self._vec = np.full((m, k), -np.inf), np.full((m, k), np.iinfo(np.int64).max)
        self._square = np.einsum("ij,ij->i", self._q, self._q) + self.bound**2
        self._qaug = np.column_stack((self._q, np.zeros(m)))
        self.visited = 0
        if len(self.x) and m:
            self._visit(self.root, np.arange(m))
        at, rank = np.nonzero(self._score > -np.inf)
        return qids[at], self._vec[at, rank], self._score[at, rank]

    def _reach(self, at: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far; infinite while there are fewer."""
        worst = self._score[at, -1]
        return np.where(np.isinf(worst), np.inf, np.sqrt(np.maximum(self._square[at] - 2 * np.where(np.isinf(worst), 0, worst), 0)))

    def _visit(self, node: _Node, at: np.ndarray) -> None:
        if node.rows is not None:
            self._leaf(node.rows, at)
            return
        d = np.linalg.norm(self._qaug[at] - self.aug[node.vantage], axis=1)
        least = [np.maximum(np.maximum(lo - d, d - hi), 0) for lo, hi, _ in node.children]
        near = (least[1] < least[0]).astype(int)
        for turn in (0, 1):
            for c in (0, 1):
                mine = np.flatnonzero((near if turn == 0 else 1 - near) == c)
                if len(mine):
                    reach = self._reach(at[mine])
                    mine = mine[~(least[c][mine] * self._factor > reach * (1 + 1e-9) + 1e-9)]
                    if len(mine):
                        self._visit(node.children[c][2], at[mine])

    def _leaf(self, rows: np.ndarray, at: np.ndarray) -> None:
        self.visited += len(rows) * len(at)
        rough = self._q[at] @ self.x[rows].T  # only rules out; what may count is summed in one order
        worst = self._score[at, -1]
        margin = 1e-9 * (1 + np.sqrt(self._square[at]) * self.bound)
        if len(rows) > self._k + 1:  # the leaf's own k-th best bounds what it can add; one more, as a row may be the query's own
            none = np.flatnonzero(np.isinf(worst))
            worst[none] = np.partition(rough[none], -self._k - 1, axis=1)[:, -self._k - 1]
        qi, xi = np.nonzero(rough >= (worst - margin)[:, None])
        qi, xi = at[qi], rows[xi]
        other = self._qid[qi] != self.ids[xi]
        qi, xi = qi[other], xi[other]
        if not len(qi):
            return
        score = np.cumsum(self._q[qi] * self.x[xi], axis=1)[:, -1]
        had = np.unique(qi)
        q = np.concatenate((np.repeat(had, self._k), qi))
        s = np.concatenate((self._score[had].ravel(), score))
        v = np.concatenate((self._vec[had].ravel(), self.ids[xi]))
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self._k
        self._score[q[keep], rank[keep]] = s[keep]
        self._vec[q[keep], rank[keep]] = v[keep]


def _search_shards(bounds: dict[int, float], k: int, factor: float):
    """``bounds``: length of vectors to the largest norm among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, tree = None, [], [], None
        for batch in batches:
            d, s, kind, i = (np.asarray(batch.column(c)) for c in range(4))
            lists = batch.column(4)
            flat, first = np.asarray(lists.flatten()), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (kind[1:] != kind[:-1])))
            for a, z in zip(cut, np.append(cut[1:], len(s)), strict=True):
                if (d[a], s[a]) != now:
                    now, ids, vectors, tree = (d[a], s[a]), [], [], None
                x = flat[first[a] : first[z]].reshape(z - a, int(d[a]))
                if kind[a] == 0:
                    ids.append(i[a:z])
                    vectors.append(x)
                elif ids:
                    tree = tree or VPTree(np.concatenate(ids), np.concatenate(vectors), bounds[int(d[a])])
                    for lo in range(0, len(x), 1024):
                        q, v, score = tree.search(i[a + lo : min(a + lo + 1024, z)], x[lo : lo + 1024], k, factor)
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, factor: float = FACTOR, shard_rows: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by ``every`` the ``k`` others of largest inner
    product that the search finds, ties to the smaller id.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows without id.
    Vectors of different lengths have no inner product: each is searched among those of its own length. Rows with the
    query's own id are never its neighbours; other repeated rows count each. An empty table gives no rows."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    ok = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.coalesce(ok, F.lit(False))).withColumn("dims", F.size("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    # One row for each length of vectors.
    found = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("m")).collect()
    bounds = {r["dims"]: float(np.sqrt(r["m"])) * (1 + 1e-12) for r in found}
    plan = spark.createDataFrame([(r["dims"], -(-r["n"] // shard_rows)) for r in found], "dims int, shards int")
    rows = rows.join(F.broadcast(plan), "dims")
    stored = rows.select("dims", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "v")
    asked = rows.filter(F.col("id") % every == 0).select("dims", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("kind"), "id", "v")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    met = stored.unionByName(asked).repartition(parts, "dims", "shard").sortWithinPartitions("dims", "shard", "kind", "id")
    hits = met.mapInArrow(_search_shards(bounds, k, factor), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
