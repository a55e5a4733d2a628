"""Hard negatives by angular triangle filtering.

Every vector is stored with its length and its angles to a few reference directions. For an anchor at angles a and a
vector at angles x, the angle between the two lies between max |a - x| and min(a + x, 2 pi - a - x) over the
references, as angles obey the triangle inequality; its cosine times both lengths bounds the inner product. Bounds are
taken outward by more than rounding can add, then to whole numbers. A shard's vectors are ordered by direction and
cut into groups, so most of what cannot count is left out group by group, the rest vector by vector. Only pairs
whose bounds overlap a window of wanted scores, raised to the last of the best found so far, get their integer score.

There are two searches: the anchor's positives among the shards of its own label, then, with a window for each
positive, its negatives among all shards. Every anchor visits every shard (a stated query set against all rows, in
blocks), so work grows with anchors x vectors; memory does not, since shards and blocks are bounded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, materialize

REFERENCES, SAMPLE, SHARD_ROWS, BLOCK, GROUP = 12, 2048, 8192, 256, 128
#: Radians that rounding may add to an angle, far more than it does.
SLACK = 1e-6
#: Up to this product of lengths, sums of products of integers are exact in double precision.
EXACT = 2.0**53
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def references(dims: int, sample: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors: directions of the sample far from one another, filled up by drawn ones."""
    length = np.linalg.norm(sample, axis=1) if len(sample) else np.zeros(0)
    unit = sample[length > 0] / length[length > 0, None]
    out: list[np.ndarray] = []
    if len(unit):
        out.append(unit[0])
        near = unit @ unit[0]
        while len(out) < min(count, len(unit)) and near.min() < 1 - 1e-9:
            out.append(unit[int(np.argmin(near))])
            near = np.maximum(near, unit @ out[-1])
    drawn = np.random.default_rng(dims).normal(size=(count - len(out), dims))
    out.extend(drawn / np.maximum(np.linalg.norm(drawn, axis=1, keepdims=True), 1e-300))
    return np.array(out).reshape(count, dims)


def angles(vectors: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the rows, and their angles to the references (0 for a zero vector, whose bounds are 0 anyway)."""
    largest = np.abs(vectors).max(axis=1, initial=0.0)
    scaled = vectors / np.where(largest > 0, largest, 1.0)[:, None]
    length = np.linalg.norm(scaled, axis=1)
    cosine = np.clip(scaled @ refs.T / np.where(length > 0, length, 1.0)[:, None], -1, 1)
    return length * largest, np.where(length[:, None] > 0, np.arccos(cosine), 0.0)


def cosine_interval(least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of angles from ``least`` to ``most``, outward."""
    return np.cos(np.clip(most + SLACK, 0, np.pi)), np.cos(np.clip(least - SLACK, 0, np.pi))


class Shard:
    """Vectors in groups of like direction."""

    def __init__(self, ids, labels, vectors, length, angle):
        order = np.lexsort((ids, *angle.T[::-1], np.argmin(angle, axis=1))) if len(ids) else np.zeros(0, dtype=np.int64)
        self.ids, self.labels, self.x, self.length, self.angle = ids[order], labels[order], vectors[order], length[order], angle[order]
        self.first = np.arange(0, len(ids), GROUP)
        if len(ids):
            self.low, self.high = np.minimum.reduceat(self.angle, self.first), np.maximum.reduceat(self.angle, self.first)
            self.short, self.long = np.minimum.reduceat(self.length, self.first), np.maximum.reduceat(self.length, self.first)
        self.scored = self.pairs = 0

    def _group_bounds(self, length, angle) -> tuple[np.ndarray, np.ndarray]:
        """Of the scores of every anchor with every group."""
        least = np.zeros((len(length), len(self.first)))
        least, most = least, least + np.pi
        for r in range(angle.shape[1]):
            a, lo, hi = angle[:, r, None], self.low[None, :, r], self.high[None, :, r]
            np.maximum(least, np.maximum(a - hi, lo - a), out=least)
            np.minimum(most, np.minimum(a + hi, 2 * np.pi - a - lo), out=most)
        low, high = cosine_interval(least, most)
        return length[:, None] * np.where(low > 0, self.short, self.long) * low, length[:, None] * np.where(high > 0, self.long, self.short) * high

    def _bounds(self, part: slice, length, angle) -> tuple[np.ndarray, np.ndarray]:
        least = np.zeros((len(length), len(self.ids[part])))
        most = least + np.pi
        for r in range(angle.shape[1]):
            a, x = angle[:, r, None], self.angle[None, part, r]
            np.maximum(least, np.abs(a - x), out=least)
            total = a + x
            np.minimum(most, np.minimum(total, 2 * np.pi - total), out=most)
        low, high = cosine_interval(least, most)
        both = length[:, None] * self.length[None, part]
        return both * low, both * high

    def search(self, ids, labels, vectors, length, angle, low, high, k: int, same_label: bool) -> list[tuple[int, int, int, int]]:
        """(row of the anchor, row of the window, vector id, score): for each anchor and window [low, high] the ``k``
        best scores within, ties to smaller ids. Partners are rows with the anchor's label but another id, or rows
        with another label."""
        m, windows = low.shape
        best_score = np.full((m, windows, k), None, dtype=object)
        best_id = np.full((m, windows, k), np.iinfo(np.int64).max)
        count = np.zeros((m, windows), dtype=np.int64)
        floor = low.copy()  # raised to the k-th best
        if not (len(self.ids) and m):
            return []
        slack = 1 + 1e-9 * length.max() * self.length.max()
        group_low, group_high = self._group_bounds(length, angle)
        for g in np.argsort(-group_high.max(axis=0), kind="stable").tolist():
            part = slice(self.first[g], min(self.first[g] + GROUP, len(self.ids)))
            meets = ((group_high[:, g, None] + slack >= floor) & (group_low[:, g, None] - slack <= high)).any(axis=1)
            at = np.flatnonzero(meets)
            self.pairs += m * (part.stop - part.start)
            if not len(at):
                continue
            lower, upper = self._bounds(part, length[at], angle[at])
            want = np.zeros(lower.shape, dtype=bool)
            for w in range(windows):
                want |= (np.floor(lower - slack) <= high[at, w, None]) & (np.ceil(upper + slack) >= floor[at, w, None])
            same = labels[at, None] == self.labels[None, part]
            want &= (same & (ids[at, None] != self.ids[None, part])) if same_label else ~same
            self.scored += int(want.sum())
            exact = length[at, None] * self.length[None, part] < EXACT / 2
            score = np.zeros(want.shape, dtype=np.float64)
            rows, cols = np.flatnonzero(want.any(axis=1)), np.flatnonzero(want.any(axis=0))
            if not len(rows):
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                score[np.ix_(rows, cols)] = vectors[at[rows]] @ self.x[part][cols].T
            if not exact[want].all():  # beyond double precision: sums of Python integers
                score = score.astype(object)
                for i, j in zip(*np.nonzero(want & ~exact), strict=True):
                    score[i, j] = sum(int(a) * int(b) for a, b in zip(vectors[at[i]].tolist(), self.x[part.start + j].tolist(), strict=True))
            for w in range(windows):
                i, j = np.nonzero(want & (score >= floor[at, w, None]) & (score <= high[at, w, None]))
                if not len(i):
                    continue
                self._keep(best_score, best_id, count, floor, at[i], w, score[i, j], self.ids[part][j], k)
        out = []
        for i, w in zip(*np.nonzero(count), strict=True):
            n = count[i, w]
            out += [(int(i), int(w), int(v), int(s)) for v, s in zip(best_id[i, w, :n].tolist(), best_score[i, w, :n].tolist(), strict=True)]
        return out

    @staticmethod
    def _keep(best_score, best_id, count, floor, anchor, w, score, ids, k) -> None:
        order = np.lexsort((ids, -score, anchor))
        anchor, score, ids = anchor[order], score[order], ids[order]
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(anchor)], strict=True):
            i, n = anchor[a], count[anchor[a], w]
            z = min(z, a + k)
            got = sorted([*zip(best_score[i, w, :n].tolist(), best_id[i, w, :n].tolist(), strict=True), *zip(score[a:z].tolist(), ids[a:z].tolist(), strict=True)], key=lambda p: (-p[0], p[1]))[:k]
            n = count[i, w] = len(got)
            best_score[i, w, :n], best_id[i, w, :n] = [int(s) for s, _ in got], [v for _, v in got]
            if n == k:
                floor[i, w] = max(int(floor[i, w]), min(int(got[-1][0]), LONG_MAX))


def _index(refs: dict[int, np.ndarray], scale: float):
    """Integer vectors, lengths and angles; ``slot`` numbers the rows of a task, to deal repeated ids apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = dict(refs)
        slot = 0
        for batch in batches:
            lists = batch.column(2)
            flat, offsets = np.asarray(lists.flatten(), dtype=np.float64), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            with np.errstate(over="ignore"):
                flat = np.floor(scale * flat)
            sizes = np.diff(offsets)
            length, angle, ok = np.zeros(len(sizes)), np.zeros((len(sizes), REFERENCES)), np.ones(len(sizes), dtype=bool)
            for d in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == d)
                x = flat[(offsets[mine, None] + np.arange(d)[None]).ravel()].reshape(len(mine), d)
                ok[mine] = np.isfinite(x).all(axis=1)
                if d not in drawn:
                    drawn[d] = references(d, np.zeros((0, d)))
                length[mine], angle[mine] = angles(np.where(ok[mine, None], x, 0.0), drawn[d])
            rows = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.arange(slot, slot + len(sizes))), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)),
                 pa.array(length), pa.FixedSizeListArray.from_arrays(pa.array(angle.ravel()), REFERENCES).cast(pa.list_(pa.float64()))],
                ["id", "label", "slot", "dims", "q", "norm", "angles"],
            )
            slot += len(sizes)
            yield rows.filter(pa.array(ok))

    return run


def _matrix(column, rows: int) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def _search(k: int, same_label: bool):
    """Of groups (dims, shard), the vectors come first (kind 0), then the anchors with their windows (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            d, s, kind = (np.asarray(batch.column(c)) for c in ("dims", "shard", "kind"))
            change = (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (kind[1:] != kind[:-1])
            cut = np.flatnonzero(np.append(True, change)) if len(d) else np.zeros(0, dtype=np.int64)
            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(d)], strict=True):
                if (d[a], s[a]) != now:
                    now, held, shard = (d[a], s[a]), [], None
                for lo in range(a, z, BLOCK):
                    part = batch.slice(lo, min(BLOCK, z - lo))
                    n = part.num_rows
                    rows = (*(np.asarray(part.column(c)) for c in ("id", "label")), _matrix(part.column("q"), n), np.asarray(part.column("norm")), _matrix(part.column("angles"), n))
                    if kind[lo] == 0:
                        held.append(rows)
                        continue
                    if not held:
                        continue
                    shard = shard or Shard(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    floors, tops = part.column("floors").to_pylist(), part.column("tops").to_pylist()
                    width = max(map(len, floors))
                    low, high = (np.array([w + [empty] * (width - len(w)) for w in ws], dtype=np.int64) for ws, empty in ((floors, LONG_MAX), (tops, LONG_MIN)))
                    hits = shard.search(*rows, low, high, k, same_label)
                    keys = np.asarray(part.column("akey"))
                    cols = list(zip(*hits, strict=True)) or [()] * 4
                    at = np.array(cols[0], dtype=np.int64)
                    clipped = [min(max(x, LONG_MIN), LONG_MAX) for x in cols[3]]
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0][at], pa.int64()), pa.array(keys[at], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(clipped, pa.int64())], ["anchor_id", "akey", "win", "vec_id", "score"])

    return run


HITS = "anchor_id long, akey long, win int, vec_id long, score long"
SIDE = ["dims", "shard", "kind", "id", "akey", "label", "q", "norm", "angles", "floors", "tops"]


def _met(stored: DataFrame, asked: DataFrame, k: int, same_label: bool) -> DataFrame:
    none = F.array().cast("array<long>")
    stored = stored.withColumns({"kind": F.lit(0), "akey": F.lit(0).cast("long"), "floors": none, "tops": none}).select(*SIDE)
    asked = asked.withColumn("kind", F.lit(1)).select(*SIDE)
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = stored.unionByName(asked).repartition(parts, "dims", "shard").sortWithinPartitions("dims", "shard", "kind", "id")
    hits = met.mapInArrow(_search(k, same_label), HITS)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "akey", "win").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def index(vectors: DataFrame, relabel_every: int = 7, classes: int = 10, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The stored vectors (id, label, slot, dims, q, norm, angles), written to the shared folder. References come from
    at most SAMPLE rows, the first by a hash; they decide what is left out early, never a result."""
    spark = vectors.sparkSession
    v, key = F.col(vector_col).cast("array<double>"), F.col(id_col).cast("long")
    label = F.col(label_col).cast("long")
    label = F.when(key % relabel_every == 0, (label + 1) % classes).otherwise(label)
    rows = vectors.select(key.alias("id"), label.alias("label"), v.alias("v")).filter("id is not null and label is not null and v is not null")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sample = rows.select("v").orderBy(F.xxhash64("id", "v")).limit(SAMPLE).toPandas()["v"].tolist()
    refs = {d: references(d, np.array([x for x in sample if len(x) == d], dtype=np.float64)) for d in {len(x) for x in sample}}
    schema = "id long, label long, slot long, dims int, q array<double>, norm double, angles array<double>"
    return materialize(rows.mapInArrow(_index(refs, scale), schema), "angular-index")


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, shard_rows: int = SHARD_ROWS, **columns) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, all long but rank: for every row whose
    id is divisible by ``every`` and each of its ``positives`` first rows of its label with another id, the first
    ``negatives`` rows of other labels whose score is from ``low`` to ``high`` percent of the positive's.

    Rows with a null id, label or vector, with null or non-finite components, or whose scaled components are not
    finite take no part. Vectors are compared with those of their own length; empty ones score 0. Repeated rows are
    partners each; anchors that agree in everything are one, others that share an id are answered each. A positive
    score of 0 is met by negatives of score 0, a negative one by none. Scores beyond the range of a long are given as
    its ends. An empty table gives no rows; other columns are not read."""
    rows = index(vectors, **columns)
    spark = vectors.sparkSession
    akey = F.xxhash64("id", "label", "q")
    anchors = rows.filter(F.col("id") % every == 0).dropDuplicates(["id", "label", "q"]).withColumn("akey", akey).drop("slot")
    share = F.pmod(F.xxhash64("id", "slot"), F.col("shards"))

    # Positives: shards by length and label, as many as the label needs.
    grouped = rows.withColumn("grp", F.concat_ws("/", "dims", "label"))
    sizes = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    total = int(rows.count())
    sizes = sizes.withColumn("shards", F.ceil(F.col("n") / shard_rows))
    stored = join_groups(grouped, sizes, "grp", "n", total).withColumn("shard", F.concat_ws("/", "grp", share))
    open_ended = {"floors": F.array(F.lit(LONG_MIN)), "tops": F.array(F.lit(LONG_MAX))}
    asked = join_groups(anchors.withColumn("grp", F.concat_ws("/", "dims", "label")), sizes, "grp", "n", total)
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).withColumn("shard", F.concat_ws("/", "grp", "part")).withColumns(open_ended)
    found = _met(stored, asked, positives, True).select("anchor_id", "akey", (F.col("rank") - 1).alias("win"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = materialize(found, "positives")

    # Negatives: shards of all labels, a window for each positive. Bounds are whole numbers, exact as decimals.
    exact = F.col("positive_score").cast("decimal(38,0)")
    windows = found.withColumns({"floor": F.ceil(exact * low / 100), "top": F.floor(exact * high / 100)})
    windows = windows.groupBy("anchor_id", "akey").agg(F.sort_array(F.collect_list(F.struct("win", "floor", "top"))).alias("w"))
    windows = windows.select("anchor_id", "akey", *(F.transform(f"w.{c}", lambda x: x.cast("long")).alias(f"{c}s") for c in ("floor", "top")))
    anchors = anchors.join(windows, (F.col("id") == F.col("anchor_id")) & (anchors["akey"] == windows["akey"])).drop(windows["akey"], windows["anchor_id"])
    # One row for each length of vectors.
    plan = spark.createDataFrame([(r["dims"], -(-r["n"] // shard_rows)) for r in rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()], "dims int, shards long")
    stored = rows.join(F.broadcast(plan), "dims").withColumn("shard", share.cast("string"))
    asked = anchors.join(F.broadcast(plan), "dims").withColumn("shard", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1), lambda x: x.cast("string"))))
    hits = _met(stored, asked, negatives, False)
    out = hits.join(found, ["anchor_id", "akey", "win"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
