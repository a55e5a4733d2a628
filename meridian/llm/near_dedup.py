"""MinHash near-deduplication with an LSH forest.

1. One pass over the texts gives each document the size of its shingle set, a digest of that set and a MinHash
   signature. Documents with equal sets form a class; from here on a class is one node, so copies cost nothing.
2. Every tree of the forest orders the classes by its own piece of the signature. Classes that follow one another in an
   order are candidates if their longest common prefix reaches the depth of their region. A region of at most
   ``region`` classes is taken at the depth ``min_depth``; where more classes share a prefix the region is split one
   value deeper, down to ``max_depth``. The order is range-partitioned on (tree, key, class), so no region is a group of
   one task; pairs over a partition's border are found from the border rows.
3. Components of the candidate graph gather what may be linked: a region is a chain of candidates, so all of it is in
   one component, whatever its size. The texts of their classes, and of no others, are brought together block by
   block, a block holding one component or a bounded part of a large one. In a block, all pairs with like signatures
   are confirmed on full sets, but for pairs that are linked already.
4. Where a component was cut into blocks, every two blocks of it are compared, all pairs with like signatures that are
   not linked, so a component is compared in full whatever its size; one task holds one block and streams the other."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, keep_ids, likely_in, materialize, release_memory
from .components import UnionFind, connected_components


@dataclass(frozen=True)
class Forest:
    words: int = 5
    percent: int = 80
    trees: int = 16
    depth: int = 8
    min_depth: int = 3
    max_depth: int = 4
    region: int = 8
    block_classes: int = 1000
    block_shingles: int = 4_000_000
    seed: int = 10

    @property
    def hashes(self) -> int:
        return self.trees * self.depth


class _WordHash(dict):
    """Hash of each word seen; emptied when full, which only costs time, and after a task, since its worker stays."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASH = _WordHash()
_M = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles. Words are runs outside [\\x20\\x09-\\x0D], A-Z in lower
    case. With fewer words than a shingle has, the whole sequence is the only one; without words there is none."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    seq = text.encode("utf-8", "surrogatepass").lower().split()
    if not seq:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_HASH.__getitem__, seq), dtype=np.uint64, count=len(seq))
    k = min(words, len(w))
    n = len(w) - k + 1
    h = np.full(n, k + 1, dtype=np.uint64)
    for j in range(k):
        h ^= w[j : j + n]
        h *= _M
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def _coefficients(f: Forest) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(f.seed)
    a = rng.integers(0, 2**32, f.hashes, dtype=np.uint32) | np.uint32(1)
    return a, rng.integers(0, 2**32, f.hashes, dtype=np.uint32)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), 2048):
        y = np.multiply.outer(a, x[k : k + 2048])
        y += b[:, None]
        np.minimum(out, y.min(axis=1), out=out)
    return out


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def sign(docs: DataFrame, f: Forest) -> DataFrame:
    """doc_id, n_shingles, cls (hex digest of the set; null without shingles or id), sig, and crc, a hash of the text that
    tells the rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(f)
        for batch in batches:
            n, cls, sig = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(text.as_py(), f.words)
                n.append(len(s))
                known = len(s) and doc_id is not None
                cls.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if known else None)
                sig.append(signature(s, a, b).astype(">u4").tobytes() if known else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.string()), pa.array(sig, pa.binary()), batch.column(2)], ["doc_id", "n_shingles", "cls", "sig", "crc"])
        _HASH.clear()
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, n_shingles long, cls string, sig binary, crc long")


def _pairs(tree: np.ndarray, key: np.ndarray, rep: np.ndarray, f: Forest, new: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order, the candidates among neighbours whose later row is at or after position ``new``. A region that
    goes on beyond the rows given counts as smaller than it is, which only adds candidates."""
    if len(rep) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    common = np.where(tree[1:] == tree[:-1], (key[1:] == key[:-1]).cumprod(axis=1).sum(axis=1), 0)
    ok = common >= f.max_depth
    for depth in range(f.min_depth, f.max_depth):
        region = np.cumsum(np.append(True, common < depth)) - 1
        ok |= (common >= depth) & (np.bincount(region)[region[1:]] <= f.region)
    at = np.flatnonzero(ok)
    at = at[at + 1 >= new]
    return rep[at], rep[at + 1]


NEIGHBOURS = "a long, b long, border int, tree int, key binary, rep long"


def neighbours(f: Forest):
    def table(a, b, border=None, tree=None, key=None, rep=None) -> pa.RecordBatch:
        n = len(a) if a is not None else len(rep)
        col = lambda v, t: pa.nulls(n, t) if v is None else pa.array(v, t)
        return pa.RecordBatch.from_arrays([col(a, pa.int64()), col(b, pa.int64()), col(border, pa.int32()), col(tree, pa.int32()), col(key, pa.binary()), col(rep, pa.int64())], ["a", "b", "border", "tree", "key", "rep"])

    def edge_rows(pid: int, tree, key, rep) -> pa.RecordBatch:
        return table(None, None, [pid] * len(rep), tree.tolist(), [k.astype(">u4").tobytes() for k in key], rep.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, w = TaskContext.get().partitionId(), f.region + 1
        tree, key, rep = np.zeros(0, np.int32), np.zeros((0, f.depth), np.uint32), np.zeros(0, np.int64)
        head = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t = np.asarray(batch.column(0)).astype(np.int32)
            k = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, f.depth).astype(np.uint32)
            r = np.asarray(batch.column(2))
            if head < w:
                yield edge_rows(pid, t[: w - head], k[: w - head], r[: w - head])
                head += min(len(r), w - head)
            old = len(rep)
            tree, key, rep = np.concatenate((tree, t)), np.concatenate((key, k)), np.concatenate((rep, r))
            a, b = _pairs(tree, key, rep, f, old)
            if len(a):
                yield table(np.minimum(a, b), np.maximum(a, b))
            tree, key, rep = tree[-w:], key[-w:], rep[-w:]
        if len(rep):
            yield edge_rows(pid + 1, tree, key, rep)

    return run


def candidates(classes: DataFrame, f: Forest, rows: int) -> DataFrame:
    """Distinct candidate pairs (a < b) of class representatives."""
    spark = classes.sparkSession
    width = 4 * f.depth
    trees = classes.select("rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(f.trees - 1))).alias("tree"))
    trees = trees.select("tree", F.expr(f"substring(sig, tree * {width} + 1, {width})").alias("key"), "rep")
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows * f.trees // 5_000))
    order = trees.repartitionByRange(parts, "tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")
    found = materialize(order.mapInArrow(neighbours(f), NEIGHBOURS), "forest")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tree", "key", "rep"]).drop_duplicates(["tree", "key", "rep"])
        key = np.frombuffer(b"".join(pdf["key"]), ">u4").reshape(-1, f.depth)
        a, b = _pairs(pdf["tree"].to_numpy(), key, pdf["rep"].to_numpy(), f, 0)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    borders = found.filter("border is not null").groupBy("border").applyInPandas(across, "a long, b long")
    return found.filter("border is null").select("a", "b").unionByName(borders).filter("a <> b").distinct()


def _link(sets: list[np.ndarray], f: Forest, a: np.ndarray, b: np.ndarray) -> UnionFind:
    """Link all similar pairs of a block. Signatures rule out pairs that are 0.3 or more below the threshold by
    their estimate, some nine standard errors; every link is confirmed on full sets."""
    found = UnionFind()
    sigs = np.stack([signature(s, a, b) for s in sets])
    size = np.array([len(s) for s in sets])
    least = f.percent / 100 - 0.3
    for i in range(len(sets) - 1):
        like = (sigs[i + 1 :] == sigs[i]).mean(axis=1)
        lo, hi = np.minimum(size[i + 1 :], size[i]), np.maximum(size[i + 1 :], size[i])
        at = np.flatnonzero((like >= least) & (100 * lo >= f.percent * hi))
        for j in (at[np.argsort(-like[at], kind="stable")] + i + 1).tolist():
            if found.find(i) != found.find(j) and similar(sets[i], sets[j], f.percent):
                found.union(i, j)
    return found


def _verify_blocks(f: Forest):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _coefficients(f)
        key, reps, names, sets = None, [], [], []

        def flush() -> pd.DataFrame:
            links = _link(sets, f, a, b) if sets else UnionFind()
            groups: dict[int, int] = {}
            for k, rep in enumerate(reps):
                groups[links.find(k)] = min(rep, groups.get(links.find(k), rep))
            return pd.DataFrame({"cls": names, "grp": np.array([groups[links.find(k)] for k in range(len(reps))], np.int64)})

        for pdf in batches:
            for comp, block, rep, cls, text in zip(pdf["component"].tolist(), pdf["block"].tolist(), pdf["rep"].tolist(), pdf["cls"], pdf["text"], strict=True):
                if (comp, block) != key:
                    if reps:
                        yield flush()
                    key, reps, names, sets = (comp, block), [], [], []
                s = shingles(text, f.words)
                # A repeated row is taken once; an id may stand for several classes.
                if (not names or names[-1] != cls) and xxhash.xxh3_128_hexdigest(s.tobytes()) == cls:
                    reps.append(rep)
                    names.append(cls)
                    sets.append(s)
        if reps:
            yield flush()
        _HASH.clear()
        release_memory()

    return run


class _Block:
    """One side of a comparison of two blocks."""

    def __init__(self, sets: list[np.ndarray], groups: list[int], f: Forest, a: np.ndarray, b: np.ndarray):
        self.sets, self.groups, self.f, self.a, self.b = sets, np.array(groups), f, a, b
        self.sigs = np.stack([signature(s, a, b) for s in sets])
        self.size = np.array([len(s) for s in sets])
        self.start = np.cumsum(self.size) - self.size
        self.values, self.at = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(self.values), dtype=bool)

    def similar_to(self, s: np.ndarray, group: int) -> np.ndarray:
        """Groups, but for ``group``, of the sets that are similar to ``s``: filtered as in _link, then on full sets."""
        like = (self.sigs == signature(s, self.a, self.b)).mean(axis=1)
        lo, hi = np.minimum(self.size, len(s)), np.maximum(self.size, len(s))
        at = np.flatnonzero((self.groups != group) & (like >= self.f.percent / 100 - 0.3) & (100 * lo >= self.f.percent * hi))
        if len(at) <= 16:
            return np.unique(self.groups[[k for k in at.tolist() if similar(self.sets[k], s, self.f.percent)]])
        known = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        known = known[self.values[known] == s]
        self.mark[known] = True
        both = np.add.reduceat(self.mark[self.at], self.start, dtype=np.int64)[at]
        self.mark[known] = False
        return np.unique(self.groups[at[100 * both >= self.f.percent * (self.size[at] + len(s) - both)]])


def _between_blocks(f: Forest):
    """Links (ga, gb) of groups over similar pairs, one of the block ``lo`` and one of ``hi``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _coefficients(f)
        key, sets, groups, held = None, [], [], None
        for pdf in batches:
            links = []
            for comp, lo, hi, block, cls, grp, text in zip(*(pdf[c].tolist() for c in ("component", "lo", "hi", "block", "cls", "grp", "text")), strict=True):
                if (comp, lo, hi) != key:
                    key, sets, groups, held, linked = (comp, lo, hi), [], [], None, UnionFind()
                s = shingles(text, f.words)
                if xxhash.xxh3_128_hexdigest(s.tobytes()) != cls:
                    continue
                if block == lo:
                    sets.append(s)
                    groups.append(grp)
                elif sets:
                    held = held or _Block(sets, groups, f, a, b)
                    for g in held.similar_to(s, linked.find(grp)).tolist():
                        if linked.find(g) != linked.find(grp):
                            linked.union(g, grp)
                            links.append((g, grp))
                            held.groups = np.array([linked.find(x) for x in held.groups.tolist()])
            yield pd.DataFrame(links, columns=["ga", "gb"], dtype="int64")
        _HASH.clear()
        release_memory()

    return run


def near_duplicates(docs: DataFrame, f: Forest = Forest()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links, the row's own included; kept says whether it is the
    row's own. A null or blank text, or one with a null id, is linked with nothing: n_shingles is that of its text,
    component_id its own id, kept true. Rows with one id are one document: they share a component, whatever their
    texts, and are all marked as their id is. An empty table gives no rows."""
    signed = materialize(sign(docs, f), "signatures")
    rows = signed.count()
    known = signed.filter("cls is not null")
    classes = known.groupBy("cls").agg(F.min(F.struct("doc_id", "crc")).alias("rep"), F.first("sig").alias("sig"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.select("cls", "rep.crc", F.col("rep.doc_id").alias("rep"), "sig", "n", "copies"), "classes")
    comp = materialize(connected_components(candidates(classes, f, rows)), "components")

    members = classes.join(comp, classes["rep"] == comp["node"]).select("rep", "crc", "cls", "n", "component")
    per = members.groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    blocks = F.ceil(F.greatest(F.col("k") / f.block_classes, F.col("s") / f.block_shingles)).cast("int")
    per = per.select("component", "k", F.greatest(blocks, F.lit(1)).alias("blocks"))
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block")
    members = join_groups(members, per, "component", "k", rows).select("rep", "crc", "cls", "component", "blocks", block)
    members = materialize(members, "members")

    texts = _texts_of(docs, members).select("component", "block", "rep", "cls", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = texts.repartition(parts, "component", "block").sortWithinPartitions("component", "block", "rep", "cls")
    groups = materialize(together.mapInPandas(_verify_blocks(f), "cls string, grp long"), "groups")

    cut = members.filter("blocks > 1")
    if not cut.isEmpty():
        groups = _compare_blocks(docs, cut, groups, f)

    # Rows of a class of their own that is linked with nothing keep their id; all others are told by their class.
    of_class = classes.join(groups, "cls", "left").select("cls", "copies", "grp", F.coalesce("grp", "rep").alias("component_id"))
    merged = _classes_of_one_id(known, of_class, rows)
    if merged is not None:
        of_class = of_class.join(merged, F.col("component_id") == F.col("node"), "left")
        of_class = of_class.select("cls", "copies", F.coalesce("component", "grp").alias("grp"), F.coalesce("component", "component_id").alias("component_id"))
    of_class = of_class.filter("copies > 1 or grp is not null").drop("grp")
    told = join_groups(known.select("doc_id", "n_shingles", "cls"), of_class, "cls", "copies", rows, "left")
    out = told.select("doc_id", "n_shingles", "component_id").unionByName(signed.filter("cls is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def _texts_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` with the text of each one's row; the hash of the text keeps other rows of its id apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__crc"), "text")
    return likely_in(rows, "__id", members, "rep").join(members, (F.col("__id") == F.col("rep")) & (F.col("__crc") == F.col("crc")))


def _classes_of_one_id(known: DataFrame, of_class: DataFrame, rows: int) -> DataFrame | None:
    """(node, component) of what ids with several texts join, over component_id; None where no id has several."""
    several = known.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a <> b").select(F.col("doc_id").alias("of"))
    several = materialize(several, "several")
    if several.isEmpty():
        return None
    told = likely_in(known.select(F.col("doc_id").alias("of"), "cls"), "of", several, "of").join(several, "of", "left_semi").distinct()
    told = materialize(told.join(of_class.select("cls", "component_id"), "cls").select("of", "component_id"), "several")
    low = told.groupBy("of").agg(F.min("component_id").alias("least"), F.count(F.lit(1)).alias("n"))
    return connected_components(join_groups(told, low, "of", "n", rows), "component_id", "least")


def _compare_blocks(docs: DataFrame, cut: DataFrame, groups: DataFrame, f: Forest) -> DataFrame:
    """``groups`` merged over all similar pairs between the blocks of cut components."""
    rows = cut.join(groups, "cls")
    apart = rows.groupBy("component").agg(F.min("grp").alias("g"), F.max("grp").alias("h")).filter("g <> h").select("component")
    rows = rows.join(apart, "component")
    texts = _texts_of(docs, rows).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("other <> block")  # a component's blocks, squared
    tasks = texts.select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "cls", "grp", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = tasks.repartition(parts, "component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "block", "rep")
    merged = connected_components(together.mapInPandas(_between_blocks(f), "ga long, gb long"), "ga", "gb")
    groups = groups.join(merged, F.col("grp") == F.col("node"), "left").select("cls", F.coalesce("component", "grp").alias("grp"))
    return materialize(groups, "groups")


def keep_one(docs: DataFrame, f: Forest = Forest()) -> DataFrame:
    """The rows, all their columns unchanged, that ``near_duplicates`` keeps; of repeated rows one. Rows without id stay."""
    kept = near_duplicates(docs, f).filter("kept")
    return keep_ids(docs, kept).unionByName(docs.filter("doc_id is null"))
