"""Lexical retrieval packing: sequences of at most ``window`` tokens filled with documents that share words.

One pass over the texts tokenizes each document and cuts it at every full window; full windows are sequences of their
own, and what remains is the document's tail. Only lengths, checksums and each document's bag of distinct tokens move
on. Documents are dealt to shards of bounded size by their words: a tree fitted on a sample
of sketches of the bags puts like documents together, and what is too many for a shard is dealt on by a hash. A shard has a BM25 inverted index over its
documents' bags; the longest tail left is the seed of a sequence, the index returns its unused neighbours, best first,
and those that fit fill the window. What no neighbour fills is filled by the longest tail that fits."""

from __future__ import annotations

import base64
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release_memory, unit_hash

#: White space as the vocabulary's pattern has it, which is Python's but for \\x1c-\\x1f.
_CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
SPECIAL = "<|endoftext|>"


class _Unsafe(Exception):
    """A text with blanks next to each other."""


class _Spaced(dict):
    """Ids of parts that follow one space; parts that are empty or have a blank at either end are no parts of that kind.
    A part is kept when it is met again, so that words of one text only take no room."""

    def __init__(self, encode, limit: int, bits: int = 22):
        super().__init__()
        self.encode, self.limit = encode, limit
        self.met, self.mask = bytearray(1 << bits), (1 << bits) - 1

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Unsafe
        out = self.encode(" " + part)
        at = hash(part) & self.mask
        if not self.met[at]:
            self.met[at] = 1
        elif len(self) < self.limit:
            self[part] = out
        return out


class Encoder(dict):
    """A text's ids as little-endian unsigned 32-bit bytes.

    The vocabulary's pattern never matches over the border between a character that is no white space and one that
    is, so a text may be cut there and the parts encoded apart: at single spaces where there are no other blanks around
    them, else by a pattern. Parts met early are kept, up to a bound; the others are encoded by a library that reads the
    same vocabulary as ranks. A text that spells the special token goes to the tokenizer whole."""

    LIMIT = 400_000

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        super().__init__()
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.json_path, self._whole = json_path, None
        self.spaced = _Spaced(self.part, self.LIMIT)

    def part(self, part: str) -> bytes:
        out = array("I", self.ranks(part))
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def __missing__(self, part: str) -> bytes:
        out = self.part(part)
        if len(self) < self.LIMIT:
            self[part] = out
        return out

    def whole(self, text: str) -> bytes:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.json_path)
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    @staticmethod
    def _unsafe() -> bytes:
        raise _Unsafe

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SPECIAL in text:
            return self.whole(text)
        if not (text[0].isspace() or text[-1].isspace()):
            first, *parts = text.split(" ")
            try:
                return (self[first] if first and not first[-1].isspace() else self._unsafe()) + b"".join(map(self.spaced.__getitem__, parts))
            except _Unsafe:
                pass
        return b"".join(map(self.__getitem__, _CHUNK.findall(text)))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(json_path: str, ranks_path: str, pattern: str) -> Encoder:
    """One for each Python worker."""
    key = (json_path, ranks_path, pattern)
    return _ENCODERS.setdefault(key, _ENCODERS.get(key) or Encoder(*key))


def forget_encoders() -> None:
    """A worker that tokenized has no use for its vocabulary and kept parts in the stages after."""
    _ENCODERS.clear()
    release_memory()


@dataclass(frozen=True)
class Packing:
    json_path: str
    ranks_path: str
    pattern: str
    window: int = 1024
    end_id: int = 0
    shard_docs: int = 4096
    shard_postings: int = 2_000_000
    query_terms: int | None = None
    k1: float = 1.2
    b: float = 0.75

    @classmethod
    def public(cls, **changes) -> Packing:
        import public_tokenizers as P

        return cls(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, **changes)


TOKENIZED = "doc_id long, tokens long, full array<long>, tail int, tail_crc long, bag binary"


def _bag(raw: bytes) -> bytes:
    """Distinct ids, then their counts."""
    ids = np.frombuffer(raw, "<u4")
    # 16-bit numbers are sorted by their digits.
    ids = np.sort(ids.astype(np.uint16), kind="stable") if ids.max(initial=0) < 1 << 16 else np.sort(ids)
    at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return np.concatenate((ids[at], np.diff(np.append(at, len(ids))))).astype("<u4").tobytes()


def tokenize(docs: DataFrame, p: Packing) -> DataFrame:
    """TOKENIZED of each row: its number of ids with the end id, crc32 of each full window, length and crc32 of the
    tail, and the bag: distinct ids and their counts, one array of 32-bit integers after the other."""
    end = np.array([p.end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, step = encoder(p.json_path, p.ranks_path, p.pattern), 4 * p.window
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for text in batch.column(1):
                raw = enc.ids(text.as_py()) + end
                cut = len(raw) // step * step
                for to, x in zip(rows, (len(raw) // 4, [zlib.crc32(raw[k : k + step]) for k in range(0, cut, step)], (len(raw) - cut) // 4, zlib.crc32(raw[cut:]), _bag(raw)), strict=True):
                    to.append(x)
            types = (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(rows, types, strict=True))], ["doc_id", "tokens", "full", "tail", "tail_crc", "bag"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TOKENIZED)


_SKETCH_TERMS, _SKETCH = 1 << 16, 48


def _directions() -> np.ndarray:
    return np.random.default_rng(9).normal(size=(_SKETCH_TERMS, _SKETCH)).astype(np.float32)


def sketch(bag: bytes, idf: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """A random projection, of length 1, of a bag's terms weighted by log-count and idf."""
    term, tf = np.frombuffer(bag, "<u4").reshape(2, -1)
    term = term % _SKETCH_TERMS
    v = (np.log1p(tf) * idf[term]).astype(np.float32) @ directions[term]
    return v / max(float(np.linalg.norm(v)), 1e-9)


class LexicalTree:
    """Cuts a sample of sketches in two again and again, each time between its two cluster centres, until there are
    ``leaves`` parts of about equal size."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.nodes: list[tuple[np.ndarray, float, int, int, int]] = []  # direction, limit, left, right; leaf number or -1
        self.leaves = 0
        self._grow(x, leaves)

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        me = len(self.nodes)
        self.nodes.append((np.zeros(_SKETCH, np.float32), 0.0, -1, -1, self.leaves))
        if leaves == 1 or len(x) < 2:
            self.leaves += 1
            return me
        d = np.linalg.eigh(np.cov(x.T))[1][:, -1] if len(x) > 2 else x[1] - x[0]
        for _ in range(5):
            side = x @ d > np.median(x @ d)
            if side.all() or not side.any():
                break
            d = x[side].mean(axis=0) - x[~side].mean(axis=0)
        d = d.astype(np.float32)
        less = leaves // 2
        at = x @ d
        limit = float(np.quantile(at, less / leaves))
        left = self._grow(x[at <= limit], less)
        right = self._grow(x[at > limit], leaves - less)
        self.nodes[me] = (d, limit, left, right, -1)
        return me

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            k, rows = todo.pop()
            d, limit, left, right, number = self.nodes[k]
            if number >= 0:
                out[rows] = number
            elif len(rows):
                low = x[rows] @ d <= limit
                todo += [(left, rows[low]), (right, rows[~low])]
        return out


def deal(tokenized: DataFrame, rows: int, p: Packing) -> DataFrame:
    """``tokenized`` with its shard: the leaf of a lexical tree, in so many pieces by a hash that each holds about
    ``shard_docs`` rows at most. Rows that repeat within a task of the scan are numbered, so that copies of one row go
    to different pieces; others go where their own content sends them, whatever the layout."""
    leaves = max(1, -(-rows * 5 // (4 * p.shard_docs)))
    draw = min(max(8_000, 8 * leaves), 60_000)
    hashed = tokenized.select("bag", unit_hash("doc_id", "tokens", "tail_crc", seed=9).alias("h")).filter(F.col("h") < draw / max(1, rows))
    # A row that is drawn is drawn once, however often it is repeated.
    sample = hashed.dropDuplicates(["h"]).orderBy("h").limit(draw * 5 // 4).select("bag")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(_SKETCH_TERMS, dtype=np.int64)
        for batch in batches:
            for bag in batch.column(0).to_pylist():
                df[np.unique(np.frombuffer(bag, "<u4").reshape(2, -1)[0] % _SKETCH_TERMS)] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["term", "n"])

    df = np.zeros(_SKETCH_TERMS)
    for r in sample.mapInArrow(terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r["term"]] = r["n"]
    idf = np.log1p(draw / (df + 0.5)).astype(np.float32)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = _directions()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sketch(b, idf, directions).tobytes() for b in batch.column(0).to_pylist()], pa.binary())], ["x"])

    drawn = sorted(bytes(r["x"]) for r in sample.mapInArrow(sketches, "x binary").collect())
    x = np.frombuffer(b"".join(drawn), np.float32).reshape(-1, _SKETCH)
    shared = tokenized.sparkSession.sparkContext.broadcast((idf, LexicalTree(x, leaves)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        directions, (weights, tree) = _directions(), shared.value
        seen: dict[tuple, int] = {}
        for batch in batches:
            if batch.num_rows:
                at = tree.leaf(np.stack([sketch(b, weights, directions) for b in batch.column("bag").to_pylist()]))
                copy = []
                for key in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tokens", "tail_crc")), strict=True):
                    copy.append(seen.get(key, 0))
                    seen[key] = copy[-1] + 1
                yield batch.append_column("leaf", pa.array(at, pa.int32())).append_column("copy", pa.array(copy, pa.int32()))

    placed = materialize(tokenized.mapInArrow(place, TOKENIZED + ", leaf int, copy int"), "placed")
    count = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}
    pieces = {k: -(-n // p.shard_docs) for k, n in sorted(count.items())}
    first = dict(zip(pieces, np.cumsum([0, *pieces.values()]).tolist(), strict=False))
    # An Arrow table; a list of rows would start Python workers of another kind, which stay beside those of the stages.
    ints = [pa.array(x, pa.int32()) for x in (pieces, [first[k] for k in pieces], pieces.values())]
    plan = tokenized.sparkSession.createDataFrame(pa.table(ints, names=["leaf", "first", "pieces"]))
    shard = F.col("first") + F.pmod(F.xxhash64("doc_id", "tokens", "tail_crc", "copy"), F.col("pieces")).cast("int")
    return placed.join(F.broadcast(plan), "leaf").withColumn("shard", shard)


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids in order, for each id its place among them, and how often each occurs."""
    if ids.max(initial=0) >= 1 << 20:
        return np.unique(ids, return_inverse=True, return_counts=True)
    n = np.bincount(ids)
    terms = np.flatnonzero(n)
    place = np.zeros(len(n), dtype=np.int64)
    place[terms] = np.arange(len(terms))
    return terms, place[ids], n[terms]


class InvertedIndex:
    """BM25 postings of one shard, held by term in one array of documents and one of weights. Terms that a sixteenth of
    the documents hold are rows of a matrix instead, as far as ``cells`` go: their postings are added without looking up
    documents."""

    def __init__(self, bags: list[bytes], p: Packing, cells: int = 4_000_000):
        halves = [np.frombuffer(b, "<u4").reshape(2, -1) for b in bags]
        size = np.array([h.shape[1] for h in halves])
        term = np.concatenate([h[0] for h in halves]).astype(np.int64)
        tf = np.concatenate([h[1] for h in halves]).astype(np.float64)
        doc = np.repeat(np.arange(len(bags)), size)
        length = np.bincount(doc, weights=tf, minlength=len(bags))
        terms, inverse, df = _numbered(term)
        idf = np.log1p((len(bags) - df + 0.5) / (df + 0.5))
        norm = p.k1 * (1 - p.b + p.b * length / max(length.mean(), 1))
        weight = idf[inverse] * tf * (p.k1 + 1) / (tf + norm[doc])
        self.size = len(bags)
        # 16-bit numbers are sorted by their digits.
        by_term = np.argsort(inverse.astype(np.uint16) if len(terms) <= 1 << 16 else inverse, kind="stable")
        self.doc, self.weight = doc[by_term].astype(np.int32), weight[by_term].astype(np.float32)
        self.at = inverse[by_term] * len(bags) + doc[by_term]  # term and document as one number, in order
        common = np.flatnonzero(df * 16 > len(bags))
        common = common[np.argsort(-df[common], kind="stable")][: cells // max(1, len(bags))]
        self.row = np.full(len(terms), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), len(bags)), dtype=np.float32)
        held = self.row[inverse] >= 0
        self.rows[self.row[inverse[held]], doc[held]] = weight[held]
        # The query of a document: its terms that another document has too, all of them or those of most weight.
        shared = df[inverse] > 1
        d, t = doc[shared], inverse[shared]
        if p.query_terms:
            order = np.lexsort((t, -weight[shared], d))
            d, t = d[order], t[order]
            keep = np.arange(len(d)) - np.searchsorted(d, np.arange(len(bags)))[d] < p.query_terms
            d, t = d[keep], t[keep]
        self.query, self.query_start = t, np.searchsorted(d, np.arange(len(bags) + 1))

    def neighbours(self, seed: int, below: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents that share a query term with the seed, and their scores; of those numbered under ``below`` only, if
        it is given. Postings of the others are not read."""
        below = self.size if below is None else below
        query = self.query[self.query_start[seed] : self.query_start[seed + 1]]
        row = self.row[query]
        score = self.rows[row[row >= 0], :below].sum(axis=0, dtype=np.float64)
        rare = query[row < 0] * self.size
        at = [slice(a, b) for a, b in zip(np.searchsorted(self.at, rare).tolist(), np.searchsorted(self.at, rare + below).tolist(), strict=True) if a < b]
        if at:
            score += np.bincount(np.concatenate([self.doc[a] for a in at]), weights=np.concatenate([self.weight[a] for a in at]), minlength=below)
        found = np.flatnonzero(score)
        return found, score[found]


def pack_shard(tails: np.ndarray, index: InvertedIndex, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each tail (none for tails of length 0), sequences of at most ``window`` tokens.
    A seed's neighbours are looked for among the tails up to the last that fits beside it: where tails come in order
    of length, those are just the ones that fit."""
    seq, offset = np.full(len(tails), -1, dtype=np.int64), np.zeros(len(tails), dtype=np.int64)
    by_length: list[list[int]] = [[] for _ in range(window + 1)]
    for k in np.argsort(tails, kind="stable")[::-1].tolist():
        if tails[k]:
            by_length[tails[k]].append(k)
    free = tails > 0
    reach = np.zeros(window + 1, dtype=np.int64)  # for each length, the number after the last tail of that length at most
    np.maximum.at(reach, tails, np.arange(1, len(tails) + 1))
    reach = np.maximum.accumulate(reach)
    present = sum(1 << n for n in range(1, window + 1) if by_length[n])  # bit n: some tail of length n may be left

    def longest(most: int) -> int:
        """The longest tail left of at most ``most`` tokens, or -1."""
        nonlocal present
        while (low := present & ((2 << most) - 1)) > 0:
            n = low.bit_length() - 1
            while by_length[n]:
                k = by_length[n].pop()
                if free[k]:
                    return k
            present ^= 1 << n
        return -1

    number = 0
    while (k := longest(window)) >= 0:
        used = 0

        def put(k: int) -> None:
            nonlocal used
            seq[k], offset[k], free[k] = number, used, False
            used += int(tails[k])

        put(k)
        if used < window:
            found, score = index.neighbours(k, int(reach[window - used]))
            fits = free[found] & (tails[found] <= window - used)
            found, score = found[fits], score[fits]
            for j in found[np.lexsort((found, -score))].tolist():
                if tails[j] <= window - used:
                    put(j)
                    if used == window:
                        break
        while used < window and (k := longest(window - used)) >= 0:
            put(k)
        number += 1
    return seq, offset


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, p: Packing) -> DataFrame:
    """Per piece PACKED. Every id of every row lies in one piece; a piece is a full window or a document's tail. A null
    or empty text has the end id only. Repeated rows are packed each; an empty table gives no rows. An index holds at
    most 1.25 * ``shard_docs`` documents and ``shard_postings`` pairs of a document and a token (one document may have
    more): where a shard has more, several are built, one after the other."""
    rows = docs.count()
    shards = max(1, -(-rows * 5 // (4 * p.shard_docs)))
    parts = min(shards, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        held: list[tuple] = []
        now, taken, postings = None, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal taken
            held.sort(key=lambda row: row[3])
            ids, tokens, full, tail, crc, bags = zip(*held, strict=True)
            tails = np.array(tail, dtype=np.int64)
            seq, offset = pack_shard(tails, InvertedIndex(list(bags), p), p.window)
            number, base = int(seq.max(initial=-1)) + 1, (int(now) << 32) + taken
            out: list[list] = [[] for _ in range(7)]
            for k in range(len(ids)):
                for j, c in enumerate(full[k]):
                    for to, x in zip(out, (ids[k], j * p.window, p.window, c, tokens[k], base + number, 0), strict=True):
                        to.append(x)
                    number += 1
                if tails[k]:
                    for to, x in zip(out, (ids[k], len(full[k]) * p.window, int(tails[k]), crc[k], tokens[k], base + int(seq[k]), int(offset[k])), strict=True):
                        to.append(x)
            taken += number
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(1, 7)]
            for s, row in zip(batch.column(0).to_pylist(), zip(*columns, strict=True), strict=True):
                here = len(row[5]) // 8
                if held and (s != now or len(held) >= p.shard_docs * 5 // 4 or postings + here > p.shard_postings):
                    yield flush()
                    postings = 0
                taken = taken if s == now else 0
                now, postings = s, postings + here
                held.append(row)
        if held:
            yield flush()

    cols = ["doc_id", "tokens", "full", "tail", "tail_crc", "bag"]
    tokenized = tokenize(docs, p)
    dealt = deal(materialize(tokenized, "tokenized"), rows, p).select("shard", *cols).repartition(parts, "shard").sortWithinPartitions("shard", "doc_id", "tail_crc")
    return dealt.mapInArrow(run, PACKED)
