"""Runs of repeated words: maximal periodic stretches of a document, by a suffix automaton with link-cut access.

A run of period q and at least max(12, 2q) words holds every word in a sequence of six that occurs twice within it. So
stretches of words that such sequences cover are found first, by hashes, within each other until nothing changes;
they contain every run as a whole and leave out most of an ordinary text.

Over a stretch a suffix automaton is built. Its suffix links are a tree; the prefix that ends at word i lies under the
states of all its suffixes. Preferred paths of a link-cut forest hold, for each state, the last end at which one of its
strings occurred. Appending word i accesses the path of its prefix: the path consists of segments of equal last end e,
and the lowest state of a segment has the length of the longest common suffix of the prefixes that end at e and i. If
the distance i - e is at most that length, the words up to i end with a square of that period, which reaches back by
length + distance words: its start cannot be moved further, and the last i at which it is seen is the run's end. The
period is the least, since a shorter one would have a later end. Accesses change O(n log n) segments in all."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHORTEST = 12


class SuffixAutomaton:
    """Over a sequence of hashable items. State 0 is the empty string; ``prefix[i]`` is the state of the first i + 1 items."""

    def __init__(self, items: list):
        self.length, self.link, self.prefix = [0], [-1], []
        length, link, step = self.length, self.link, [{}]
        last = 0
        for item in items:
            now, at = len(length), last
            length.append(length[last] + 1)
            link.append(0)
            step.append({})
            while at >= 0 and item not in step[at]:
                step[at][item] = now
                at = link[at]
            if at >= 0:
                to = step[at][item]
                if length[to] == length[at] + 1:
                    link[now] = to
                else:  # the strings of ``to`` up to this length now have ends of their own
                    split = len(length)
                    length.append(length[at] + 1)
                    link.append(link[to])
                    step.append(step[to].copy())
                    while at >= 0 and step[at].get(item) == to:
                        step[at][item] = split
                        at = link[at]
                    link[to] = link[now] = split
            self.prefix.append(now)
            last = now


class LastEnds:
    """The last end of every state's strings, as preferred paths of a link-cut forest over the suffix links. A path is
    a splay tree by depth; all its states have one last end, which its root keeps."""

    def __init__(self, link: list[int]):
        self.up = [max(p, 0) for p in link]  # parent in the splay tree, or the state above the path at its root
        self.left, self.right, self.end = [0] * len(link), [0] * len(link), [0] * len(link)

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """(lowest state, last end) of each segment of the path from ``state`` to the root; then the path's last end is ``end``."""
        up, left, right, ends = self.up, self.left, self.right, self.end
        found, below, v = [], 0, state
        while v:
            # Splay v to the root of its path.
            while True:
                p = up[v]
                if left[p] != v and right[p] != v or not p:
                    break
                g = up[p]
                if g and (left[g] == p or right[g] == p):
                    # Two levels: rotate the parent first if both turn the same way.
                    gg = up[g]
                    if left[g] == p:
                        if left[p] == v:
                            b = left[g] = right[p]
                            if b:
                                up[b] = g
                            right[p], up[g] = g, p
                            b = left[p] = right[v]
                            if b:
                                up[b] = p
                            right[v], up[p] = p, v
                        else:
                            b = right[p] = left[v]
                            if b:
                                up[b] = p
                            b = left[g] = right[v]
                            if b:
                                up[b] = g
                            left[v], right[v], up[p], up[g] = p, g, v, v
                    elif right[p] == v:
                        b = right[g] = left[p]
                        if b:
                            up[b] = g
                        left[p], up[g] = g, p
                        b = right[p] = left[v]
                        if b:
                            up[b] = p
                        left[v], up[p] = p, v
                    else:
                        b = left[p] = right[v]
                        if b:
                            up[b] = p
                        b = right[g] = left[v]
                        if b:
                            up[b] = g
                        right[v], left[v], up[p], up[g] = p, g, v, v
                    up[v] = gg
                    if left[gg] == g:
                        left[gg] = v
                    elif right[gg] == g:
                        right[gg] = v
                    else:
                        ends[v] = ends[g]
                        break
                else:
                    if left[p] == v:
                        b = left[p] = right[v]
                        if b:
                            up[b] = p
                        right[v] = p
                    else:
                        b = right[p] = left[v]
                        if b:
                            up[b] = p
                        left[v] = p
                    up[p], up[v] = v, g
                    ends[v] = ends[p]
                    break
            was = ends[v]
            if was:
                found.append((v, was))
            lower = right[v]
            if lower:
                ends[lower] = was
            right[v] = below
            below, v = v, up[v]
        ends[below] = end
        return found


def stretches(words: np.ndarray, span: int = SHORTEST // 2) -> list[tuple[int, int]]:
    """Disjoint (first, past the last) that contain every run as a whole: each is covered by sequences of ``span``
    words that occur more than once within it."""
    n = len(words)
    group = np.zeros(n, dtype=np.int64)
    if n < SHORTEST:
        return []
    key = np.zeros(n - span + 1, dtype=np.uint64)
    for j in range(span):
        key = (key ^ words[j : n - span + 1 + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    out: list[tuple[int, int]] = []
    while True:
        at = np.flatnonzero((group[: n - span + 1] >= 0) & (group[span - 1 :] == group[: n - span + 1]))
        h = (key[at] ^ group[at].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        change = np.zeros(n + 1, dtype=np.int64)
        change[at[twice]] += 1
        change[at[twice] + span] -= 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]))))
        before, out = out, [(int(a), int(z)) for a, z in edge.reshape(-1, 2) if z - a >= SHORTEST]
        if out == before or not out:
            return out
        group[:] = -1
        for a, z in out:
            group[a:z] = a


def runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least max(12, 2 * period) words, by start, then period."""
    number: dict = {}
    coded = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    out = []
    if len(number) < len(words):
        for first, past in stretches(coded):
            out += [(first + s, n, p) for s, n, p in automaton_runs(coded[first:past].tolist())]
    return sorted(out, key=lambda r: (r[0], r[2]))


def automaton_runs(items: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``items`` of at least max(``shortest``, 2 * period)."""
    sam = SuffixAutomaton(items)
    ends, length = LastEnds(sam.link), sam.length
    last: dict[tuple[int, int], int] = {}
    for end, state in enumerate(sam.prefix, 1):
        for v, was in ends.access(state, end):
            if end - was <= length[v]:
                last[was - length[v], end - was] = end
    return [(start, end - start, p) for (start, p), end in last.items() if end - start >= shortest]


def periodic_tail(words: list[str], seed: int) -> list[str]:
    """What the query makes of a tenth of the documents, by a number drawn from the id: words from some place on repeat."""
    h, n = seed // 10, len(words)
    if seed % 10 or not n:
        return words
    a = h % n
    p = 1 + (n - a) // (3 + h % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


@dataclass
class Found:
    """The runs of one text and its words without repetitions."""

    words: list[str]
    runs: list[tuple[int, int, int]]

    @classmethod
    def of(cls, words: list[str]) -> Found:
        return cls(words, runs(words))

    def longest(self) -> tuple[int, int, int] | None:
        return min(self.runs, key=lambda r: (-r[1], r[0], r[2]), default=None)

    def kept(self) -> list[str]:
        """The words that no run holds after its first period."""
        if not self.runs:
            return self.words
        change = np.zeros(len(self.words) + 1, dtype=np.int64)
        for start, length, period in self.runs:
            change[start + period] += 1
            change[start + length] -= 1
        return [self.words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, period), in words, a row for each run of each text; texts without runs have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                if found := runs(WORD.findall(value.as_py() or "")):
                    cols = [pa.array([key.as_py()] * len(found), pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "period"])

    return _texts(docs, doc_id, text).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, all columns, with each run of a text cut to its first period: its words are then joined by one space.
    Texts without runs, null ones too, stay as they are."""

    @F.pandas_udf("string")
    def short(texts):
        found = texts.map(lambda t: None if t is None else Found.of(WORD.findall(t)))
        return texts.where(found.map(lambda f: f is None or not f.runs), found.map(lambda f: f and " ".join(f.kept())))

    return docs.withColumn(text, short(F.col(text)))


DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def runs_digest(docs: DataFrame) -> DataFrame:
    """DIGEST per row, of texts whose tails ``periodic_tail`` has made periodic by the crc32 of the doc_id in decimal.

    A null or empty text has no words: no runs, nulls, and digests of nothing. A null doc_id counts as an empty one and
    stays null; repeated rows count each; an empty table gives no rows. Of runs of equal length the one that starts
    first, then the one of the shorter period is given. A task holds one text at a time; the automaton takes memory in
    proportion to the longest stretch of repeated words of one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                key = key.as_py()
                found = Found.of(periodic_tail(WORD.findall(value.as_py() or ""), zlib.crc32(b"" if key is None else str(key).encode())))
                listed, most = "".join(f"{s},{n},{p}\n" for s, n, p in found.runs), found.longest()
                best = (*most, 1000 * most[1] // most[2]) if most else (None,) * 4
                rows.append((key, len(found.runs), *best, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, " ".join(found.kept())))))
            types = [pa.int64()] * 6 + [pa.string()] * 2
            cols = zip(*rows, strict=True) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in DIGEST.split(", ")])
        release_memory()

    return _texts(docs, "doc_id", "text").mapInArrow(run, DIGEST)
