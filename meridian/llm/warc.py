"""WARC archives and their index.

Tasks write captures as gzip members of WARC 1.1 files in the shared folder, one bounded run at a time, each run sorted
by URL key, timestamp and id, and return its index entries. The index is merged externally: the key space is cut into
ranges, and in each range the segments of all runs, which are sorted, meet in a k-way loser tree; range after range the
entries are in global order, so that the captures of a URL form one history. Archives are read back by that index.

Files carry a random name, and only the entries of a successful task name them; a repeated task leaves an orphan that
no entry points to."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, mark_likely, materialize, scratch_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Timestamp of page 0 where a table has no capture times: 2024-01-01T00:00:00Z.
EPOCH = 1704067200
INDEX = "run string, seq int, url_key string, ts long, page_id long, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """Host labels reversed and joined by commas, ``)``, path and query; a URL without ``://`` is its own key, null is empty."""
    host = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)).otherwise(url), F.lit(""))


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, ts: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record: response, or revisit without payload if ``refers_to`` is given."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:x-page:none"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {datetime.fromtimestamp(ts, UTC):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one uncompressed record; ValueError if it is none or cut."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut")
    return headers, rest[:size]


def _compressed(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(captures: DataFrame, folder: str, run_bytes: int = 32 << 20, run_records: int = 20_000) -> DataFrame:
    """Write ``captures`` (page_id, ts, url, url_key, html, digest, refers_to) and return the index entries, materialized."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        task = TaskContext.get()
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda x: x[0])
            name = f"run-{task.partitionId():05d}-{uuid.uuid4().hex}"
            file, at, out = f"{name}.warc.gz", 0, []
            with fs.open_output_stream(f"{path}/{file}", compression=None) as to:
                for n, ((key, ts, _, page_id), data) in enumerate(held):
                    to.write(data)
                    out.append((name, n, key, ts, page_id, file, at, len(data)))
                    at += len(data)
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["run", "seq", "url_key", "ts", "page_id", "file", "offset", "length"])

        for batch in batches:
            small = [batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5, 6)]
            for page_id, ts, url, key, digest, refers_to, html in zip(*small, batch.column(4), strict=True):
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                data = _compressed(record(page_id, ts, url, payload, digest, refers_to))
                held.append(((key, ts, page_id is None, page_id), data))
                size += len(data)
                if size >= run_bytes or len(held) >= run_records:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return materialize(captures.select("page_id", "ts", "url", "url_key", "html", "digest", "refers_to").mapInArrow(run, INDEX), "capture-runs")


class LoserTree:
    """Merges sorted runs of (key, value): an inner node holds the loser of the match played there, so that taking the
    least value replays one path only. A run that has ended loses to every other; equal keys go by the run's number."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = [iter(r) for r in runs], len(runs)
        self.head = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(1, self.k)
        if self.k:
            self.tree[0] = self._play(1)

    def _less(self, i: int, j: int) -> bool:
        a, b = self.head[i], self.head[j]
        return a is not None and (b is None or (a[0], i) < (b[0], j))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, self.tree[node] = (a, b) if self._less(a, b) else (b, a)
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (top := self.head[win := self.tree[0]]) is not None:
            yield top
            self.head[win] = next(self.runs[win], None)
            node = (win + self.k) // 2
            while node:
                if self._less(self.tree[node], win):
                    win, self.tree[node] = self.tree[node], win
                node //= 2
            self.tree[0] = win


MERGED = "part int, pos long, url_key string, ts long, page_id long, file string, offset long, length long"


def merge_index(entries: DataFrame, rows_per_range: int = 50_000) -> DataFrame:
    """The entries in global order of (url_key, ts, page_id): by ``part``, then ``pos``. Ranges are cut on all three, so
    one URL with very many captures spreads over several."""
    parts = max(1, -(-entries.count() // rows_per_range))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list] = {}
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in range(8)]
            for name, seq, key, ts, page_id, *place in zip(*cols, strict=True):
                runs.setdefault(name, []).append((seq, ((key, ts, page_id is None, page_id), place)))
        for segment in runs.values():
            segment.sort(key=lambda x: x[0])  # shuffle blocks may come in any order
        part, out, pos = TaskContext.get().partitionId(), [], 0
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "pos", "url_key", "ts", "page_id", "file", "offset", "length"])
        for (key, ts, _, page_id), place in LoserTree([(x for _, x in s) for s in runs.values()]):
            out.append((part, pos, key, ts, page_id, *place))
            pos += 1
            if len(out) == 10_000:
                yield table()
                out.clear()
        if out:
            yield table()

    return entries.repartitionByRange(parts, "url_key", "ts", "page_id").mapInArrow(run, MERGED)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, ts long, index_part int, index_pos long"


def read(index: DataFrame, folder: str) -> DataFrame:
    """READ of every record that ``index`` names. Lengths and digests of responses are taken from the payloads read; a
    digest that differs from the record's is an error."""

    def number(header: str | None) -> int | None:
        value = (header or "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(value) if re.fullmatch(r"-?\d+", value) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        name, source = None, None
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64())
        names = [x.split()[0] for x in READ.split(", ")]
        for batch in batches:
            out = []
            for file, offset, length, key, ts, part, pos in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if file != name:
                    if source:
                        source.close()
                    name, source = file, fs.open_input_file(f"{path}/{file}")
                headers, block = parse(zlib.decompress(source.read_at(length, offset), 31))
                http, _, payload = block.partition(b"\r\n\r\n")
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                size = int(re.search(rb"(?mi)^Content-Length: (\d+)", http)[1])
                if kind == "response":
                    size = len(payload)
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {headers['warc-record-id']} in {file} is damaged")
                out.append((number(headers["warc-record-id"]), size, digest, kind, number(headers.get("warc-refers-to")), key, ts, part, pos))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if source:
            source.close()

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_file = index.select("file", "offset", "length", "url_key", "ts", "part", "pos").repartition(parts, "file").sortWithinPartitions("file", "offset")
    return by_file.mapInArrow(run, READ)


def archive_pages(pages: DataFrame, folder: str | None = None, ts: Column | None = None, least: int = 100, max_broadcast: int = 100_000) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html), merge the index, read all back: READ per row.

    A null html is an empty payload. Of payloads of at least ``least`` bytes that are equal, the one with the smallest
    page_id is the response (rows that repeat that id all are), the others refer to it; a null page_id comes last and
    is never referred to. ``ts``: seconds of capture; by default EPOCH plus page_id."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    when = ts if ts is not None else F.lit(EPOCH) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(1 << 32))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", when.cast("long").alias("ts"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes"))
    first = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = materialize(first.filter("n > 1").select("digest", "first", "n"), "repeated-payloads")
    # Repeated payloads are few or many: their digests are broadcast only up to max_broadcast rows of some 80 bytes.
    # Beyond that a bitmap keeps all other payloads where they are, very common ones are joined by broadcast, and only
    # the rest of the repeated ones is shuffled by digest.
    if first.count() <= max_broadcast:
        rows = rows.join(F.broadcast(first.drop("n")), "digest", "left")
    else:
        marked = mark_likely(rows, "digest", first, "digest", "__likely")
        twice = join_groups(marked.filter("__likely"), first, "digest", "n", rows.count(), "left")
        rows = twice.unionByName(marked.filter("not __likely").withColumn("first", F.lit(None).cast("long"))).drop("__likely")
    refers = F.when(F.col("bytes") >= least, F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")))
    captures = rows.withColumns({"refers_to": refers, "url_key": url_key(F.col("url"))})
    return read(merge_index(write(captures, folder)), folder)
