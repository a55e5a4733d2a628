"""Cubes as a store of chunks that array programs open (Zarr, version 2): one array (time, band, y, x) whose chunks hold a
block of one band at one time, each a file of its own.

Packed integers are stored byte by byte (all low bytes of a chunk, then all high ones), which compresses better; floats
are stored as they are. A chunk is encoded and written by the group of its pixels, a chunk without values is not written.
Chunks are found by their numbers, so a reader lists nothing: times, bands and a window become the numbers of the
chunks that hold them."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Grid
from .geotiff import filesystem
from .store import Files, jsonable, swap

ARRAY = "Time_Series"
EPOCH = np.datetime64("1970-01-01T00:00:00", "s")


def shuffle(data: bytes, size: int) -> bytes:
    """First bytes of all elements, then their second bytes, and so on."""
    return np.frombuffer(data, np.uint8).reshape(-1, size).T.tobytes() if size > 1 else data


def unshuffle(data: bytes, size: int) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.tobytes() if size > 1 else data


def pack_chunk(block: np.ndarray, shuffled: bool, level: int = 5) -> bytes:
    raw = block.astype(block.dtype.newbyteorder("<")).tobytes()
    return zlib.compress(shuffle(raw, block.dtype.itemsize) if shuffled else raw, level)


def unpack_chunk(data: bytes, dtype: str, shape: tuple[int, int], shuffled: bool) -> np.ndarray:
    raw = zlib.decompress(data)
    kind = np.dtype(dtype)
    return np.frombuffer(unshuffle(raw, kind.itemsize) if shuffled else raw, kind).reshape(shape)


def _array(shape: Sequence[int], chunks: Sequence[int], dtype: str, fill, shuffled: bool) -> dict:
    return {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": dtype, "fill_value": fill, "order": "C",
            "compressor": {"id": "zlib", "level": 5}, "filters": [{"id": "shuffle", "elementsize": np.dtype(dtype).itemsize}] if shuffled else None}


def _write_chunks(folder: str, bands: list[str], chunk: tuple[int, int], dtype: str, fill: float, scale: float, offset: float, shuffled: bool):
    kind = np.dtype(dtype)

    def run(table: pa.Table) -> pa.Table:
        system, root = filesystem(folder)
        t, cr, cc = (table.column(c)[0].as_py() for c in ("t", "cr", "cc"))
        at = (table.column("row").to_numpy() - cr * chunk[0]) * chunk[1] + table.column("col").to_numpy() - cc * chunk[1]
        if len(np.unique(at)) < len(at):
            raise ValueError("two pixels are in one place; make a mosaic of the scenes first")
        sizes = []
        for b, name in enumerate(bands):
            given = table.column(name).to_numpy(zero_copy_only=False)
            held = ~np.isnan(given)
            if not held.any():
                continue
            value = given[held]
            if kind.kind == "i":
                value = np.floor((value - offset) / scale + 0.5)
                info = np.iinfo(kind)
                if value.min() < info.min or value.max() > info.max or (value == fill).any():
                    raise ValueError(f"{name} does not fit {dtype}")
            block = np.full(chunk[0] * chunk[1], fill, dtype=kind)
            block[at[held]] = value.astype(kind)
            data = pack_chunk(block.reshape(chunk), shuffled)
            target = f"{root}/{ARRAY}/{t}.{b}.{cr}.{cc}"
            draft = f"{root}/{ARRAY}/.{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                out.write(data)
            system.move(draft, target)
            sizes.append(len(data))
        return pa.table([pa.array(sizes, pa.int64())], names=["bytes"])

    return run


def write_zarr(
    pixels: DataFrame, path: str, grid: Grid, bands: Sequence[str], dtype: str = "float32", scale: float = 1.0, offset: float = 0.0, fill: float | None = None, chunk: int = 2048,
    shuffled: bool | None = None, attrs: dict | None = None, overwrite: bool = True,
) -> int:
    """Write (time, row, col, bands) beside the target and swap; returns the bytes of all chunks.

    ``dtype`` is float32, float64 or int16; integers hold ``(value - offset) / scale`` rounded half up, bytes
    shuffled unless told otherwise, and their fill value is the lowest. Times become whole seconds, in order. Two pixels
    in one place are refused."""
    spark = pixels.sparkSession
    files = Files(spark, path)
    if files.exists(path) and not overwrite:
        raise FileExistsError(path)
    kind = np.dtype(dtype).newbyteorder("<")
    if kind.str not in ("<f4", "<f8", "<i2"):
        raise ValueError("a chunk store holds float32, float64 or int16")
    whole = kind.kind == "i"
    shuffled = whole if shuffled is None else shuffled
    fill = (float(np.iinfo(kind).min) if whole else float("nan")) if fill is None else fill
    shape = (min(chunk, grid.height), min(chunk, grid.width))
    # One row for each time.
    times = [r["time"] for r in pixels.select("time").distinct().orderBy("time").collect()]
    number = spark.createDataFrame([(t, k) for k, t in enumerate(times)], "time timestamp_ntz, t int")
    block = lambda c, n: F.floor(F.col(c) / n).cast("int")
    rows = pixels.filter((F.col("row") >= 0) & (F.col("row") < grid.height) & (F.col("col") >= 0) & (F.col("col") < grid.width))
    rows = rows.join(F.broadcast(number), "time").select("t", block("row", shape[0]).alias("cr"), block("col", shape[1]).alias("cc"), "row", "col", *(F.col(b).cast("double").alias(b) for b in bands))
    tmp = f"{path}.tmp-{uuid.uuid4().hex[:8]}"
    files.make(f"{tmp}/{ARRAY}")
    written = rows.groupBy("t", "cr", "cc").applyInArrow(_write_chunks(files.qualified(tmp), list(bands), shape, kind.str, fill, scale, offset, shuffled), "bytes long")
    total = written.agg(F.sum("bytes")).first()[0] or 0

    said: dict[str, dict] = {".zgroup": {"zarr_format": 2}, ".zattrs": jsonable({**(attrs or {}), "crs": grid.crs, "GeoTransform": [grid.c, grid.a, 0.0, grid.f, 0.0, grid.e]})}
    said[f"{ARRAY}/.zarray"] = _array((len(times), len(bands), grid.height, grid.width), (1, 1, *shape), kind.str, fill if whole else ("NaN" if np.isnan(fill) else fill), shuffled)
    said[f"{ARRAY}/.zattrs"] = {"_ARRAY_DIMENSIONS": ["time", "band", "y", "x"], "bands": list(bands), **({"scale_factor": scale, "add_offset": offset} if whole else {})}
    seconds = np.array([np.datetime64(t, "s") for t in times], dtype="datetime64[s]") - EPOCH
    axes = {
        "time": (seconds.astype("<i8"), {"units": "seconds since 1970-01-01", "calendar": "proleptic_gregorian"}), "band": (np.arange(len(bands), dtype="<i8"), {"names": list(bands)}),
        "y": (grid.f + (np.arange(grid.height) + 0.5) * grid.e, {}), "x": (grid.c + (np.arange(grid.width) + 0.5) * grid.a, {}),
    }
    for name, (values, more) in axes.items():
        said[f"{name}/.zarray"] = _array([len(values)], [max(1, len(values))], values.dtype.newbyteorder("<").str, None, False)
        said[f"{name}/.zattrs"] = {"_ARRAY_DIMENSIONS": [name], **more}
        files.write_bytes(f"{tmp}/{name}/0", pack_chunk(values, False))
    for name, what in said.items():
        files.write(f"{tmp}/{name}", json.dumps(what))
    files.write(f"{tmp}/.zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": said}))
    swap(tmp, path, files)
    return total


def _meta(files: Files, path: str) -> dict:
    return json.loads(files.read(f"{path}/.zmetadata"))["metadata"]


def _axis(files: Files, path: str, meta: dict, name: str) -> np.ndarray:
    spec = meta[f"{name}/.zarray"]
    return unpack_chunk(files.read_bytes(f"{path}/{name}/0"), spec["dtype"], tuple(spec["shape"]), False)


def zarr_grid(spark: SparkSession, path: str) -> Grid:
    meta = _meta(Files(spark, path), path)
    c, a, _, f, _, e = meta[".zattrs"]["GeoTransform"]
    height, width = meta[f"{ARRAY}/.zarray"]["shape"][2:]
    return Grid(meta[".zattrs"]["crs"], a, e, c, f, width, height)


def chunk_numbers(spec: dict, times: range, window: tuple[int, int, int, int]) -> tuple[range, range, range]:
    """Numbers along time, rows and columns of the chunks that hold times and a window."""
    _, _, h, w = spec["chunks"]
    r0, r1, c0, c1 = max(window[0], 0), min(window[1], spec["shape"][2]), max(window[2], 0), min(window[3], spec["shape"][3])
    if r0 >= r1 or c0 >= c1 or not times:
        return range(0), range(0), range(0)
    return times, range(r0 // h, (r1 - 1) // h + 1), range(c0 // w, (c1 - 1) // w + 1)


def _read_chunks(folder: str, spec: dict, more: dict, bands: list[str], stamps: list[int], window: tuple[int, int, int, int]):
    _, _, h, w = spec["chunks"]
    at = [more["bands"].index(b) for b in bands]
    kind, shuffled = np.dtype(spec["dtype"]), bool(spec["filters"])
    scale, offset = more.get("scale_factor", 1.0), more.get("add_offset", 0.0)
    fill = float(spec["fill_value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        for batch in batches:
            for t, cr, cc in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                values, held = np.zeros((len(at), h * w)), np.zeros((len(at), h * w), dtype=bool)
                for j, b in enumerate(at):
                    name = f"{root}/{ARRAY}/{t}.{b}.{cr}.{cc}"
                    if not system.get_file_info(name).is_file:
                        continue  # no value there
                    with system.open_input_stream(name) as f:
                        x = unpack_chunk(f.read(), spec["dtype"], (h, w), shuffled).ravel()
                    held[j] = ~np.isnan(x) if kind.kind == "f" and np.isnan(fill) else x != fill
                    values[j] = x * scale + offset if kind.kind == "i" else x
                row, col = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
                row, col = row + np.int32(cr * h), col + np.int32(cc * w)
                keep = held.any(axis=0) & (row >= window[0]) & (row < window[1]) & (col >= window[2]) & (col < window[3])
                m = int(keep.sum())
                if m:
                    when = pa.array(np.full(m, stamps[t] * 1_000_000, dtype=np.int64)).cast(pa.timestamp("us"))
                    yield pa.RecordBatch.from_arrays([when, pa.array(row[keep]), pa.array(col[keep]), *(pa.array(v[keep], mask=~o[keep]) for v, o in zip(values, held, strict=True))], ["time", "row", "col", *bands])

    return run


def read_zarr(spark: SparkSession, path: str, bands: Sequence[str] | None = None, start: str | None = None, end: str | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(time, row, col, bands) of the times from ``start`` to before ``end`` and of a window (first row, past the last,
    first column, past the last). Only the chunks that hold them are opened, a task for each block of one time; pixels
    without any value have no row. A chunk that cannot be read fails its task; one that is not there is empty."""
    files = Files(spark, path)
    meta = _meta(files, path)
    spec, more = meta[f"{ARRAY}/.zarray"], meta[f"{ARRAY}/.zattrs"]
    bands = list(bands or more["bands"])
    if bad := [b for b in bands if b not in more["bands"]]:
        raise ValueError(f"the store has no band {', '.join(bad)}; it has {', '.join(more['bands'])}")
    seconds = _axis(files, path, meta, "time")
    limit = lambda text, none: (np.datetime64(text, "s") - EPOCH).astype(int) if text else none
    first, past = np.searchsorted(seconds, limit(start, -(2**62))), np.searchsorted(seconds, limit(end, 2**62))
    window = window or (0, spec["shape"][2], 0, spec["shape"][3])
    ts, rs, cs = chunk_numbers(spec, range(int(first), int(past)), window)
    n = len(ts) * len(rs) * len(cs)
    k, nr, nc = F.col("id"), max(1, len(rs)), max(1, len(cs))
    numbers = spark.range(0, n, 1, max(1, min(n, 10_000))).select((F.lit(ts.start) + F.floor(k / (nr * nc))).cast("int"), (F.lit(rs.start) + F.floor(k / nc) % nr).cast("int"), (F.lit(cs.start) + k % nc).cast("int"))
    schema = "time timestamp_ntz, row int, col int, " + ", ".join(f"`{b}` double" for b in bands)
    return numbers.mapInArrow(_read_chunks(files.qualified(path), spec, more, bands, seconds.tolist(), window), schema)
