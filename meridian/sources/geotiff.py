"""GeoTIFF files as a source of pixels, and pixels as tiled GeoTIFFs with overviews.

Reading: a partition is a share of a file's tiles, or some small files. A task reads the directories of its file, then
the ranges of the tiles that its window, bands and level need; nothing else is opened, and the driver reads one
directory, for the schema. Comparisons on time and layer leave out files, those on row and col leave out tiles.

Writing: overviews are sums and counts of the level below, two by two, so each is a quarter of a shuffle; a tile
of every level is encoded by its own group; a file is put together by one task that holds its directory and one batch
of encoded tiles. Files are written beside the target under names of the attempt and moved, and the folder is swapped."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from datetime import date, datetime

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..operators.grid import Grid
from . import tiff
from .store import Files, band_order, swap

DATE = re.compile(r"\d{4}-\d{2}-\d{2}(?:T\d{6})?")
#: Bytes that are read at once at the start of a file, which holds the directories.
HEAD = 1 << 16


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """As pyarrow opens it: a local path, or a URI of any store that it knows."""
    if re.match(r"^\w[\w+.-]+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


class Opened:
    """Ranges of one file; ``reads`` lists those that were fetched."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.file, self.reads = system.open_input_file(path), []
        self.head = self._fetch(0, min(HEAD, self.file.size()))

    def _fetch(self, at: int, n: int) -> bytes:
        self.reads.append((at, n))
        return self.file.read_at(n, at)

    def read_at(self, at: int, n: int) -> bytes:
        return self.head[at : at + n] if at + n <= len(self.head) else self._fetch(at, n)

    def close(self) -> None:
        self.file.close()


def named(path: str) -> tuple[str, datetime | None]:
    """Layer and time of a file by its name: the last date in it is the time, whatever is before it the layer."""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    found = list(DATE.finditer(stem))
    if not found:
        return stem, None
    text = found[-1][0]
    when = datetime.strptime(text, "%Y-%m-%dT%H%M%S" if "T" in text else "%Y-%m-%d")
    return stem[: found[-1].start()].rstrip("_- ") or "Time_Series", when


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the .tif and .tiff files of a folder."""
    system, root = filesystem(path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    out = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and (info is found[0] or f.extension.lower() in ("tif", "tiff")))
    if not out:
        raise FileNotFoundError(f"no GeoTIFF in {path}")
    return out


def open_raster(path: str) -> tiff.Raster:
    """The directories of one file, or of the first of a folder."""
    first = _listed(path)[0][0]
    opened = Opened(filesystem(path)[0], first)
    try:
        return tiff.parse(opened.read_at)
    finally:
        opened.close()


class GeoTiffSource(DataSource):
    """``spark.read.format("geotiff").load(path)``: layer, time, row, col and a column for each band.

    Options: ``bands`` (names, by commas; the file's if it has them, else band_1 and so on), ``level`` (0 is the full
    image, 1 the first overview), ``window`` (first row, past the last, first column, past the last), ``raw`` (stored
    numbers instead of scaled ones), ``split_bytes``. Missing values are null; pixels without any value have no row.
    All files of a folder have the bands of its first one."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def _fields(self) -> tuple[list[str], str]:
        r = open_raster(self.options["path"])
        bands = [b.strip() for b in self.options["bands"].split(",")] if self.options.get("bands") else list(r.names)
        if bad := [b for b in bands if b not in r.names]:
            raise ValueError(f"the file has no band {', '.join(bad)}; it has {', '.join(r.names)}")
        raw = self.options.get("raw", "false").lower() == "true"
        whole = np.dtype(r.levels[0].dtype).kind != "f" and (raw or not r.scaled)
        return bands, "int" if whole and r.levels[0].dtype != "u4" else "double"

    def schema(self) -> str:
        bands, kind = self._fields()
        return "layer string, time timestamp_ntz, row int, col int, " + ", ".join(f"`{b}` {kind}" for b in bands)

    def reader(self, schema) -> DataSourceReader:
        window = self.options.get("window")
        kinds = [f.dataType.simpleString() for f in schema.fields[4:]]
        return GeoTiffReader(
            self.options["path"], [f.name for f in schema.fields[4:]], kinds, int(self.options.get("level", 0)), tuple(int(v) for v in window.split(",")) if window else None,
            self.options.get("raw", "false").lower() == "true", int(self.options.get("split_bytes", 32 << 20)),
        )


class GeoTiffReader(DataSourceReader):
    def __init__(self, path: str, bands: list[str], kinds: list[str], level: int, window: tuple[int, ...] | None, raw: bool, split: int):
        self.path, self.bands, self.kinds, self.level, self.raw, self.split = path, bands, kinds, level, raw, split
        far = 1 << 31
        self.window = list(window or (0, far, 0, far))
        self.files: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """All are left to Spark too, since tiles are coarser than rows; here they only leave out files and tiles."""
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name in ("row", "col"):
                lo = 0 if name == "row" else 2
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.window[lo] = max(self.window[lo], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.window[lo + 1] = min(self.window[lo + 1], f.value + (not isinstance(f, LessThan)))
            elif name in ("layer", "time") and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.files.append((name, type(f).__name__, f.value))
            yield f

    def _wanted(self, path: str) -> bool:
        layer, when = named(path)
        for name, test, value in self.files:
            have = layer if name == "layer" else when
            if isinstance(value, date) and not isinstance(value, datetime):
                value = datetime(value.year, value.month, value.day)
            value = value.replace(tzinfo=None) if isinstance(value, datetime) else value
            if type(have) is not type(value):  # nothing is known of it here
                if have is None:
                    return False  # a comparison with null holds for no row
                continue
            if not {"EqualTo": have == value, "GreaterThan": have > value, "GreaterThanOrEqual": have >= value, "LessThan": have < value, "LessThanOrEqual": have <= value}[test]:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        """Shares (path, k, n) of large files, and lists of small ones, of about ``split`` bytes each."""
        out, small, held = [], [], 0
        for path, size in _listed(self.path):
            if not self._wanted(path):
                continue
            n = max(1, round(size / self.split))
            if n > 1:
                out += [InputPartition([(path, k, n)]) for k in range(n)]
                continue
            if small and held + size > self.split:
                out.append(InputPartition(small))
                small, held = [], 0
            small, held = [*small, (path, 0, 1)], held + size
        return out + ([InputPartition(small)] if small else [])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system = filesystem(self.path)[0]
        for path, k, n in partition.value:
            opened = Opened(system, path)
            try:
                yield from self.pixels(opened, path, k, n)
            finally:
                opened.close()

    def pixels(self, opened: Opened, path: str, k: int = 0, n: int = 1) -> Iterator[pa.RecordBatch]:
        """A batch for each tile of the k-th of n shares that the window meets."""
        r = tiff.parse(opened.read_at)
        if lacking := [b for b in self.bands if b not in r.names]:
            raise ValueError(f"{path} has no band {', '.join(lacking)}")
        if self.level >= len(r.levels):
            raise ValueError(f"{path} has {len(r.levels)} levels")
        at, v = [r.names.index(b) for b in self.bands], r.levels[self.level]
        layer, when = named(path)
        r0, r1, c0, c1 = self.window
        total = v.across * v.down
        for tile, tr, tc in v.tiles((r0, r1, c0, c1)):
            if not total * k // n <= tile < total * (k + 1) // n:
                continue
            x = v.read(opened.read_at, tile, at)
            if x is None:
                continue
            row, col = np.indices(x.shape[:2], dtype=np.int32)
            row, col = (row + tr * v.tile_height).ravel(), (col + tc * v.tile_width).ravel()
            x = x.reshape(len(row), len(at))
            there = ~np.isnan(x) if x.dtype.kind == "f" else np.ones(x.shape, dtype=bool)
            if r.nodata is not None:
                there &= x != np.array(r.nodata).astype(x.dtype)
            keep = there.any(axis=1) & (row >= r0) & (row < r1) & (col >= c0) & (col < c1)
            if not keep.any():
                continue
            row, col, x, there = row[keep], col[keep], x[keep], there[keep]
            cols = []
            for j, kind in enumerate(self.kinds):
                y = x[:, j].astype(np.float64 if kind == "double" else np.int32)
                if kind == "double" and not self.raw:
                    y = y * r.scale[at[j]] + r.offset[at[j]]
                cols.append(pa.array(y, mask=~there[:, j]))
            m = len(row)
            yield pa.RecordBatch.from_arrays([pa.array([layer] * m, pa.string()), pa.array([when] * m, pa.timestamp("us")), pa.array(row), pa.array(col), *cols], ["layer", "time", "row", "col", *self.bands])


def read_geotiff(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pixels of a file or folder, with filters pushed down; options of ``GeoTiffSource``."""
    spark.dataSource.register(GeoTiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("geotiff").options(**{k: str(v) for k, v in options.items()}).load(path)


def file_name(key: str, prefix: str = "") -> Column:
    """``prefix`` and the date of ``time`` (with the hour, where there is one), or a safe form of the layer's name."""
    if key == "time":
        name = F.when(F.col("time") == F.date_trunc("day", "time").cast("timestamp_ntz"), F.date_format("time", "yyyy-MM-dd")).otherwise(F.date_format("time", "yyyy-MM-dd'T'HHmmss"))
    else:
        name = F.regexp_replace(F.regexp_replace(F.trim(F.col(key)), r'[<>:"/\\|?*]+', "_"), r"\s+", "_")
    return F.concat(F.lit(prefix), name, F.lit(".tif"))


def _levels(grid: Grid, tile: int) -> list[tuple[int, int]]:
    """The full size, and halves of it down to one tile."""
    out = [(grid.width, grid.height)]
    while max(out[-1]) > tile:
        out.append(tuple(-(-v // 2) for v in out[-1]))
    return out


def pyramid(pixels: DataFrame, bands: Sequence[str], levels: int, nearest: Sequence[str] = ()) -> DataFrame:
    """(file, level, row, col, bands): the pixels and, level by level, the mean of the values that are there of each two
    by two of the level below, weighted as the full pixels below it; bands in ``nearest`` keep their upper left pixel."""
    means = [b for b in bands if b not in nearest]
    at = pixels.select("file", "row", "col", *(F.col(b).cast("double").alias(f"s_{b}") for b in bands), *(F.col(b).isNotNull().cast("long").alias(f"n_{b}") for b in means))
    out = None
    for k in range(levels):
        if k:
            corner = (F.col("row") % 2 == 0) & (F.col("col") % 2 == 0)
            sums = [F.sum(f"{x}_{b}").alias(f"{x}_{b}") for b in means for x in "sn"] + [F.max(F.when(corner, F.col(f"s_{b}"))).alias(f"s_{b}") for b in bands if b in nearest]
            at = at.groupBy("file", F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")).agg(*sums)
        values = (F.col(f"s_{b}") / F.nullif(F.col(f"n_{b}"), F.lit(0)) if b in means and k else F.col(f"s_{b}") for b in bands)
        now = at.select("file", F.lit(k).alias("level"), "row", "col", *(v.alias(b) for v, b in zip(values, bands, strict=True)))
        out = now if out is None else out.unionByName(now)
    return out


TILES = "file string, kind int, depth int, band int, tile int, size int, data binary"


def _encode(shapes, bands, dtype, tile, nodata, scale, offset):
    kind = np.dtype(dtype)

    def run(table: pa.Table) -> pa.Table:
        level = table.column("level")[0].as_py()
        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        tr, tc = int(row[0]) // tile, int(col[0]) // tile
        at = (row - tr * tile) * tile + col - tc * tile
        if len(np.unique(at)) < len(at):
            raise ValueError("two pixels are in one place; make a mosaic of the scenes first")
        rows = []
        for b, name in enumerate(bands):
            given = table.column(name).to_numpy(zero_copy_only=False)
            held = ~np.isnan(given)
            if not held.any():
                continue
            block, value = np.full(tile * tile, nodata, dtype=kind), (given[held] - offset) / scale
            if kind.kind != "f":
                info = np.iinfo(kind)
                value = np.floor(value + 0.5)
                if value.min() < info.min or value.max() > info.max:
                    raise ValueError(f"{name} does not fit {dtype}")
            block[at[held]] = value.astype(kind)
            data = tiff.encode(block.reshape(tile, tile))
            number = tr * -(-shapes[level][0] // tile) + tc
            rows += [(b, number, len(data), None, 0), (b, number, len(data), data, 1)]
        n, name = len(rows), table.column("file")[0].as_py()
        b, number, size, data, which = zip(*rows, strict=True) if rows else [()] * 5
        depth = [-level] * n  # the smallest level first
        return pa.table([pa.array([name] * n, pa.string()), pa.array(which, pa.int32()), pa.array(depth, pa.int32()), pa.array(b, pa.int32()), pa.array(number, pa.int32()), pa.array(size, pa.int32()), pa.array(data, pa.binary())], names=[c.split()[0] for c in TILES.split(", ")])

    return run


def _write(folder: str, blank: tiff.Directory):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        name, out, draft, directory, done = None, None, "", None, []

        def finish() -> None:
            size = out.tell()
            out.close()
            system.move(draft, f"{root}/{name}")
            done.append((name, size))

        for batch in batches:
            for f, kind, depth, band, number, size, data in zip(*(batch.column(c) for c in range(7)), strict=True):
                if (f := f.as_py()) != name:
                    if out is not None:
                        finish()
                    name, out, directory = f, None, tiff.Directory(blank.shapes, blank.names, blank.dtype, blank.tile, blank.grid, blank.nodata, blank.scale, blank.offset)
                if kind.as_py() == 0:
                    directory.sizes[-depth.as_py(), band.as_py(), number.as_py()] = size.as_py()
                    continue
                if out is None:
                    draft = f"{root}/.{name}.{uuid.uuid4().hex}"
                    out = system.open_output_stream(draft)
                    out.write(directory.head())
                out.write(data.as_buffer())
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([s for _, s in done], pa.int64())], ["file", "bytes"])

    return run


def export_geotiffs(
    pixels: DataFrame, path: str, grid: Grid, bands: Sequence[str], key: str = "time", prefix: str = "", dtype: str = "float32", tile: int = 256, overviews: bool = True,
    nearest: Sequence[str] = (), scale: float = 1.0, offset: float = 0.0, nodata: float = -9999.0, overwrite: bool = True,
) -> list[str]:
    """A file for each time or layer of ``pixels`` (row, col, bands and ``key``, or ``file``, its name), red, green and blue first where all
    are there; returns the names, one per file. Values are stored as ``(value - offset) / scale``. A band without a
    value in a tile takes no room there; a file without any value is not written. Two pixels in one place are refused."""
    files = Files(pixels.sparkSession, path)
    if files.exists(path) and not overwrite:
        raise FileExistsError(path)
    if tile % 16:
        raise ValueError("tiles are multiples of 16 pixels")
    names = band_order(bands)
    shapes = _levels(grid, tile) if overviews else [(grid.width, grid.height)]
    inside = pixels.filter((F.col("row") >= 0) & (F.col("row") < grid.height) & (F.col("col") >= 0) & (F.col("col") < grid.width))
    inside = inside if key == "file" else inside.withColumn("file", file_name(key, prefix))
    rows = pyramid(inside, names, len(shapes), nearest).filter(F.coalesce(*names).isNotNull())
    tiles = rows.groupBy("file", "level", F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"))
    tiles = tiles.applyInArrow(_encode(shapes, names, dtype, tile, nodata, scale, offset), TILES)
    tmp = f"{path}.tmp-{uuid.uuid4().hex[:8]}"
    files.make(tmp)
    blank = tiff.Directory(shapes, names, dtype, tile, grid, nodata, scale, offset)
    parts = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    put = tiles.repartition(parts, "file").sortWithinPartitions("file", "kind", "depth", "band", "tile")
    done = [r["file"] for r in put.mapInArrow(_write(files.qualified(tmp), blank), "file string, bytes long").collect()]
    swap(tmp, path, files)
    return sorted(done)
