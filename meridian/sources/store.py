"""Cubes on disk: Parquet by date beside a description, swapped into place as a whole, and their sidecars."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Grid

#: Names that older cubes have for the time series table.
LEGACY = {"Spectral_Temporal_Stack": "Time_Series"}
FORMATS = (None, "parquet", "csv", "geotiff", "zarr")


class Files:
    """The file system of a path, whatever Hadoop calls it: what is needed to write beside a target and swap."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = spark._jvm.org.apache.hadoop.io.IOUtils

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def qualified(self, path: str) -> str:
        """With the scheme of its file system, for readers that do not know Hadoop's default."""
        return self._fs.makeQualified(self._path(path)).toString()

    def rename(self, path: str, to: str) -> None:
        if not self._fs.rename(self._path(path), self._path(to)):
            raise OSError(f"{path} could not be renamed to {to}")

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(path))]

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def write_bytes(self, path: str, data: bytes) -> None:
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def write(self, path: str, text: str) -> None:
        self.write_bytes(path, text.encode())

    def read_bytes(self, path: str) -> bytes:
        source = self._fs.open(self._path(path))
        try:
            return bytes(source.readAllBytes())
        finally:
            source.close()

    def read(self, path: str) -> str:
        return self.read_bytes(path).decode()


def resolve_path(path: str, spark: SparkSession | None = None) -> str:
    """The root of a cube from any file in it."""
    spark = spark or SparkSession.getActiveSession()
    files, at = Files(spark, path), path.rstrip("/")
    while at and not at.endswith(":"):
        if files.exists(f"{at}/meta.json"):
            return at
        at = at.rpartition("/")[0]
    if path.endswith(".vrt"):
        raise ValueError("a .vrt is a view for a map program; open the cube")
    return path


def validate_format(path: str, fmt: str | None) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"format is one of {', '.join(map(str, FORMATS))}")
    ends = {"csv": ".csv", "zarr": ".zarr"}
    if fmt in ends and not path.endswith(ends[fmt]):
        raise ValueError(f"{fmt} goes to a path that ends in {ends[fmt]}")
    return fmt or "parquet"


def write_cube(pixels: DataFrame, path: str, grid: Grid | None = None, attrs: dict | None = None, stats: DataFrame | None = None, overwrite: bool = True, compression: str = "zstd", block_rows: int = 2048) -> str:
    """Write beside the target, then swap (see ``swap``); the new cube may read the old.
    Files are those of a month and a block of ``block_rows`` rows, sorted by day, so that a day is read by the statistics of
    row groups; a month is never one task where scenes are large."""
    files = Files(pixels.sparkSession, path)
    if files.exists(path) and not overwrite:
        raise FileExistsError(path)
    tmp = f"{path}.tmp-{uuid.uuid4().hex[:8]}"
    timed = "time" in pixels.columns
    dealt = _dealt(pixels, block_rows) if timed else pixels
    out = dealt.write.option("compression", compression)
    (out.partitionBy("month") if timed else out).parquet(f"{tmp}/pixels")
    if stats is not None:
        stats.coalesce(1).write.parquet(f"{tmp}/scene_stats")
    meta = {"attrs": attrs or {}, "grid": asdict(grid) if grid else None, "columns": pixels.columns}
    files.write(f"{tmp}/meta.json", json.dumps(jsonable(meta), indent=2))
    swap(tmp, path, files)
    return path


def swap(new: str, target: str, files: Files) -> None:
    """The target is not touched until the new one is complete. Between the two renames a reader finds no cube for a
    moment; object stores copy on rename, so there the moment is longer."""
    old = f"{target}.old-{uuid.uuid4().hex[:8]}"
    had = files.exists(target)
    if had:
        files.rename(target, old)
    try:
        files.rename(new, target)
    except OSError:
        if had:
            files.rename(old, target)
        raise
    if had:
        files.remove(old)


def _dealt(pixels: DataFrame, block_rows: int) -> DataFrame:
    """Keyed by day and month; a task for each month and block of rows."""
    block = [F.floor(F.col("row") / block_rows)] if "row" in pixels.columns else []
    keyed = pixels.withColumns({"day": F.to_date("time"), "month": F.trunc("time", "month")})
    return keyed.repartition("month", *block).sortWithinPartitions("month", "day", "time")


def merge_days(new: DataFrame, path: str, attrs: dict | None = None, stats: DataFrame | None = None, compression: str = "zstd", block_rows: int = 2048) -> list[str]:
    """Add the days of ``new`` that a stored cube lacks; returns the months written. Only these months are written anew,
    with what they held, and put in place one by one; files of other months are not touched. ``new`` has the columns of
    the cube. A merge that is run again after a failure finds the days that are there and adds the rest."""
    spark = new.sparkSession
    root, files = resolve_path(path, spark), Files(spark, path)
    meta = json.loads(files.read(f"{root}/meta.json"))
    old = spark.read.parquet(f"{root}/pixels")
    columns = [c for c in old.columns if c not in ("day", "month")]
    if lacking := sorted(set(columns) ^ set(new.columns)):
        raise ValueError(f"the cube and what is added differ in {', '.join(lacking)}")
    fresh = new.select(*columns).withColumn("__day", F.to_date("time")).join(old.select(F.col("day").alias("__day")).distinct(), "__day", "left_anti").drop("__day")
    # One row for each month.
    months = [r["m"] for r in fresh.select(F.trunc("time", "month").alias("m")).distinct().orderBy("m").collect()]
    if not months:
        return []
    tmp, away = f"{root}.tmp-{uuid.uuid4().hex[:8]}", f"{root}.old-{uuid.uuid4().hex[:8]}"
    whole = old.filter(F.col("month").isin(months)).select(*columns).unionByName(fresh)
    _dealt(whole, block_rows).write.option("compression", compression).partitionBy("month").parquet(f"{tmp}/pixels")
    if stats is not None:
        stats.coalesce(1).write.parquet(f"{tmp}/scene_stats")
    files.make(away)
    for name in [n for n in files.names(f"{tmp}/pixels") if n.startswith("month=")]:
        if files.exists(f"{root}/pixels/{name}"):
            files.rename(f"{root}/pixels/{name}", f"{away}/{name}")
        files.rename(f"{tmp}/pixels/{name}", f"{root}/pixels/{name}")
    if stats is not None:
        if files.exists(f"{root}/scene_stats"):
            files.rename(f"{root}/scene_stats", f"{away}/scene_stats")
        files.rename(f"{tmp}/scene_stats", f"{root}/scene_stats")
    if attrs is not None:
        files.write(f"{root}/meta.json", json.dumps(jsonable({**meta, "attrs": {**meta["attrs"], **attrs}}), indent=2))
    files.remove(tmp)
    files.remove(away)
    return [str(m)[:7] for m in months]


def open_cube(spark: SparkSession, path: str) -> tuple[DataFrame, Grid | None, dict, DataFrame | None]:
    """Pixels, grid, attributes and scene statistics. A filter on ``time`` prunes files by ``day`` only if it names the
    day too; use ``days``."""
    root, files = resolve_path(path, spark), Files(spark, path)
    meta = json.loads(files.read(f"{root}/meta.json"))
    pixels = spark.read.parquet(f"{root}/pixels").withColumnsRenamed(LEGACY)
    stats = spark.read.parquet(f"{root}/scene_stats") if files.exists(f"{root}/scene_stats") else None
    return pixels, Grid(**meta["grid"]) if meta["grid"] else None, meta["attrs"], stats


def require_time_series(attrs: dict, columns: Sequence[str]) -> None:
    """An update adds dates to a time series; a cube of composites has none."""
    if attrs.get("time_series") is False or "time" not in columns:
        raise ValueError(f"there is no time series to update, only {', '.join(attrs.get('layers') or [c for c in columns if c not in ('row', 'col')])}; build it anew over the longer range")


def days(pixels: DataFrame, start: str, end: str) -> DataFrame:
    """Both days included; prunes partitions by month and row groups by day."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return pixels.filter(F.col("day").between(first, last) & F.col("month").between(F.trunc(first, "month"), last))


def stored_parameters(spark: SparkSession, path: str) -> dict:
    """What a later update must ask for."""
    pixels, grid, attrs, _ = open_cube(spark, path)
    first, last = pixels.agg(F.min("time"), F.max("time")).first()
    known = {k: attrs.get(k) for k in ("mission", "stac_api", "spectral_bands", "indices", "resampling", "cloud_status", "tile_handling", "bbox")}
    return {**known, "resolution": abs(grid.a) if grid else None, "crs": grid.crs if grid else None, "daterange": [str(first)[:10], str(last)[:10]]}


def jsonable(value):
    """Values that JSON has; others by the name of their kind, not silently as text."""
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [jsonable(v) for v in value]
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    return f"<{type(value).__name__}>"


def sidecar(path: str, end: str) -> str:
    """``path`` with ``end`` in place of its extension."""
    folder, slash, name = path.rpartition("/")
    return f"{folder}{slash}{name.rpartition('.')[0] or name}{end}"


def write_settings(path: str, parameters: dict) -> str:
    """``<output>_settings.json`` of a call, as it was made, in the file system of the path."""
    out = sidecar(path, "_settings.json")
    Files(SparkSession.active(), out).write(out, json.dumps({"parameters": jsonable(parameters)}, indent=2))
    return out


def read_settings(path: str) -> dict:
    return json.loads(Files(SparkSession.active(), path).read(path))["parameters"]


def write_statistics_csv(stats: DataFrame, path: str) -> str:
    """One file; the table has rows per day, month and year, however many pixels there were."""
    files, tmp = Files(stats.sparkSession, path), f"{path}.tmp-{uuid.uuid4().hex[:8]}"
    stats.coalesce(1).write.option("header", True).csv(tmp)
    part = next(n for n in files.names(tmp) if n.startswith("part-"))
    files.remove(path)
    files.rename(f"{tmp}/{part}", path)
    files.remove(tmp)
    return path


def band_order(bands: Sequence[str]) -> list[str]:
    """Red, green, blue first, for programs that show the first three."""
    rgb = [b for b in ("red", "green", "blue") if b in bands]
    return (rgb if len(rgb) == 3 else []) + [b for b in bands if len(rgb) < 3 or b not in rgb]


def vrt(images: Sequence[tuple[str, str]], grid: Grid, bands: Sequence[str], data_type: str = "Float32", nodata: float | None = None, scale: float | None = None, offset: float | None = None) -> str:
    """A virtual raster over image files: ``images`` are (date or layer, file beside the virtual raster), all of them
    with ``bands`` in this order. Each of its images is named ``date band``."""
    out = [f'<VRTDataset rasterXSize="{grid.width}" rasterYSize="{grid.height}">', f"  <SRS>{escape(grid.crs)}</SRS>", f"  <GeoTransform>{grid.c}, {grid.a}, 0, {grid.f}, 0, {grid.e}</GeoTransform>"]
    whole = f'xOff="0" yOff="0" xSize="{grid.width}" ySize="{grid.height}"'
    n = 0
    for label, file in images:
        for k, b in enumerate(bands, 1):
            n += 1
            out += [f'  <VRTRasterBand dataType="{data_type}" band="{n}">', f"    <Description>{escape(f'{label} {b}')}</Description>"]
            out += [f"    <NoDataValue>{nodata:g}</NoDataValue>"] if nodata is not None else []
            out += [f"    <Scale>{scale}</Scale>", f"    <Offset>{offset}</Offset>"] if scale is not None else []
            out += [f'    <SimpleSource><SourceFilename relativeToVRT="1">{escape(file)}</SourceFilename><SourceBand>{k}</SourceBand><SrcRect {whole}/><DstRect {whole}/></SimpleSource>', "  </VRTRasterBand>"]
    return "\n".join([*out, "</VRTDataset>"])
