"""A cube: pixels, grid, scene statistics and attributes, and the tools that make one cube of another."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce as fold

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import is_categorical
from ..functions.indices import INDICES, with_indices
from ..functions.radiometry import scale_bands
from ..functions.registry import mission
from ..functions.scene import SCENE_FIELDS
from ..functions.temporal import filter_dates
from ..operators import composites, filters, joins, masks, neighbourhood, statistics, update
from ..operators.coverage import box_ring
from ..operators.grid import Grid, between, rasterize, require_same_grid, snap_bounds, utm_inverse
from ..operators.resample import reproject, reproject_nearest, reproject_weighted
from ..operators.scenes import by_footprint
from ..sources import chunks, geotiff, store
from .request import CubeRequest


@dataclass(frozen=True)
class Cube:
    """``pixels`` is wide: time, row, col and one column per band. Every tool is lazy."""

    pixels: DataFrame
    bands: tuple[str, ...]
    grid: Grid | None = None
    stats: DataFrame | None = None
    attrs: dict = field(default_factory=dict)

    def _with(self, pixels: DataFrame, **changes) -> Cube:
        return replace(self, pixels=pixels, **changes)

    def select(self, *bands: str) -> Cube:
        """Bands are chosen before any unfolding, so the scan reads no others."""
        return self._with(self.pixels.select("time", "row", "col", *bands), bands=bands)

    def long(self, *bands: str) -> DataFrame:
        """time, row, col, band, value."""
        names = bands or self.bands
        return self.pixels.select("time", "row", "col", *(F.col(b).cast("double").alias(b) for b in names)).unpivot(["time", "row", "col"], list(names), "band", "value")

    def tiled(self, size: int = 256) -> DataFrame:
        """One row per scene and block: arrays of the block's pixels in row-major order."""
        t = lambda c: F.floor(F.col(c) / size).cast("int")
        cells = F.sort_array(F.collect_list(F.struct("row", "col", *self.bands)))
        return self.pixels.groupBy("time", t("row").alias("trow"), t("col").alias("tcol")).agg(cells.alias("cells"))

    def between(self, start: str, end: str) -> Cube:
        return self._with(filter_dates(self.pixels, [(start, end)]))

    def masked(self, mission_name: str | None = None, keep_clouds: bool = False, keep_layer: bool = False) -> Cube:
        name = mission_name or self.attrs["mission"]
        out = masks.class_mask(self.pixels, name, self.bands, keep_clouds, keep_layer)
        return self._with(out, bands=tuple(b for b in self.bands if b in out.columns), attrs={**self.attrs, "cloud_status": "clouds_kept" if keep_clouds else f"{mission(name).class_band}_masked"})

    def masked_by(self, mask: DataFrame, layer: str) -> Cube:
        status = masks.masking_status(layer) or "externally_masked"
        return self._with(masks.apply_mask(self.pixels, mask, layer, self.bands), attrs={**self.attrs, "cloud_status": status})

    def scaled(self, mission_name: str | None = None, source: str | None = None, baseline: str | None = None) -> Cube:
        return self._with(scale_bands(self.pixels, self.bands, mission_name or self.attrs["mission"], source, baseline=baseline))

    def indices(self, *names: str) -> Cube:
        """Spectral bands stay first, indices go last; indices there already are computed anew."""
        names = tuple(n.lower() for n in names)
        base = self.pixels.drop(*(f"{n}" for n in names))
        return self._with(with_indices(base, names), bands=(*(b for b in self.bands if b not in names), *names))

    def scene_statistics(self, aoi_pixels: int | None = None, mission_name: str | None = None) -> Cube:
        band = mission(mission_name or self.attrs["mission"]).class_band
        cloud, imaged = masks.cloud_and_imaged(F.col(band), mission_name or self.attrs["mission"])
        n = aoi_pixels or self.grid.width * self.grid.height
        return replace(self, stats=statistics.scene_statistics(self.pixels, cloud, imaged, n))

    def cloud_filter(self, most: float) -> Cube:
        kept = filters.by_cloud(self.stats, most)
        return self._with(filters.keep_scenes(self.pixels, kept), stats=kept)

    def coverage_filter(self, least: float = 0.9) -> Cube:
        kept = filters.by_coverage(self.stats, least)
        return self._with(filters.keep_scenes(self.pixels, kept), stats=kept)

    def clip(self, aoi: DataFrame) -> Cube:
        return self._with(filters.clip_polygon(self.pixels, aoi, self.bands))

    def reproject(self, target: Grid, resampling: str = "nearest", inverse=None) -> Cube:
        """Per-scene columns are carried, not computed again."""
        if resampling == "nearest":
            out = reproject_nearest(self.pixels, self.grid, target, inverse)
        elif inverse:
            out = reproject_weighted(self.pixels, self.grid, target, self.bands, inverse, method=resampling)
        else:
            out = reproject(self.pixels, self.grid, target, self.bands, resampling)
        return self._with(out, grid=target)

    def composites(self, *stats: str) -> DataFrame:
        return composites.composites(self.pixels, self.bands, list(stats))

    def statistics(self) -> DataFrame:
        return statistics.cube_statistics(self.pixels, self.bands, self.stats)

    def updated(self, new: Cube, new_bands: Sequence[str] = ()) -> Cube:
        if self.grid and new.grid:
            require_same_grid(new.grid, self.grid)
        pixels = update.update(self.pixels, new.pixels, new_bands)
        bands = tuple(c for c in pixels.columns if c not in ("time", "row", "col"))
        order = (*(b for b in bands if b not in INDICES), *(b for b in bands if b in INDICES))
        return self._with(pixels.select("time", "row", "col", *order), bands=order)

    def write(self, path: str, **how) -> str:
        return store.write_cube(self.pixels, path, self.grid, {**self.attrs, "bands": list(self.bands)}, self.stats, **how)

    def export_images(self, path: str, **how) -> list[str]:
        """A tiled GeoTIFF with overviews for each time; class bands keep a pixel where others are averaged."""
        nearest = [b for b in self.bands if is_categorical(b)]
        return geotiff.export_geotiffs(self.pixels, path, self.grid, self.bands, nearest=nearest, **how)

    @classmethod
    def of_images(cls, spark, path: str, **options) -> Cube:
        """The GeoTIFFs of a folder, a time for each file."""
        raster = geotiff.open_raster(path)
        pixels = geotiff.read_geotiff(spark, path, **options)
        bands = tuple(c for c in pixels.columns if c not in ("layer", "time", "row", "col"))
        return cls(pixels.select("time", "row", "col", *bands), bands, raster.grid if not int(options.get("level", 0)) else None)

    @classmethod
    def open(cls, spark, path: str) -> Cube:
        pixels, grid, attrs, stats = store.open_cube(spark, path)
        bands = tuple(attrs.get("bands") or [c for c in pixels.columns if c not in ("time", "row", "col", "day", "month")])
        return cls(pixels, bands, grid, stats, attrs)


def _in_degrees(rings: list, grid: Grid) -> list:
    """Rings in the coordinates of a UTM grid, in degrees; others are taken for degrees already."""
    if not re.fullmatch(r"EPSG:32[67]\d\d", grid.crs) or all(abs(x) <= 360 and abs(y) <= 90 for ring in rings for x, y in ring):
        return rings
    zone = int(grid.crs[-2:])
    spark = SparkSession.active()
    rows = [(k, j, float(x), float(y)) for k, ring in enumerate(rings) for j, (x, y) in enumerate(ring)]
    lon, lat = utm_inverse(F.col("x"), F.col("y"), zone, grid.crs[6] == "7")
    out: list = [[] for _ in rings]
    for p in spark.createDataFrame(rows, "k int, j int, x double, y double").select("k", "j", lon.alias("lon"), lat.alias("lat")).orderBy("k", "j").collect():
        out[p["k"]].append((p["lon"], p["lat"]))
    return out


def _of_request(rows: DataFrame, r: CubeRequest, scenes: DataFrame | None, grid: Grid) -> DataFrame:
    """Pixels of the dates and scenes asked for. What the catalogue tells is taken from ``scenes``: datetime, and as
    asked cloud_cover, geometry and solar_day."""
    rows = filter_dates(rows, r.windows)
    if r.dates:
        wanted = rows.sparkSession.createDataFrame([(d,) for d in r.dates], "d string").select(F.to_timestamp_ntz("d").alias("time"))
        rows = filters.require_rows(filters.keep_dates(rows, wanted), "no scene is left of the dates asked for")
    if r.max_cc is not None or r.min_footprint_coverage is not None:
        kept = filters.cloud_cover(scenes, r.max_cc)
        if r.min_footprint_coverage is not None:
            rings = _in_degrees(r.rings, grid)
            if not r.clip_raster:  # the cube is the polygon's box
                x, y = zip(*(p for ring in rings for p in ring), strict=True)
                rings = [box_ring((min(x), min(y), max(x), max(y)))]
            kept = by_footprint(kept, rings, r.min_footprint_coverage)
        rows = filters.keep_dates(rows, kept.select(F.col("datetime").alias("time")))
    return rows


def _with_baseline(rows: DataFrame, scenes: DataFrame) -> DataFrame:
    """Each time's processing baseline: that of the scene nearest in time."""
    known = scenes.filter("baseline is not null").select(F.col("datetime").alias("time"), "baseline")
    times = joins.asof_nearest(rows.select("time").distinct(), known, "baseline")
    return rows.join(times.withColumn("baseline", F.coalesce("baseline", F.raise_error(F.lit("no scene has a baseline")).cast("double"))), "time")


def _needs_scenes(r: CubeRequest, columns: Sequence[str]) -> list[str]:
    asked = {
        "max_cc": r.max_cc is not None, "min_footprint_coverage": r.min_footprint_coverage is not None, "scene_metadata": bool(r.scene_metadata),
        "shadow_masking": r.shadow_masking, "the baselines of sentinel_2_l1c": r.mission == "sentinel_2_l1c" and "baseline" not in columns,
    }
    return [name for name, wanted in asked.items() if wanted]


def _target(r: CubeRequest, grid: Grid) -> Grid | None:
    """The grid asked for, if it is another than the pixels': the same extent, snapped outward to whole pixels."""
    crs, res = r.crs or grid.crs, r.resolution or abs(grid.a)
    if (crs, res) == (grid.crs, abs(grid.a)):
        return None
    move, bounds = between(grid.crs, crs), grid.bounds
    if move:
        spark = SparkSession.active()
        left, bottom, right, top = bounds
        t = [k / 50 for k in range(51)]
        edge = [(left + k * (right - left), y) for k in t for y in (bottom, top)] + [(x, bottom + k * (top - bottom)) for k in t for x in (left, right)]
        x, y = move(F.col("x"), F.col("y"))
        bounds = tuple(spark.createDataFrame(edge, "x double, y double").agg(F.min(x), F.min(y), F.max(x), F.max(y)).first())
    return Grid.covering(crs, snap_bounds(bounds, res), res)


def _bands(r: CubeRequest, columns: Sequence[str]) -> list[str]:
    """The bands asked for, all of which the pixels must have; if the mission's whole list is asked for, those there are."""
    bands = [b for b in r.bands if b in columns]
    lacking = [b for b in r.bands if b not in columns]
    if lacking and (not bands or set(r.bands) != set(mission(r.mission).bands)):
        raise ValueError(f"the pixels have no band {', '.join(lacking)}")
    return bands


def _day_mosaic(rows: DataFrame, names: Sequence[str], order, keys: Sequence[str]) -> DataFrame:
    """One pixel per day and place: the first value of each band by ``order``, else by time and then by the values."""
    order = F.struct("time", *names) if order is None else order
    day = F.to_date("time").cast("timestamp_ntz")
    return composites.solar_day_mosaic(rows.withColumn("__order", order).withColumn("time", day), names, F.col("__order"), keys)


def build(request: CubeRequest, pixels: DataFrame, grid: Grid, order=None, scenes: DataFrame | None = None) -> tuple[Cube | None, DataFrame | None]:
    """A cube of raw pixels (time, row, col, bands, the class band) and its composites. Every field of the request is
    heeded or refused: what the catalogue alone knows (cloud cover, footprints, sun azimuths, baselines, metadata) needs
    ``scenes``, a table of the scenes with datetime and those columns.

    The day mosaic takes the first value by ``order``; without one, of the earliest time, and of equal times the least.
    The order of steps is fixed: scenes and dates, day mosaic (unless tiles stay separate), grid, polygon's extent, class mask,
    scaling, shadows, indices, statistics, coverage, cloud filter, clip, update, composites, files. Without
    ``keep_timeseries`` there is no cube, only composites. Statistics, the mosaic, shadows and composites shuffle; the
    rest are projections in one stage."""
    r = request.checked()
    m = mission(r.mission)
    if scenes is None and (lacking := _needs_scenes(r, pixels.columns)):
        raise ValueError(f"{', '.join(lacking)} needs the table of scenes")
    bands = _bands(r, pixels.columns)
    if m.class_band not in pixels.columns and (lacking := [n for n in ("cloud_masking", "scene_cloud_coverage", "metadata_output") if getattr(r, n) not in (None, False)] + ["partial_scene_handling"] * (r.partial_scene_handling == "remove")):
        raise ValueError(f"{', '.join(lacking)} needs the class band {m.class_band or ''}, which the pixels lack")
    rows = _of_request(pixels, r, scenes, grid)
    if r.update:
        old = Cube.open(pixels.sparkSession, r.update)
        store.require_time_series(old.attrs, old.pixels.columns)
        added = [b for b in bands if b not in old.bands]
        if not added:  # only days that are not there are masked, scaled and counted
            rows = filters.new_dates(rows, old.pixels)
    if r.mission == "sentinel_2_l1c" and "baseline" not in rows.columns:
        rows = _with_baseline(rows, scenes)
    carried = [m.class_band] if m.class_band and m.class_band in rows.columns and m.class_band not in bands else []
    base = ["baseline"] if r.mission == "sentinel_2_l1c" else []
    borrowed = ["nir"] if r.shadow_masking and "nir" not in bands else []
    if r.shadow_masking and not {"nir", m.class_band} <= set(rows.columns):
        raise ValueError(f"shadow_masking needs nir and {m.class_band}")
    names = [*bands, *carried, *base, *borrowed]
    if r.tile_handling == "mosaic":
        rows = _day_mosaic(rows, names, order, ("time", "row", "col"))
    rows = rows.select("time", "row", "col", *names)
    if target := _target(r, grid):
        nearest = [*carried, *base]
        moved = reproject(rows.drop(*base), grid, target, [n for n in names if n not in base], r.resampling_method)
        rows = moved.join(rows.groupBy("time").agg(*(F.first(b).alias(b) for b in nearest if b in base)), "time") if base else moved
        grid = target
    if r.polygon is not None:
        x, y = zip(*(p for ring in r.rings for p in ring), strict=True)
        rows = filters.clip_bbox(rows, grid, (min(x), min(y), max(x), max(y)))
    attrs = {"mission": r.mission, "stac_api": r.source, "spectral_bands": bands, "indices": list(r.indices or ()), "resampling": r.resampling_method, "tile_handling": r.tile_handling, "partial_scene_handling": r.partial_scene_handling, "cloud_status": "not_masked"}
    cube = Cube(rows, tuple([*bands, *carried, *borrowed]), grid, None, attrs)
    aoi = rasterize(rows.sparkSession, grid, r.rings) if r.clip_raster else None
    if m.class_band in cube.pixels.columns and (r.scene_cloud_coverage is not None or r.partial_scene_handling == "remove" or r.cloud_masking or r.scene_metadata or r.metadata_output):
        inside = cube
        if aoi is not None:  # pixels of the area only, both counted and counted against
            inside = cube._with(cube.pixels.join(aoi.filter("inside").select("row", "col"), ["row", "col"], "left_semi"))
        cube = replace(cube, stats=inside.scene_statistics(aoi.filter("inside").count() if aoi is not None else None).stats)
    raw = cube.pixels
    if r.cloud_mask_output:
        store.write_cube(masks.scl_mask(raw, r.mission), r.cloud_mask_output, grid, {"mission": r.mission, "bands": ["cloud_mask_scl"]})
    if r.cloud_masking:
        cube = cube.masked(keep_clouds=r.keep_clouds, keep_layer=m.class_band in bands)
    elif carried:
        cube = replace(cube, pixels=cube.pixels.drop(*carried), bands=tuple(b for b in cube.bands if b not in carried))
    cube = cube.scaled(source=r.source, baseline="baseline" if base else None)
    if r.shadow_masking:
        cube = _without_shadows(cube, raw, scenes, r)
    cube = replace(cube, pixels=cube.pixels.drop(*base, *borrowed), bands=tuple(b for b in cube.bands if b not in borrowed))
    if r.indices:
        cube = cube.indices(*r.indices)
    if r.partial_scene_handling == "remove":
        cube = cube.coverage_filter(r.min_scene_coverage)
    if r.scene_cloud_coverage is not None:
        cube = cube.cloud_filter(r.scene_cloud_coverage)
    if aoi is not None:
        cube = cube.clip(aoi)
    if r.scene_metadata:
        cube = _with_metadata(cube, scenes, r)
    if r.update:
        cube = _updated(old, cube, r, added)
    layers = _layers(cube, r)
    if r.output:
        _export(cube, layers, r)
    if r.metadata_output:
        cube.stats.write.mode("overwrite").parquet(r.metadata_output)
    return (cube if r.keep_timeseries else None), layers


def _updated(old: Cube, new: Cube, r: CubeRequest, added: Sequence[str]) -> Cube:
    """The stored cube with the days or bands of ``new``. Without an output of its own the update is made in place: days
    touch only the files of their months, if both sides have the same columns."""
    columns = lambda c: set(c.pixels.columns) - {"day", "month"}
    if r.output or added or columns(old) != columns(new):
        cube = replace(old, pixels=old.pixels.drop("day", "month")).updated(new, [b for b in new.bands if b not in old.bands])
        if not r.output:
            cube.write(r.update)
            return Cube.open(cube.pixels.sparkSession, r.update)
        return cube
    if old.grid and new.grid:
        require_same_grid(new.grid, old.grid)
    stats = None
    if new.stats is not None and old.stats is not None and set(new.stats.columns) == set(old.stats.columns):
        stats = old.stats.unionByName(new.stats)
    store.merge_days(new.pixels, r.update, stats=stats, compression="zstd" if r.compress else "snappy")
    return Cube.open(new.pixels.sparkSession, r.update)


def _without_shadows(cube: Cube, raw: DataFrame, scenes: DataFrame, r: CubeRequest) -> Cube:
    """Cloud shadows masked too, found on reflectance before clouds were masked, from the class band's clouds and the
    sun's azimuth of the day."""
    azimuths = scenes.groupBy(F.to_date("datetime").alias("day")).agg(F.avg("sun_azimuth").alias("sun_azimuth"))
    cloud, _ = masks.cloud_and_imaged(F.col(mission(r.mission).class_band), r.mission)
    clouds = neighbourhood.with_azimuth(raw.filter(cloud).select("time", "row", "col"), azimuths)
    nir = Cube(raw, ("nir",), cube.grid, None, cube.attrs).scaled(source=r.source).pixels
    shadows = neighbourhood.detect_shadows(nir, clouds, cube.grid, r.shadow_proj_distance * 1000, 100.0, r.nir_dark_threshold)
    marked = cube.pixels.join(shadows.withColumn("__shadow", F.lit(True)), ["time", "row", "col"], "left")
    out = masks.masked(marked, [b for b in cube.bands if not is_categorical(b)], F.coalesce("__shadow", F.lit(False))).drop("__shadow")
    return replace(cube, pixels=out, attrs={**cube.attrs, "cloud_status": "cloudshadow_masked_scl"})


def _with_metadata(cube: Cube, scenes: DataFrame, r: CubeRequest) -> Cube:
    """Per-scene columns from the catalogue, by UTC day."""
    if bad := [f for f in r.scene_metadata if f not in SCENE_FIELDS and f not in scenes.columns]:
        raise ValueError(f"scenes have no {', '.join(bad)}")
    fields = {f: (F.col(f), SCENE_FIELDS[f][1] if f in SCENE_FIELDS else "first") for f in r.scene_metadata}
    daily = joins.daily_metadata(scenes, fields, F.to_date("datetime"))
    stats = cube.stats if cube.stats is not None else cube.pixels.select("time").distinct()
    return replace(cube, stats=joins.attach_daily(stats, daily))


def _layers(cube: Cube, r: CubeRequest, by: Sequence[str] = ()) -> DataFrame | None:
    """All composites asked for, one under the other: (layer, row, col, bands)."""
    tokens = [*r.tokens, *([r.aggregator] if r.aggregator else [])]
    parts = [composites.composites(cube.pixels, cube.bands, tokens, by=by)] if tokens else []
    for spec in r.custom:
        parts.append(composites.custom_composite(cube.pixels, cube.bands, spec, by=by).drop("n_dates"))
    return fold(DataFrame.unionByName, parts) if parts else None


def _export(cube: Cube, layers: DataFrame | None, r: CubeRequest) -> None:
    """Files beside each other: the cube (or only its composites), the request, the statistics, a band list for maps."""
    how = {"compression": "zstd" if r.compress else "snappy"}
    fmt = r.export_format or "parquet"
    if fmt == "csv":
        table = cube.pixels if r.keep_timeseries else layers
        table.write.mode("overwrite").option("header", True).option("compression", "gzip" if r.compress else "none").csv(r.output)
    elif fmt == "geotiff":
        _export_images(cube, layers, r, r.output)
    elif fmt == "zarr":
        if not r.keep_timeseries:
            raise ValueError("a chunk store holds a time series")
        chunks.write_zarr(cube.pixels, r.output, cube.grid, cube.bands, attrs=cube.attrs)
        if layers is not None:
            layers.write.mode("overwrite").option("compression", how["compression"]).parquet(f"{r.output}_composites")
    elif r.keep_timeseries:
        cube.write(r.output, **how)
        if layers is not None:
            layers.write.mode("overwrite").option("compression", how["compression"]).parquet(f"{r.output}_composites")
    else:
        names = [x["layer"] for x in layers.select("layer").distinct().orderBy("layer").collect()]
        store.write_cube(layers, r.output, cube.grid, {**cube.attrs, "bands": list(cube.bands), "time_series": False, "layers": names}, **how)
    if r.export_settings:
        store.write_settings(r.output, json.loads(r.to_json())["parameters"])
    if r.statistics_csv:
        store.write_statistics_csv(cube.statistics(), store.sidecar(r.output, "_statistics.csv"))
    if r.vrt:
        folder = r.output if fmt == "geotiff" else f"{r.output}_images"
        images = _export_images(cube, layers, r, folder) if fmt != "geotiff" else store.Files(cube.pixels.sparkSession, folder).names(folder)
        listed = [(name.removesuffix(".tif"), f"{folder.rpartition('/')[2]}/{name}") for name in sorted(images) if name.endswith(".tif")]
        store.Files(cube.pixels.sparkSession, r.output).write(f"{r.output}.vrt", store.vrt(listed, cube.grid, store.band_order(cube.bands), nodata=-9999.0))


def _export_images(cube: Cube, layers: DataFrame | None, r: CubeRequest, path: str) -> list[str]:
    """Images of the time series, by date, and of the composites, by name, in one folder."""
    parts = []
    if r.keep_timeseries:
        parts.append(cube.pixels.withColumn("file", geotiff.file_name("time")))
    if layers is not None:
        parts.append(layers.withColumn("file", geotiff.file_name("layer")))
    rows = fold(DataFrame.unionByName, [p.select("file", "row", "col", *cube.bands) for p in parts])
    return geotiff.export_geotiffs(rows, path, cube.grid, cube.bands, key="file", nearest=[b for b in cube.bands if is_categorical(b)])


def build_features(request: CubeRequest, pixels: DataFrame, grid: Grid, feature: str = "feature_id", order=None) -> DataFrame:
    """Composites of many areas at once, (feature, layer, row, col, bands): the feature is one more key of the same
    aggregations, not a loop. Dates, day mosaics, masks, coverage and cloud filters hold for each area by itself."""
    r = request.checked()
    m = mission(r.mission)
    if refused := [n for n in ("polygon", "max_cc", "min_footprint_coverage", "shadow_masking", "scene_metadata", "crs", "update", "output") if getattr(r, n)]:
        raise ValueError(f"many areas at once do without {', '.join(refused)}")
    rows = _of_request(pixels, r, None, grid)
    bands = [b for b in _bands(r, rows.columns) if b != m.class_band]
    carried = [m.class_band] if m.class_band in rows.columns else []
    keys = (feature, "time", "row", "col")
    if r.tile_handling == "mosaic":
        rows = _day_mosaic(rows, [*bands, *carried], order, keys)
    rows = rows.select(*keys, *bands, *carried)
    kept = None
    if r.scene_cloud_coverage is not None or r.partial_scene_handling == "remove":
        cloud, imaged = masks.cloud_and_imaged(F.col(m.class_band), r.mission)
        kept = statistics.scene_statistics(rows, cloud, imaged, grid.width * grid.height, (feature, "time"))
        kept = filters.by_cloud(kept, r.scene_cloud_coverage)
        kept = filters.by_coverage(kept, r.min_scene_coverage) if r.partial_scene_handling == "remove" else kept
    if r.cloud_masking:
        rows = masks.class_mask(rows, r.mission, bands, r.keep_clouds)
    if kept is not None:
        rows = filters.keep_scenes(rows, kept, (feature, "time"))
    rows = with_indices(scale_bands(rows, bands, r.mission, r.source), list(r.indices or ()))
    cube = Cube(rows, (*bands, *(i.lower() for i in r.indices or ())), grid)
    return _layers(cube, r if r.stats or r.aggregator else replace(r, stats=["mean"]), by=(feature,))
