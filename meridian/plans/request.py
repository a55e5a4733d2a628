"""What a cube is asked to be: a typed request, read from and written to JSON, refused before any scan if it cannot be."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import SparkSession

from ..functions.registry import common_band, endpoint, mission, source_name
from ..functions.temporal import Window, parse_daterange
from ..operators.composites import Custom, parse_requests
from ..operators.grid import validate_crs
from ..sources.store import validate_format


def _text_of(path: str) -> str:
    """Through Spark's file systems where a session is there, else a local file."""
    from ..sources.store import Files

    spark = SparkSession.getActiveSession()
    return Files(spark, path).read(path) if spark else Path(path).read_text()


@dataclass
class CubeRequest:
    mission: str
    polygon: object = None
    resolution: float | None = None
    daterange: object = None
    dates: Sequence[str] | None = None
    bands: Sequence[str] | None = None
    indices: Sequence[str] | None = None
    source: str = "element84"
    max_cc: float | None = None
    scene_cloud_coverage: float | None = None
    cloud_masking: bool = False
    keep_clouds: bool = False
    shadow_masking: bool = False
    nir_dark_threshold: float = 0.18
    shadow_proj_distance: float = 1.0
    clip_raster: bool = False
    tile_handling: str = "mosaic"
    partial_scene_handling: str = "keep"
    min_scene_coverage: float = 0.9
    min_footprint_coverage: float | None = None
    resampling_method: str = "nearest"
    scene_metadata: Sequence[str] | None = None
    aggregator: str | None = None
    stats: Sequence[str] | None = None
    keep_timeseries: bool = True
    crs: str | None = None
    output: str | None = None
    export_format: str | None = None
    export_settings: bool = False
    statistics_csv: bool = False
    compress: bool = False
    vrt: bool = False
    update: str | None = None
    cloud_mask_output: str | None = None
    metadata_output: str | None = None

    @classmethod
    def from_json(cls, text_or_path: str) -> CubeRequest:
        text = text_or_path if text_or_path.lstrip().startswith("{") else _text_of(text_or_path)
        given = json.loads(text)["parameters"]
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(given) - known):
            raise ValueError(f"unknown parameters: {', '.join(unknown)}")
        return cls(**given).checked()

    def to_json(self) -> str:
        from ..sources.store import jsonable

        return json.dumps({"parameters": jsonable(asdict(self))}, indent=2)

    @property
    def windows(self) -> list[Window]:
        return parse_daterange(self.daterange, mission(self.mission).name)

    @property
    def tokens(self) -> list[str]:
        """Composites asked for by name."""
        return [t for t in self.stats or () if isinstance(t, str)]

    @property
    def custom(self) -> list[Custom]:
        """Composites of a window or season of their own: objects with op, start, end and, if wanted, years and name."""
        return [Custom(**{**c, "years": tuple(c.get("years") or ())}) for c in self.stats or () if isinstance(c, dict)]

    @property
    def rings(self) -> list[list[tuple[float, float]]]:
        """The polygon in the coordinates of the grid: a box (left, bottom, right, top), a ring of points, or rings."""
        p = self.polygon
        try:
            if len(p) == 4 and all(isinstance(v, (int, float)) for v in p):
                left, bottom, right, top = map(float, p)
                return [[(left, bottom), (right, bottom), (right, top), (left, top)]]
            rings = [p] if len(p[0]) == 2 and isinstance(p[0][0], (int, float)) else p
            return [[(float(x), float(y)) for x, y in ring] for ring in rings]
        except (TypeError, ValueError, KeyError, IndexError) as e:
            raise ValueError("a polygon is a box, a ring of points or several rings, in the coordinates of the grid") from e

    def checked(self) -> CubeRequest:
        """Self, with names resolved; ValueError says what cannot be."""
        m = mission(self.mission)
        self.mission, self.source = m.name, source_name(self.source)
        if self.update is None:
            endpoint(self.mission, self.source)
        self.bands = [common_band(b) for b in self.bands] if self.bands else list(m.bands)
        known = set(m.bands) | set(m.native)
        if bad := [b for b in self.bands if b not in known]:
            raise ValueError(f"{m.name} has no band {', '.join(bad)}; it has {', '.join(m.bands)}")
        if bad := [i for i in self.indices or () if i.lower() not in m.indices]:
            raise ValueError(f"{m.name} has no index {', '.join(bad)}; it has {', '.join(m.indices) or 'none'}")
        self.resolution = self.resolution or m.resolution
        if self.resolution is None or not self.resolution > 0:
            raise ValueError("a resolution above 0 is needed")
        for name in ("max_cc", "scene_cloud_coverage"):
            v = getattr(self, name)
            if v is not None and not 0 <= v <= 100:
                raise ValueError(f"{name} is a percentage")
        for name in ("min_scene_coverage", "min_footprint_coverage"):
            v = getattr(self, name)
            if v is not None and not 0 <= v <= 1:
                raise ValueError(f"{name} is a share from 0 to 1")
        if self.tile_handling not in ("mosaic", "separate"):
            raise ValueError("tile_handling is mosaic or separate")
        if self.partial_scene_handling not in ("keep", "remove"):
            raise ValueError("partial_scene_handling is keep or remove")
        if self.resampling_method not in ("nearest", "bilinear", "cubic"):
            raise ValueError("resampling_method is nearest, bilinear or cubic")
        if self.cloud_masking and not m.maskable:
            raise ValueError(f"{m.name} cannot be masked")
        if self.keep_clouds and not self.cloud_masking:
            raise ValueError("keep_clouds goes with cloud_masking")
        if self.shadow_masking and not (self.cloud_masking and m.name == "sentinel_2_l2a"):
            raise ValueError("shadow_masking goes with cloud_masking of sentinel_2_l2a")
        if self.scene_cloud_coverage is not None and not m.maskable:
            raise ValueError(f"{m.name} has no cloud percentage")
        if self.aggregator not in (None, "mean", "median"):
            raise ValueError("aggregator is mean or median")
        if self.stats:
            self.stats = [self.stats] if isinstance(self.stats, (str, dict)) else list(self.stats)
            parse_requests(self.tokens)
            names = [c.base for c in self.custom]
            if len(set(names)) < len(names):
                raise ValueError(f"two composites are named alike: {', '.join(sorted(names))}")
        if self.polygon is not None:
            self.rings  # noqa: B018  raises if it is none
        if self.clip_raster and self.polygon is None:
            raise ValueError("clip_raster needs a polygon")
        if self.min_footprint_coverage is not None and self.polygon is None:
            raise ValueError("min_footprint_coverage needs a polygon")
        if self.cloud_mask_output and not self.cloud_masking:
            raise ValueError("cloud_mask_output goes with cloud_masking")
        if not self.keep_timeseries and not (self.stats or self.aggregator):
            raise ValueError("without the time series there must be a composite")
        if self.update and self.daterange is None and self.dates is None and not self.bands:
            raise ValueError("an update has new dates or bands")
        if self.crs:
            self.crs = validate_crs(self.crs)
        if self.output:
            validate_format(self.output, self.export_format)
        elif self.export_settings or self.statistics_csv or self.vrt:
            raise ValueError("sidecars need an output")
        self.windows  # noqa: B018  raises if it is no date range
        return self
