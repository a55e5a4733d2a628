"""Missions, their bands and catalogues."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Public names of missions, bands, assets and catalogues, with native spacing in metres.
S2_BANDS = {
    "coastal": ("B01", 60),
    "blue": ("B02", 10),
    "green": ("B03", 10),
    "red": ("B04", 10),
    "rededge1": ("B05", 20),
    "rededge2": ("B06", 20),
    "rededge3": ("B07", 20),
    "nir": ("B08", 10),
    "nir08": ("B8A", 20),
    "nir09": ("B09", 60),
    "cirrus": ("B10", 60),
    "swir16": ("B11", 20),
    "swir22": ("B12", 20),
    "scl": ("SCL", 20),
    "aot": ("AOT", 10),
    "wvp": ("WVP", 10),
}
LANDSAT_ASSETS = {
    "coastal": "coastal",
    "blue": "blue",
    "green": "green",
    "red": "red",
    "nir": "nir08",
    "swir1": "swir16",
    "swir2": "swir22",
    "thermal": "lwir11",
    "qa_pixel": "qa_pixel",
    "qa_radsat": "qa_radsat",
    "qa_aerosol": "qa_aerosol",
}
OPTICAL_INDICES = ("ndvi", "ndwi", "savi", "ndmi", "nbr", "mndwi", "ndbi", "evi", "ndsi")
OPERATIONS = ("mean", "median", "min", "max", "std")
PERIODS = ("timeseries", "monthly", "annual", "all")
SOURCE_ALIASES = {"e84": "element84", "tb": "terrabyte", "pc": "planetary_computer"}
SOURCE_LABELS = {"element84": "Element84", "planetary_computer": "Planetary Computer", "terrabyte": "terrabyte", "cdse": "Copernicus"}
ENDPOINTS = {
    "element84": "https://earth-search.aws.element84.com/v1/",
    "terrabyte": "https://stac.terrabyte.lrz.de/public/api/",
    "planetary_computer": "https://planetarycomputer.microsoft.com/api/stac/v1",
    "cdse": "https://stac.dataspace.copernicus.eu/v1",
}


@dataclass(frozen=True)
class Mission:
    name: str
    alias: str
    resolution: int | None
    bands: tuple[str, ...]
    indices: tuple[str, ...] = ()
    native: dict[str, int] = field(default_factory=dict)
    class_band: str | None = None
    cloud_classes: tuple[int, ...] = ()
    gain: float = 1.0
    offset: float = 0.0
    nodata: int | None = None
    first_year: int | None = None
    collections: dict[str, str] = field(default_factory=dict)
    maskable: bool = False


MISSIONS = {
    m.name: m
    for m in (
        Mission(
            "sentinel_2_l2a", "s2", 10, tuple(b for b in S2_BANDS if b not in ("cirrus", "aot", "wvp")), (*OPTICAL_INDICES[:8], "ndre1", "ndsi"),
            {b: r for b, (_, r) in S2_BANDS.items()}, "scl", (8, 9, 10), 1e-4, 0.0, 0, 2015,
            {"element84": "sentinel-2-l2a", "terrabyte": "sentinel-2-c1-l2a", "planetary_computer": "sentinel-2-l2a", "cdse": "sentinel-2-l2a"}, True,
        ),
        Mission(
            "sentinel_2_l1c", "s2_l1c", 10, tuple(b for b in S2_BANDS if b not in ("scl", "aot", "wvp")), (*OPTICAL_INDICES[:8], "ndre1", "ndsi"),
            {b: r for b, (_, r) in S2_BANDS.items() if b not in ("scl", "aot", "wvp")}, None, (), 1e-4, -1000.0, None, 2015,
            {"element84": "sentinel-2-l1c", "cdse": "sentinel-2-l1c"}, True,
        ),
        Mission("sentinel_1_rtc", "s1", 10, ("vh", "vv"), ("vh/vv", "vv/vh", "rvi"), {"vv": 10, "vh": 10}, first_year=2014, collections={"planetary_computer": "sentinel-1-rtc"}),
        Mission(
            "landsat_c2_l2", "l_oli", 30, ("coastal", "blue", "green", "red", "nir", "swir1", "swir2", "thermal"), OPTICAL_INDICES,
            {b: 30 for b in ("coastal", "blue", "green", "red", "nir", "swir1", "swir2", "thermal", "qa_pixel")}, "qa_pixel", (1, 2, 3), 0.0000275, -0.2, None, 1982,
            {"planetary_computer": "landsat-c2-l2"}, True,
        ),
        Mission("cop_dem_glo_30", "cop_dem", None, ("dem",), native={"data": 30}, collections={"terrabyte": "cop-dem-glo-30"}),
    )
}


def mission(name: str) -> Mission:
    """By name or alias."""
    for m in MISSIONS.values():
        if name in (m.name, m.alias):
            return m
    raise ValueError(f"unknown mission {name!r}; there are {', '.join(f'{m.name} ({m.alias})' for m in MISSIONS.values())}")


def source_name(name: str) -> str:
    return SOURCE_ALIASES.get(name, name)


def endpoint(mission_name: str, source: str) -> tuple[str, str]:
    """Catalogue address and collection of a mission at a source."""
    m, s = mission(mission_name), source_name(source)
    if s not in m.collections:
        raise ValueError(f"{m.name} is not served by {source!r}; it is by {', '.join(m.collections)}")
    return ENDPOINTS[s], m.collections[s]


def band_map(mission_name: str, source: str | None = None) -> dict[str, str] | None:
    """Common band name to asset key, or None where they are the same."""
    m, s = mission(mission_name).name, source_name(source) if source else None
    if m == "sentinel_2_l2a" and s in ("terrabyte", "planetary_computer"):
        return {b: key for b, (key, _) in S2_BANDS.items() if b != "cirrus"}
    if m == "sentinel_2_l2a" and s == "cdse":
        return {b: f"{key}_{r}m" for b, (key, r) in S2_BANDS.items() if b != "cirrus"}
    if m == "sentinel_2_l1c" and s == "cdse":
        return {b: key for b, (key, _) in S2_BANDS.items() if b not in ("scl", "aot", "wvp")}
    if m == "landsat_c2_l2":
        return dict(LANDSAT_ASSETS)
    return None


def common_band(name: str) -> str:
    """A band by its common name: ``B04`` and ``b04`` are red."""
    by_key = {key.upper(): b for b, (key, _) in S2_BANDS.items()}
    return by_key.get(name.upper(), name.lower())


def rename_to_common(df: DataFrame, mission_name: str, source: str) -> DataFrame:
    assets = band_map(mission_name, source) or {}
    return df.withColumnsRenamed({v: k for k, v in assets.items() if v in df.columns})


def missions_table(spark: SparkSession) -> DataFrame:
    stats = [f"{op}_{p}" for op in OPERATIONS for p in PERIODS]
    rows = [(m.name, m.alias, m.resolution, list(m.bands), list(m.indices), list(m.collections), stats if m.indices else [], m.maskable) for m in MISSIONS.values()]
    return spark.createDataFrame(rows, "name string, alias string, default_resolution int, bands array<string>, indices array<string>, sources array<string>, stats array<string>, cloud_masking boolean")
