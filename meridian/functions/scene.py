"""Typed columns from scene properties, whatever dialect a catalogue writes them in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prop(p: Column, *names: str) -> Column:
    """The first of the properties that is there."""
    return F.coalesce(*(F.try_element_at(p, F.lit(n)) for n in names))


def number(p: Column, *names: str) -> Column:
    return prop(p, *names).try_cast("double")


def view_azimuth(p: Column) -> Column:
    return number(p, "view:azimuth")


def sun_azimuth(p: Column) -> Column:
    return number(p, "view:sun_azimuth", "s2:mean_solar_azimuth")


def sun_elevation(p: Column) -> Column:
    return F.coalesce(number(p, "view:sun_elevation"), 90 - number(p, "s2:mean_solar_zenith"))


def incidence_angle(p: Column) -> Column:
    return number(p, "view:incidence_angle")


def relative_orbit(p: Column) -> Column:
    named = F.nullif(F.regexp_extract(F.coalesce(prop(p, "s2:product_uri"), F.lit("")), r"_R(\d{3})_", 1), F.lit(""))
    return F.coalesce(prop(p, "sat:relative_orbit").try_cast("int"), named.try_cast("int"))


def baseline(p: Column) -> Column:
    return number(p, "s2:processing_baseline", "processing:version")


def tile(p: Column) -> Column:
    """MGRS tile, Landsat path/row, or ``unknown``."""
    zone = prop(p, "mgrs:utm_zone")
    mgrs = F.when(zone.isNotNull(), F.concat(F.lpad(zone, 2, "0"), F.coalesce(prop(p, "mgrs:latitude_band"), F.lit("")), F.coalesce(prop(p, "mgrs:grid_square"), F.lit(""))))
    wrs = F.concat(prop(p, "landsat:wrs_path"), F.lit("/"), prop(p, "landsat:wrs_row"))
    return F.coalesce(mgrs, prop(p, "s2:mgrs_tile"), F.replace(prop(p, "grid:code"), F.lit("MGRS-"), F.lit("")), wrs, F.lit("unknown"))


def epsg(code: Column) -> Column:
    """``EPSG:<code>`` of a bare or prefixed code."""
    bare = F.regexp_extract(F.trim(code), r"(?i)^(?:epsg:)?\s*(\d+)$", 1)
    return F.when(bare != "", F.concat(F.lit("EPSG:"), bare)).otherwise(F.trim(code))


def utm_of_tile(t: Column) -> Column:
    """Zone and hemisphere of an MGRS tile: bands from N on are north."""
    zone, band = F.regexp_extract(t, r"^(\d{1,2})([C-X])", 1), F.regexp_extract(t, r"^(\d{1,2})([C-X])", 2)
    return F.when(zone != "", F.concat(F.lit("EPSG:"), F.when(band >= "N", F.lit("326")).otherwise(F.lit("327")), F.lpad(zone, 2, "0")))


def crs(p: Column) -> Column:
    return F.coalesce(epsg(prop(p, "proj:code", "proj:epsg")), utm_of_tile(tile(p)))


def granule(p: Column) -> Column:
    """What stays the same when a granule is processed again: tile and the datastrip's sensing time."""
    strip = F.regexp_extract(F.coalesce(prop(p, "s2:datastrip_id", "eopf:datastrip_id"), F.lit("")), r"_S(\d{8}T\d{6})", 1)
    return F.struct(tile(p).alias("tile"), F.when(strip != "", strip).otherwise(F.coalesce(prop(p, "datetime"), F.lit(""))).alias("sensed"))


def orbit_label(p: Column) -> Column:
    number_ = relative_orbit(p)
    return F.coalesce(number_.cast("string"), prop(p, "sat:orbit_state"), F.lit("unknown"))


def orbit_order(label: Column) -> Column:
    """Numbers by value, then names, then unknown."""
    n = label.try_cast("int")
    return F.struct(F.when(n.isNotNull(), 0).when(label != "unknown", 1).otherwise(2).alias("kind"), F.coalesce(n, F.lit(0)).alias("n"), label.alias("name"))


def longitude(ring: Column) -> Column:
    """Middle of a ring's extent; ring: array of struct(x, y)."""
    return (F.array_min(F.transform(ring, lambda q: q["x"])) + F.array_max(F.transform(ring, lambda q: q["x"]))) / 2


SCENE_FIELDS = {
    "view_azimuth": (view_azimuth, "avg"),
    "sun_azimuth": (sun_azimuth, "avg"),
    "sun_elevation": (sun_elevation, "avg"),
    "incidence_angle": (incidence_angle, "avg"),
    "relative_orbit": (relative_orbit, "first"),
    "processing_baseline": (baseline, "first"),
}
