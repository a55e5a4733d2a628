"""Spatial mosaics of cubes: placement on a union grid, combination by priority or statistic, provenance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce as fold

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import Grid, between_arrays
from .resample import reproject

OVERLAPS = ("first", "mean", "median", "min", "max")
#: Fractions of a pixel within which two grids are in phase.
PHASE_TOLERANCE = 0.01


@dataclass(frozen=True)
class Piece:
    pixels: DataFrame
    grid: Grid
    name: str
    bands: tuple[str, ...]
    attrs: dict | None = None


def union_grid(pieces: Sequence[Piece]) -> Grid:
    """Largest area's system, finest pixel, phase of the largest cube in that system."""
    area: dict[str, float] = {}
    for p in pieces:
        left, bottom, right, top = p.grid.bounds
        area[p.grid.crs] = area.get(p.grid.crs, 0) + (right - left) * (top - bottom)
    crs = max(area, key=lambda c: (area[c], c))
    mine = [p.grid for p in pieces if p.grid.crs == crs]
    fine = min(mine, key=lambda g: abs(g.a))
    big = max((g for g in mine if abs(g.a) == abs(fine.a)), key=lambda g: g.width * g.height)
    bounds = [g.bounds for g in mine]
    res = abs(big.a)
    left, top = big.c, big.f
    lo_x, hi_y = min(b[0] for b in bounds), max(b[3] for b in bounds)
    hi_x, lo_y = max(b[2] for b in bounds), min(b[1] for b in bounds)
    tol = PHASE_TOLERANCE
    import math

    c = left - math.ceil((left - lo_x) / res - tol) * res
    f = top + math.ceil((hi_y - top) / res - tol) * res
    return Grid(crs, res, -res, c, f, math.ceil((hi_x - c) / res - tol), math.ceil((f - lo_y) / res - tol))


def offsets(grid: Grid, onto: Grid) -> tuple[int, int]:
    """Rows and columns by which a cube moves; an error if the grids are not in phase."""
    if grid.crs != onto.crs or abs(grid.a - onto.a) > 1e-9 or abs(grid.e - onto.e) > 1e-9:
        raise ValueError(f"{grid.crs} {grid.a} is on another grid than {onto.crs} {onto.a}; reproject it first")
    dc, dr = (grid.c - onto.c) / onto.a, (grid.f - onto.f) / onto.e
    if abs(dc - round(dc)) > PHASE_TOLERANCE or abs(dr - round(dr)) > PHASE_TOLERANCE:
        raise ValueError(f"the grids are {dr - round(dr):.3f}, {dc - round(dc):.3f} pixels out of phase; resample first")
    return round(dr), round(dc)


def place(pieces: Sequence[Piece], onto: Grid) -> DataFrame:
    """All pieces on one grid by moving row and column, with their priority (1 is first)."""
    out = []
    bands = sorted({b for p in pieces for b in p.bands}, key=lambda b: [b in p.bands for p in pieces].index(True))
    for k, p in enumerate(pieces, 1):
        dr, dc = offsets(p.grid, onto)
        cols = [F.col(b) if b in p.bands else F.lit(None).cast("double").alias(b) for b in bands]
        out.append(p.pixels.select("time", (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), *cols, F.lit(k).alias("priority")))
    return fold(DataFrame.unionByName, out)


def combine(placed: DataFrame, bands: Sequence[str], overlap: str = "first", keys: Sequence[str] = ("time", "row", "col")) -> DataFrame:
    """One pixel of all that overlap; missing values never win."""
    if overlap not in OVERLAPS:
        raise ValueError(f"overlap is one of {', '.join(OVERLAPS)}")
    if overlap == "first":
        agg = [F.min_by(b, F.when(F.col(b).isNotNull(), F.col("priority"))).alias(b) for b in bands]
    else:
        how = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}[overlap]
        agg = [how(b).alias(b) for b in bands]
    return placed.groupBy(*keys).agg(*agg)


def source_map(placed: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("time", "row", "col")) -> DataFrame:
    """First source with any band (0: none) and how many sources have one."""
    valid = F.lit(False)
    for b in bands:
        valid = valid | F.col(b).isNotNull()
    mine = F.when(valid, F.col("priority"))
    return placed.groupBy(*keys).agg(F.coalesce(F.min(mine), F.lit(0)).alias("source"), F.count_distinct(mine).alias("n_sources"))


def overlap_report(placed: DataFrame, band: str, max_pairs: int = 50) -> DataFrame:
    """Of each pair of pieces, on the first date on which they share a pixel: shared pixels, mean and largest difference
    of a band. Pixels are shuffled once: the pieces of a pixel are gathered in its row (as many as overlap there), and
    pairs within it are reduced by date before they move. No table is joined with itself."""
    v = placed.filter(F.col(band).isNotNull()).select("time", "row", "col", F.struct(F.col("priority").alias("p"), F.col(band).alias("v")).alias("s"))
    pixel = v.groupBy("time", "row", "col").agg(F.sort_array(F.collect_list("s")).alias("all")).filter(F.size("all") > 1)
    couples = F.transform("all", lambda a: F.transform(F.filter("all", lambda b: b["p"] > a["p"]), lambda b: F.struct(a["p"].alias("p"), b["p"].alias("q"), F.abs(a["v"] - b["v"]).alias("gap"))))
    pairs = pixel.select("time", F.inline(F.flatten(couples)))
    per = pairs.groupBy("p", "q", "time").agg(F.count(F.lit(1)).alias("shared"), F.avg("gap").alias("mean_diff"), F.max("gap").alias("max_diff"))
    first = per.groupBy("p", "q").agg(F.min_by(F.struct("time", "shared", "mean_diff", "max_diff"), "time").alias("s"))
    return first.select("p", "q", "s.*").orderBy("p", "q").limit(max_pairs)


HARD, SOFT = ("mission", "cloud_status"), ("stac_api", "resampling", "tile_handling", "partial_scene_handling", "spectral_bands", "indices")


def check_compatible(pieces: Sequence[Piece], strict: bool = True) -> list[str]:
    """Differences that may be reported; those of mission and masking are errors."""
    said = []
    for name in (*HARD, *SOFT):
        values = {repr((p.attrs or {}).get(name)) for p in pieces}
        if len(values) > 1:
            if name in HARD and strict:
                raise ValueError(f"{name} differs: {', '.join(sorted(values))}")
            said.append(f"{name} differs: {', '.join(sorted(values))}")
    return said


def layer_report(cubes: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """Layers that all cubes have, and those that only some have."""
    sets = [set(v) for v in cubes.values()]
    common = set.intersection(*sets)
    return {"common": sorted(common), "only_some": sorted(set.union(*sets) - common)}


def layer_table(layers: DataFrame, cube: str = "cube", layer: str = "layer") -> DataFrame:
    """``layer_report`` of a table of cubes and their layers: (layer, cubes, kind), kind common or only_some."""
    whole = layers.agg(F.count_distinct(cube).alias("__all"))
    per = layers.groupBy(layer).agg(F.count_distinct(cube).alias("cubes"))
    return per.join(F.broadcast(whole), F.lit(True)).select(layer, "cubes", F.when(F.col("cubes") == F.col("__all"), "common").otherwise("only_some").alias("kind"))


def target_grid(pieces: Sequence[Piece], crs: str | None = None, resolution: float | None = None) -> Grid:
    """``union_grid``; with a system or pixel size of its own, the extent of all pieces in it, on whole pixels."""
    if crs is None and resolution is None and len({p.grid.crs for p in pieces}) == 1:
        return union_grid(pieces)
    base = union_grid(pieces)
    crs, res = crs or base.crs, resolution or abs(base.a)
    phase = base if (crs, res) == (base.crs, abs(base.a)) else None
    bounds = []
    for p in pieces:
        left, bottom, right, top = p.grid.bounds
        t = np.linspace(0, 1, 101)
        x, y = left + t * (right - left), bottom + t * (top - bottom)
        edge = np.concatenate((x, x, np.full(101, left), np.full(101, right))), np.concatenate((np.full(101, bottom), np.full(101, top), y, y))
        e, n = between_arrays(p.grid.crs, crs)(*edge)
        bounds.append((e.min(), n.min(), e.max(), n.max()))
    low, high = np.min(bounds, axis=0)[:2], np.max(bounds, axis=0)[2:]
    c0, f0 = (phase.c, phase.f) if phase else (0.0, 0.0)
    left, top = c0 + np.floor((low[0] - c0) / res + PHASE_TOLERANCE) * res, f0 + np.ceil((high[1] - f0) / res - PHASE_TOLERANCE) * res
    return Grid(crs, res, -res, float(left), float(top), int(np.ceil((high[0] - left) / res - PHASE_TOLERANCE)), int(np.ceil((top - low[1]) / res - PHASE_TOLERANCE)))


def onto_grid(piece: Piece, onto: Grid, resampling: str = "nearest") -> Piece:
    """A piece on the mosaic's grid: as it is where only rows and columns move, else warped."""
    try:
        offsets(piece.grid, onto)
    except ValueError:
        return replace(piece, pixels=reproject(piece.pixels.select("time", "row", "col", *piece.bands), piece.grid, onto, piece.bands, resampling), grid=onto)
    return piece


def mosaic(
    pieces: Sequence[Piece], overlap: str = "first", time_join: str = "outer", band_join: str = "inner", strict: bool = True, with_source: bool = False, crs: str | None = None,
    resolution: float | None = None, resampling: str = "nearest", on_grid_mismatch: str = "error",
) -> tuple[DataFrame, Grid, dict]:
    """Pixels, grid and attributes of the mosaic of two cubes or more. Cubes of another system, pixel size or phase than
    the mosaic's are an error, or with ``on_grid_mismatch="resample"``, or a ``crs`` or ``resolution`` asked for, warped onto it."""
    if on_grid_mismatch not in ("error", "resample"):
        raise ValueError("on_grid_mismatch is error or resample")
    if len(pieces) < 2:
        raise ValueError("a mosaic has two cubes at least")
    if time_join not in ("outer", "inner") or band_join not in ("inner", "union"):
        raise ValueError("time_join is outer or inner, band_join inner or union")
    said = check_compatible(pieces, strict)
    if band_join == "inner":
        common = [b for b in pieces[0].bands if all(b in p.bands for p in pieces)]
        if not common:
            raise ValueError("the cubes share no band")
        pieces = [replace(p, bands=tuple(common)) for p in pieces]
    onto = target_grid(pieces, crs, resolution)
    if on_grid_mismatch == "resample" or crs or resolution:
        pieces = [onto_grid(p, onto, resampling) for p in pieces]
    placed = place(pieces, onto)
    if time_join == "inner":
        days = placed.groupBy("time").agg(F.count_distinct("priority").alias("n")).filter(F.col("n") == len(pieces)).select("time")
        placed = placed.join(days, "time", "left_semi")
    bands = [c for c in placed.columns if c not in ("time", "row", "col", "priority")]
    out = combine(placed, bands, overlap)
    if with_source:
        out = out.join(source_map(placed, bands), ["time", "row", "col"])
    return out, onto, {"mosaic_of": [p.name for p in pieces], "overlap": overlap, "differences": said}
