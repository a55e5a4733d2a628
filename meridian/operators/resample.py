"""Reprojection, shifting and resolution of pixel tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import is_categorical
from .grid import Grid, between, between_arrays
from .neighbourhood import map_tiles


def target_cells(spark, grid: Grid) -> DataFrame:
    rows = spark.range(grid.height).select(F.col("id").cast("int").alias("row"))
    return rows.select("row", F.explode(F.sequence(F.lit(0), F.lit(grid.width - 1))).alias("col"))


def reproject_nearest(pixels: DataFrame, source: Grid, target: Grid, inverse: Callable[[Column, Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """Every target pixel takes the source pixel that holds its centre: a join on computed rows and columns. ``inverse``
    maps target x, y to source x, y (none within one system). Target pixels off the source are not there."""
    cells = target_cells(pixels.sparkSession, target)
    x, y = target.x(F.col("col")), target.y(F.col("row"))
    if inverse:
        x, y = inverse(x, y)
    at = cells.select(
        F.col("row").alias("__row"), F.col("col").alias("__col"),
        F.floor((y - source.f) / source.e).cast("int").alias("row"), F.floor((x - source.c) / source.a).cast("int").alias("col"),
    ).filter(F.col("row").between(0, source.height - 1) & F.col("col").between(0, source.width - 1))
    joined = pixels.join(at, ["row", "col"])
    return joined.drop("row", "col").withColumnsRenamed({"__row": "row", "__col": "col"}).select(*pixels.columns)


def _taps(t: Column, method: str) -> list[tuple[int, Column]]:
    """Offsets and weights of the source pixels around a point ``t`` (0 to 1) past a pixel centre. Cubic is Keys' kernel
    with a = -0.5."""
    if method == "bilinear":
        return [(0, 1 - t), (1, t)]
    t2, t3 = t * t, t * t * t
    return [(-1, -0.5 * t + t2 - 0.5 * t3), (0, 1 - 2.5 * t2 + 1.5 * t3), (1, 0.5 * t + 2 * t2 - 1.5 * t3), (2, -0.5 * t2 + 0.5 * t3)]


def reproject_weighted(pixels: DataFrame, source: Grid, target: Grid, bands: Sequence[str], inverse: Callable[[Column, Column], tuple[Column, Column]] | None = None, key: str | Sequence[str] = "time", method: str = "bilinear") -> DataFrame:
    """``bilinear`` or ``cubic``: weights of the source pixels around each target centre as rows, joined and summed.
    Missing neighbours do not count; where less than half of the weight is there (cubic) the pixel is missing. Class
    bands take the nearest instead."""
    keys = [key] if isinstance(key, str) else list(key)
    if inverse is None:
        return resample_tiles(pixels, source, target, bands, method, keys)
    cells = target_cells(pixels.sparkSession, target)
    x, y = target.x(F.col("col")), target.y(F.col("row"))
    if inverse:
        x, y = inverse(x, y)
    at = cells.select(F.col("row").alias("__row"), F.col("col").alias("__col"), ((x - source.c) / source.a - 0.5).alias("u"), ((y - source.f) / source.e - 0.5).alias("v"))
    at = at.withColumns({"c0": F.floor("u").cast("int"), "r0": F.floor("v").cast("int")}).withColumns({"tc": F.col("u") - F.col("c0"), "tr": F.col("v") - F.col("r0")})
    near = lambda d, t: F.abs(F.lit(float(d)) - t)
    every = F.array(*(
        F.struct((F.col("r0") + dr).alias("row"), (F.col("c0") + dc).alias("col"), (wr * wc).alias("w"), (near(dr, F.col("tr")) + near(dc, F.col("tc"))).alias("d"))
        for dr, wr in _taps(F.col("tr"), method) for dc, wc in _taps(F.col("tc"), method)
    ))
    at = at.select("__row", "__col", F.inline(every)).filter("w <> 0")
    agg = []
    for b in bands:
        there = F.col(b).isNotNull()
        if is_categorical(b):
            agg.append(F.min_by(b, F.when(there, F.struct("d", "row", "col"))).alias(b))
        else:
            whole = F.sum(F.when(there, F.col("w")))
            enough = whole > (0.5 if method == "cubic" else 0)
            agg.append(F.when(enough, F.sum(F.col(b) * F.col("w")) / whole).alias(b))
    out = pixels.join(at, ["row", "col"]).groupBy(*keys, "__row", "__col").agg(*agg)
    return out.withColumnsRenamed({"__row": "row", "__col": "col"})


def reproject_bilinear(pixels: DataFrame, source: Grid, target: Grid, bands: Sequence[str], inverse: Callable[[Column, Column], tuple[Column, Column]] | None = None, key: str = "time") -> DataFrame:
    return reproject_weighted(pixels, source, target, bands, inverse, key, "bilinear")


def reproject(pixels: DataFrame, source: Grid, target: Grid, bands: Sequence[str], method: str = "nearest", key: str | Sequence[str] = "time") -> DataFrame:
    """Onto a grid of the same system or of another UTM zone; class bands always take the nearest pixel."""
    if method == "nearest":
        return reproject_nearest(pixels, source, target, between(target.crs, source.crs))
    return resample_tiles(pixels, source, target, bands, method, [key] if isinstance(key, str) else list(key))


def _warp_tile(target: Grid, source: Grid, tile: int) -> Callable[[int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a tile of the target: its rows and columns, and where their centres lie in rows and columns of the source."""
    move, across = between_arrays(target.crs, source.crs), -(-target.width // tile)

    def at(number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        r0, c0 = number // across * tile, number % across * tile
        row, col = (v.ravel() for v in np.mgrid[r0 : min(r0 + tile, target.height), c0 : min(c0 + tile, target.width)])
        x, y = move(target.c + (col + 0.5) * target.a, target.f + (row + 0.5) * target.e)
        return row, col, (y - source.f) / source.e - 0.5, (x - source.c) / source.a - 0.5

    return at


def resample_tiles(pixels: DataFrame, source: Grid, target: Grid, bands: Sequence[str], method: str = "bilinear", keys: Sequence[str] = ("time",), tile: int = 256) -> DataFrame:
    """``bilinear`` or ``cubic`` onto another grid, tile by tile of the target. Each tile's footprint in the source is
    computed, with the pixels that the method needs around it; a source pixel goes to the tiles whose footprint holds it,
    so pixels are shuffled once and hardly more than once each. Tiles are smaller where the target is coarser, so that
    a task's footprint stays bounded. Missing pixels are treated as in ``reproject_weighted``; several pixels of one place
    count as their mean, of class bands the least."""
    if method not in ("bilinear", "cubic"):
        raise ValueError("resampling is nearest, bilinear or cubic")
    spark = pixels.sparkSession
    tile = max(16, min(tile, int(tile * 2 * abs(source.a) / abs(target.a)) or 16))
    locate, reach = _warp_tile(target, source, tile), {"bilinear": 1, "cubic": 2}[method]
    tiles = -(-target.width // tile) * -(-target.height // tile)

    def footprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number in batch.column(0).to_pylist():
                _, _, v, u = locate(number)
                r0, r1, c0, c1 = (int(f(w)) + d for w, f, d in ((v.min(), np.floor, -reach), (v.max(), np.ceil, reach), (u.min(), np.floor, -reach), (u.max(), np.ceil, reach)))
                if r1 >= 0 and c1 >= 0 and r0 < source.height and c0 < source.width:
                    rows.append((number, max(r0, 0), min(r1, source.height - 1), max(c0, 0), min(c1, source.width - 1)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32()) for k in range(5)], ["__tile", "__r0", "__r1", "__c0", "__c1"])

    of = spark.range(0, tiles, 1, max(1, min(tiles // 64, 1000))).mapInArrow(footprints, "__tile int, __r0 int, __r1 int, __c0 int, __c1 int")
    span = lambda a, b: F.explode(F.sequence((F.col(a) / tile).cast("int"), (F.col(b) / tile).cast("int")))
    of = of.withColumn("__br", span("__r0", "__r1")).withColumn("__bc", span("__c0", "__c1"))
    held = pixels.select(*keys, *bands, "row", "col", F.floor(F.col("row") / tile).cast("int").alias("__br"), F.floor(F.col("col") / tile).cast("int").alias("__bc"))
    near = held.join(of, ["__br", "__bc"]).filter(F.col("row").between(F.col("__r0"), F.col("__r1")) & F.col("col").between(F.col("__c0"), F.col("__c1"))).drop("__br", "__bc", "__r1", "__c1")

    def run(table: pa.Table) -> pa.Table:
        row, col, v, u = locate(table.column("__tile")[0].as_py())
        r, c = table.column("row").to_numpy(), table.column("col").to_numpy()
        base = (int(r.min()), int(c.min()))
        shape = (int(r.max()) - base[0] + 1, int(c.max()) - base[1] + 1)
        cells = shape[0] * shape[1]
        place = (r - base[0]) * shape[1] + c - base[1]
        some = np.bincount(place, minlength=cells) > 0

        def at(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Places of source pixels, -1 where there is none."""
            i, j = i - base[0], j - base[1]
            ok = (i >= 0) & (i < shape[0]) & (j >= 0) & (j < shape[1])
            k = np.where(ok, i * shape[1] + j, 0)
            return np.where(ok & some[k], k, -1)

        i0, j0 = np.floor(v).astype(np.int64), np.floor(u).astype(np.int64)
        tr, tc = v - i0, u - j0
        if method == "bilinear":
            taps = [(0, 1 - tr), (1, tr)], [(0, 1 - tc), (1, tc)]
        else:
            taps = tuple([(k, w) for k, w in zip((-1, 0, 1, 2), cubic_weights_of(t), strict=True)] for t in (tr, tc))
        pairs = [(at(i0 + dr, j0 + dc), wr * wc, np.abs(dr - tr) + np.abs(dc - tc)) for dr, wr in taps[0] for dc, wc in taps[1]]
        there = np.any([(k >= 0) & (w != 0) for k, w, _ in pairs], axis=0)
        cols = {n: table.column(n).take(pa.array(np.zeros(int(there.sum()), dtype=np.int64))) for n in keys}
        for b in bands:
            if is_categorical(b):
                codes = table.column(b).cast(pa.float64()).to_numpy(zero_copy_only=False)
                order = np.lexsort((codes, place))  # missing ones last
                first = order[np.append(True, place[order][1:] != place[order][:-1])]
                source_row = np.zeros(cells, dtype=np.int64)
                source_row[place[first]] = first
                known = np.zeros(cells, dtype=bool)
                known[place[first]] = ~np.isnan(codes[first])
                best, gap = np.full(len(row), -1, dtype=np.int64), np.full(len(row), np.inf)
                for k, w, d in pairs:  # in order of row and column, so that of equals the first stays
                    nearer = (k >= 0) & (w != 0) & known[k] & (d < gap)
                    best, gap = np.where(nearer, k, best), np.where(nearer, d, gap)
                cols[b] = table.column(b).take(pa.array(source_row[np.maximum(best[there], 0)], mask=best[there] < 0))
                continue
            given = table.column(b).cast(pa.float64()).to_numpy(zero_copy_only=False)
            held = ~np.isnan(given)
            n = np.bincount(place[held], minlength=cells)
            value = np.where(n > 0, np.bincount(place[held], weights=given[held], minlength=cells) / np.maximum(n, 1), np.nan)
            total, whole = np.zeros(len(row)), np.zeros(len(row))
            for k, w, _ in pairs:
                x = value[k]
                ok = (k >= 0) & ~np.isnan(x) & (w != 0)
                total += np.where(ok, x * w, 0.0)
                whole += np.where(ok, w, 0.0)
            enough = whole > (0.5 if method == "cubic" else 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                cols[b] = pa.array((total / whole)[there], mask=~enough[there])
        return pa.table({**cols, "row": pa.array(row[there].astype(np.int32)), "col": pa.array(col[there].astype(np.int32))})

    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    schema = ", ".join(f"`{n}` {kinds[n] if n in keys or is_categorical(n) else 'double'}" for n in (*keys, *bands))
    out = near.groupBy(*keys, "__tile").applyInArrow(run, f"{schema}, row int, col int")
    return out.select(*keys, "row", "col", *bands)


def cubic_weights_of(t: np.ndarray) -> list[np.ndarray]:
    """``cubic_weights`` of many points."""
    t2, t3 = t * t, t * t * t
    return [-0.5 * t + t2 - 0.5 * t3, 1 - 2.5 * t2 + 1.5 * t3, 0.5 * t + 2 * t2 - 1.5 * t3, -0.5 * t2 + 0.5 * t3]


def shift_whole(pixels: DataFrame, rows: int, cols: int) -> DataFrame:
    return pixels.withColumns({"row": F.col("row") + rows, "col": F.col("col") + cols})


def cubic_weights(t: float) -> np.ndarray:
    """Weights of the four pixels around a point ``t`` past the second, by Keys' kernel with a = -0.5."""
    d = np.abs(np.array([1 + t, t, 1 - t, 2 - t]))
    near, far = 1.5 * d**3 - 2.5 * d**2 + 1, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2
    return np.where(d <= 1, near, np.where(d < 2, far, 0))


def warp_array(a: np.ndarray, dr: float, dc: float) -> np.ndarray:
    """Move an image by fractions of a pixel with cubic weights; missing where a pixel that counts is missing."""
    for axis, shift in ((0, dr), (1, dc)):
        whole = int(np.floor(-shift))
        t = -shift - whole
        if t == 0:
            taps = [(whole, 1.0)]
        else:
            taps = [(whole + k, w) for k, w in zip((-1, 0, 1, 2), cubic_weights(t), strict=True)]
        out = np.zeros_like(a)
        n = a.shape[axis]
        for k, w in taps:
            src = np.arange(n) + k
            ok = (src >= 0) & (src < n)
            moved = np.take(a, np.clip(src, 0, n - 1), axis=axis)
            mask = ok[:, None] if axis == 0 else ok[None, :]
            out += w * np.where(mask, moved, np.nan)
        a = out
    return a


def warp(pixels: DataFrame, bands: Sequence[str], dr: float, dc: float, tile: int = 256) -> DataFrame:
    """Move all scenes of a cube by (dr, dc) pixels."""
    halo = int(np.ceil(max(abs(dr), abs(dc)))) + 3
    return map_tiles(pixels, bands, lambda arrays: {b: warp_array(a, dr, dc) for b, a in arrays.items()}, halo, tile)


def fill_nearest(a: np.ndarray) -> np.ndarray:
    """Missing values take the nearest value, of equally near ones that of the smallest column. The nearest of each column
    is found first, so a row costs its width squared instead of missing times present pixels."""
    missing = np.isnan(a)
    if missing.all() or not missing.any():
        return a.copy()
    h, w = a.shape
    rows = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(missing, -1, rows), axis=0)
    below = np.minimum.accumulate(np.where(missing, 2 * h, rows)[::-1], axis=0)[::-1]
    up = np.where(above < 0, np.inf, rows - above)
    down = np.where(below >= 2 * h, np.inf, below - rows)
    pick = np.where(up <= down, above, below)
    step = np.minimum(up, down) ** 2
    across = (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2
    out = a.copy()
    for r in np.flatnonzero(missing.any(axis=1)):
        cols = np.flatnonzero(missing[r])
        best = np.argmin(across[cols] + step[r][None, :], axis=1)
        out[r, cols] = a[pick[r, best], best]
    return out


def patch_positions(size: int, patch: int = 128, step: int = 96) -> list[int]:
    """Starts of patches that cover ``size``; the last is moved back to end with it."""
    if size <= patch:
        return [0]
    out = list(range(0, size - patch, step))
    return [*out, size - patch]


def patch_starts(size: Column, patch: int = 128, step: int = 96) -> Column:
    """``patch_positions`` of a column of sizes."""
    last = size - patch
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_append(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)), lambda s: s < last), last))


def upsample_bilinear(a: np.ndarray, factor: int) -> np.ndarray:
    """Each pixel as factor x factor, values between centres interpolated; edges repeat."""
    for axis in (0, 1):
        n = a.shape[axis]
        at = (np.arange(n * factor) + 0.5) / factor - 0.5
        lo = np.clip(np.floor(at).astype(int), 0, n - 1)
        hi, t = np.clip(lo + 1, 0, n - 1), np.clip(at - lo, 0, 1)
        t = t[:, None] if axis == 0 else t[None, :]
        a = np.take(a, lo, axis=axis) * (1 - t) + np.take(a, hi, axis=axis) * t
    return a


def predict_patches(a: np.ndarray, model: Callable[[np.ndarray], np.ndarray], factor: int, patch: int = 128, overlap: int = 32) -> np.ndarray:
    """Apply ``model`` (bands, patch, patch) to (bands, factor patch, factor patch) over an image; of overlapping patches
    each gives its half."""
    bands, h, w = a.shape
    pad = (max(0, patch - h), max(0, patch - w))
    full = np.pad(a, ((0, 0), (0, pad[0]), (0, pad[1])), mode="edge")
    out = np.zeros((bands, full.shape[1] * factor, full.shape[2] * factor))
    half = overlap // 2
    for r in patch_positions(full.shape[1], patch, patch - overlap):
        for c in patch_positions(full.shape[2], patch, patch - overlap):
            y = model(full[:, r : r + patch, c : c + patch])
            r0, c0 = (half if r else 0), (half if c else 0)
            out[:, (r + r0) * factor : (r + patch) * factor, (c + c0) * factor : (c + patch) * factor] = y[:, r0 * factor :, c0 * factor :]
    return out[:, : h * factor, : w * factor]


def super_resolve(pixels: DataFrame, bands: Sequence[str], factor: int = 4, model: Callable[[np.ndarray], np.ndarray] | None = None, tile: int = 256, nan_buffer: int = 0, key: str = "time") -> DataFrame:
    """Pixels of 1/factor the size. Tiles with a halo are filled to the nearest value, given to the model (by default
    bilinear), cut, and missing pixels, grown by ``nan_buffer``, are missing again. Indices must be computed anew."""
    import pandas as pd

    halo = 16
    model = model or (lambda x: np.stack([upsample_bilinear(b, factor) for b in x]))
    spans = lambda v: F.sequence(F.floor((v - halo) / tile).cast("int"), F.floor((v + halo) / tile).cast("int"))
    spread = pixels.select(key, "row", "col", *bands).withColumn("trow", F.explode(spans(F.col("row")))).withColumn("tcol", F.explode(spans(F.col("col"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc, size = int(pdf["trow"].iloc[0]), int(pdf["tcol"].iloc[0]), tile + 2 * halo
        r, c = pdf["row"].to_numpy() - tr * tile + halo, pdf["col"].to_numpy() - tc * tile + halo
        own = (r >= halo) & (r < halo + tile) & (c >= halo) & (c < halo + tile)
        if not own.any():
            return pdf[[key, "row", "col", *bands]].iloc[:0]  # only the halo of other tiles
        # Of a tile that the scene fills in part, only that part and a margin of missing pixels go to the model.
        r0, c0 = max(0, r.min() - nan_buffer - 1), max(0, c.min() - nan_buffer - 1)
        shape = (min(size, r.max() + nan_buffer + 2) - r0, min(size, c.max() + nan_buffer + 2) - c0)
        r, c = r - r0, c - c0
        inner = np.zeros(shape, dtype=bool)
        inner[r[own], c[own]] = True
        x = np.full((len(bands), *shape), np.nan)
        for k, b in enumerate(bands):
            x[k, r, c] = pdf[b].to_numpy(dtype=float)
        hole = np.isnan(x).any(axis=0)
        for _ in range(nan_buffer):
            grown = hole.copy()
            grown[1:] |= hole[:-1]
            grown[:-1] |= hole[1:]
            grown[:, 1:] |= hole[:, :-1]
            grown[:, :-1] |= hole[:, 1:]
            hole = grown
        y = model(np.stack([fill_nearest(b) for b in x])) if not np.isnan(x).all() else np.full((len(bands), shape[0] * factor, shape[1] * factor), np.nan)
        y[:, np.kron(hole, np.ones((factor, factor), dtype=bool))] = np.nan
        rr, cc = np.nonzero(np.kron(inner, np.ones((factor, factor), dtype=bool)))
        out = {key: np.repeat(pdf[key].to_numpy()[:1], len(rr)), "row": (rr + (tr * tile - halo + r0) * factor).astype("int32"), "col": (cc + (tc * tile - halo + c0) * factor).astype("int32")}
        for k, b in enumerate(bands):
            v = y[k, rr, cc]
            out[b] = pd.arrays.FloatingArray(v, np.isnan(v))
        return pd.DataFrame(out)

    kinds = f"{key} {pixels.schema[key].dataType.simpleString()}, row int, col int, " + ", ".join(f"{b} double" for b in bands)
    return spread.groupBy(key, "trow", "tcol").applyInPandas(run, kinds)
