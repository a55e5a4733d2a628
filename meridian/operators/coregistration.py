"""Scene alignment: window shifts by phase correlation, their consensus, chains of shifts, one final warp.

Each scene is gathered into one frame by a task of its own. A chain is a stream of frames in order: its task holds
the running reference and one scene, whatever the number of dates. The legs before and after an anchor are two chains."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .resample import warp_array
from .statistics import edge_roughness


def phase_shift(ref: np.ndarray, tgt: np.ndarray) -> tuple[float, float, float]:
    """(rows, cols, reliability) by which ``tgt`` is moved against ``ref``: peak of the normalized cross power, refined
    by a parabola on each axis."""
    win = np.outer(np.hanning(ref.shape[0]), np.hanning(ref.shape[1]))
    a, b = np.fft.fft2((ref - ref.mean()) * win), np.fft.fft2((tgt - tgt.mean()) * win)
    cross = b * np.conj(a)
    cross /= np.maximum(np.abs(cross), 1e-12)
    c = np.real(np.fft.ifft2(cross))
    r, k = np.unravel_index(int(np.argmax(c)), c.shape)
    peak = c[r, k]
    out = []
    for axis, at, n in ((0, r, c.shape[0]), (1, k, c.shape[1])):
        lo, hi = (c[(at - 1) % n, k], c[(at + 1) % n, k]) if axis == 0 else (c[r, (at - 1) % n], c[r, (at + 1) % n])
        den = lo - 2 * peak + hi
        frac = 0.0 if den == 0 else float(np.clip(0.5 * (lo - hi) / den, -0.5, 0.5))
        v = at + frac
        out.append(v - n if v > n / 2 else v)
    rest = (c.sum() - peak) / (c.size - 1)
    return out[0], out[1], float(100 * peak / (abs(peak) + abs(rest) + c.std()))


def weighted_median(df: DataFrame, by: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """The first value, in order, at which the weight so far reaches half."""
    w = Window.partitionBy(*by).orderBy(value)
    run = F.sum(weight).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.sum(weight).over(Window.partitionBy(*by))
    return df.withColumns({"__r": run, "__w": whole}).filter(F.col("__r") >= F.col("__w") / 2).groupBy(*by).agg(F.min(value).alias(out))


def consensus(estimates: DataFrame, by: Sequence[str], least: float = 0.2, factor: float = 3.0) -> DataFrame:
    """Per scene the shift that windows (x, y, reliability) agree on: weighted median, then the weighted mean of those
    within max(``least``, ``factor`` x median distance) of it, with their number and spread, which is the median distance
    of those from the mean. ``Votes`` does the same for the windows of one scene in a chain."""
    mx = weighted_median(estimates, by, "x", "reliability", "mx")
    my = weighted_median(estimates, by, "y", "reliability", "my")
    d = F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my"))
    e = estimates.join(mx, list(by)).join(my, list(by)).withColumn("d", d)
    limit = e.groupBy(*by).agg(F.greatest(F.lit(least), F.median("d") * factor).alias("limit"), F.count(F.lit(1)).alias("n"))
    good = e.join(limit, list(by)).filter("d <= limit")
    mean = lambda v: F.sum(F.col(v) * F.col("reliability")) / F.nullif(F.sum("reliability"), F.lit(0.0))
    centre = good.groupBy(*by).agg(mean("x").alias("cx"), mean("y").alias("cy"))
    off = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    agreed = good.join(centre, list(by)).groupBy(*by, F.col("cx").alias("x"), F.col("cy").alias("y"))
    return agreed.agg(F.count(F.lit(1)).alias("inliers"), F.max("n").alias("windows"), F.median(off).alias("spread"))


def auto_anchor(scenes: DataFrame, by: Sequence[str] = (), max_cloud: float = 10.0, max_missing: float = 0.2) -> DataFrame:
    """The scene, of each group, of the highest median gradient (time, cloud_percentage, missing, gradient). Clear scenes go before others, and
    among those the ones in the middle half of the time range; unknown cloud counts as none."""
    every = Window.partitionBy(*by)
    first, last = F.min("time").over(every).cast("timestamp").cast("double"), F.max("time").over(every).cast("timestamp").cast("double")
    at = F.col("time").cast("timestamp").cast("double")
    clear = (F.coalesce("cloud_percentage", F.lit(0.0)) <= max_cloud) & (F.col("missing") < max_missing)
    s = scenes.withColumns({"__clear": F.coalesce(clear, F.lit(False)), "__middle": F.abs(at - (first + last) / 2) <= (last - first) / 4})
    best = F.row_number().over(every.orderBy(F.desc("__clear"), F.desc("__middle"), F.desc_nulls_last("gradient"), "time"))
    return s.withColumn("__n", best).filter("__n = 1").drop("__n", "__clear", "__middle")


def inlier_threshold(value, windows: int, share: float, floor: int = 3) -> int:
    """A number of windows, or ``auto``: a share of them, ``floor`` at least."""
    if value == "auto":
        return max(floor, int(np.ceil(share * windows)))
    if not isinstance(value, int) or value < 1:
        raise ValueError("give auto or a number of windows from 1")
    return value


def window_positions(clear: np.ndarray, size: int, n: int, stride: int = 64, apart: int = 128, pad: int | None = None, fallback: float = 0.9) -> list[tuple[int, int]]:
    """Up to ``n`` windows that are clear with ``pad`` pixels around them (a 32nd of the size), each as far as can be from
    those chosen before, so the first few are well spread. Where there is none, windows of which ``fallback`` is clear.
    Clear pixels are counted by an integral image."""
    pad = max(1, size // 32) if pad is None else pad
    s = np.pad(clear.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def share(around: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = (v.ravel() for v in np.meshgrid(np.arange(around, clear.shape[0] - size - around + 1, stride), np.arange(around, clear.shape[1] - size - around + 1, stride), indexing="ij"))
        wide = size + 2 * around
        top, left = r - around, c - around
        return r, c, (s[top + wide, left + wide] - s[top, left + wide] - s[top + wide, left] + s[top, left]) / wide**2

    for around, least in ((pad, 1.0), (0, fallback)):
        r, c, part = share(around)
        r, c, part = r[part >= least], c[part >= least], part[part >= least]
        if len(r):
            break
    out: list[tuple[int, int]] = []
    far = np.full(len(r), apart)
    while len(out) < min(n, len(r)) and far.max() >= apart:
        k = int(np.lexsort((c, r, -part, -far))[0])
        out.append((int(r[k]), int(c[k])))
        distance = np.abs(r - r[k]) + np.abs(c - c[k])
        far = distance if len(out) == 1 else np.minimum(far, distance)
    return out


@dataclass(frozen=True)
class Votes:
    """What the windows of a scene say: the shift most agree on, how many do, and how far they are apart."""

    x: float
    y: float
    inliers: int
    spread: float
    windows: int

    @classmethod
    def count(cls, estimates: Sequence[tuple[float, float, float]], least: float = 0.2, factor: float = 3.0) -> Votes:
        at, weight = np.array([e[:2] for e in estimates]), np.maximum([e[2] for e in estimates], 1e-12)
        rank = np.argsort(at, axis=0, kind="stable")
        half = np.cumsum(weight[rank], axis=0) >= weight.sum() / 2
        middle = np.take_along_axis(at, np.take_along_axis(rank, half.argmax(axis=0)[None], axis=0), axis=0)[0]
        off = np.linalg.norm(at - middle, axis=1)
        agree = off <= max(least, factor * float(np.median(off)))
        x, y = weight[agree] @ at[agree] / weight[agree].sum()
        return cls(float(x), float(y), int(agree.sum()), float(np.median(np.linalg.norm(at[agree] - (x, y), axis=1))), len(at))


@dataclass(frozen=True)
class Matching:
    """How two scenes are matched. With ``coarse`` the first windows alone decide, if enough of them agree closely;
    else all of them do."""

    size: int = 64
    windows: int = 50
    coarse: int = 10
    coarse_least: int = 5
    coarse_share: float = 0.8
    coarse_spread: float = 0.15

    def shift(self, ref: np.ndarray, tgt: np.ndarray) -> Votes | None:
        size = min(self.size, *ref.shape)
        places = window_positions(np.isfinite(ref) & np.isfinite(tgt), size, self.windows, max(8, size // 4), max(8, size // 2))
        found: list[tuple[float, float, float]] = []
        votes = None
        for part in (places[: self.coarse], places[self.coarse :]) if self.coarse else (places,):
            for r, c in part:
                a, b = (x[r : r + size, c : c + size] for x in (ref, tgt))
                dy, dx, reliability = phase_shift(*(np.nan_to_num(x, nan=float(np.nanmean(x))) for x in (a, b)))
                found.append((dx, dy, reliability))
            votes = Votes.count(found) if found else None
            if self.coarse and votes and votes.windows >= self.coarse_least and votes.inliers >= self.coarse_share * votes.windows and votes.spread <= self.coarse_spread:
                break
        return votes


SHIFTS = "cube_id string, time timestamp_ntz, shift_row double, shift_col double, inliers int, windows int, kept boolean"
FRAME = "cube_id string, time timestamp_ntz, height int, width int, data binary, cloud double, missing double, gradient double"


def chain(frames: Iterable[tuple[object, np.ndarray, float | None]], start: np.ndarray, matching: Matching, keep="auto", update_ref="auto", max_cloud: float | None = None) -> Iterator[tuple]:
    """(key, shift of rows, of columns, inliers, windows, kept) of each frame (key, image, cloud), in order. A frame is
    matched against the running reference and its shift added to the reference's. It becomes the reference when enough
    windows agree and it is clear; only these two images are held."""
    ref, base = start, (0.0, 0.0)
    for key, image, cloud in frames:
        votes = matching.shift(ref, image)
        if votes is None:
            yield key, None, None, 0, 0, False
            continue
        at = (base[0] + votes.y, base[1] + votes.x)
        kept = votes.inliers >= inlier_threshold(keep, votes.windows, 0.06)
        yield key, *at, votes.inliers, votes.windows, kept
        clear = max_cloud is None or cloud is None or cloud <= max_cloud
        if kept and clear and votes.inliers >= inlier_threshold(update_ref, votes.windows, 0.16):
            ref, base = image, at


def frames_of(pixels: DataFrame, band: str, cloud: str | None = None, times: bool = True) -> DataFrame:
    """FRAME of each cube and time: the band as one image of 32-bit floats of the cube's extent, what is missing of it
    and its median gradient. ``cloud`` is a column with the scene's percentage."""
    size = pixels.groupBy("cube_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    rows = pixels.select("cube_id", *(["time"] if times else [F.lit(None).cast("timestamp_ntz").alias("time")]), "row", "col", F.col(band).cast("double").alias("v"), (F.col(cloud).cast("double") if cloud else F.lit(None).cast("double")).alias("cloud"))

    def run(table: pa.Table) -> pa.Table:
        h, w = table.column("height")[0].as_py(), table.column("width")[0].as_py()
        a = np.full((h, w), np.nan, dtype=np.float32)
        a[table.column("row").to_numpy(), table.column("col").to_numpy()] = table.column("v").to_numpy(zero_copy_only=False)
        steep = np.hypot(*np.gradient(a)) if min(h, w) > 1 else np.full((h, w), np.nan)
        known = steep[np.isfinite(steep)]
        clouds = [c for c in table.column("cloud").to_pylist() if c is not None]
        row = {"cube_id": table.column("cube_id")[0].as_py(), "time": table.column("time")[0].as_py(), "height": h, "width": w, "data": a.tobytes(), "cloud": max(clouds, default=None), "missing": 1 - known.size / a.size, "gradient": float(np.median(known)) if known.size else None}
        kinds = (pa.string(), pa.timestamp("us"), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.float64())
        return pa.table([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

    return rows.join(size, "cube_id").groupBy("cube_id", "time").applyInArrow(run, FRAME)


def moved_frames(frames: DataFrame, shifts: DataFrame) -> DataFrame:
    """The frames of kept scenes, moved back by their shifts."""
    joined = frames.join(shifts.filter("kept").select("cube_id", "time", "shift_row", "shift_col"), ["cube_id", "time"])

    @F.pandas_udf("binary")
    def back(data: pd.Series, height: pd.Series, width: pd.Series, dr: pd.Series, dc: pd.Series) -> pd.Series:
        return pd.Series([warp_array(np.frombuffer(d, np.float32).reshape(h, w).astype(float), -r, -c).astype(np.float32).tobytes() for d, h, w, r, c in zip(data, height, width, dr, dc, strict=True)])

    return joined.withColumn("data", back("data", "height", "width", "shift_row", "shift_col")).drop("shift_row", "shift_col")


def shifts_of_frames(frames: DataFrame, matching: Matching, mode: str = "composite", anchor=None, composite_days: int = 30, keep="auto", update_ref="auto", max_cloud: float | None = None) -> DataFrame:
    """SHIFTS of all frames, by a chain for each cube, or two with an anchor."""
    if mode == "anchor":
        if anchor is None:
            chosen = auto_anchor(frames.withColumn("cloud_percentage", F.col("cloud")).drop("data"), ["cube_id"])
        else:
            near = F.abs(F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.lit(str(anchor)).cast("timestamp_ntz").cast("timestamp")))
            chosen = frames.drop("data").withColumn("__n", F.row_number().over(Window.partitionBy("cube_id").orderBy(near, "time"))).filter("__n = 1")
        chosen = chosen.select("cube_id", F.col("time").alias("start"))
        timed = frames.join(chosen, "cube_id")
        gone = F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))
        ordered = timed.withColumns({"leg": F.when(gone < 0, F.array(F.lit(1))).when(gone > 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))), "at": F.abs(gone)})
        ordered = ordered.withColumn("leg", F.explode("leg"))
    else:
        # The median of the first days, pixel by pixel, goes before all frames.
        first = frames.groupBy("cube_id").agg(F.min("time").alias("start"))
        early = frames.join(first, "cube_id").filter(F.col("time") <= F.col("start") + F.make_dt_interval(days=F.lit(composite_days)))
        ordered = _median_frames(early).withColumn("at", F.lit(-1).cast("long")).unionByName(frames.withColumn("at", F.unix_micros(F.col("time").cast("timestamp")) + (1 << 62)))
        ordered = ordered.withColumn("leg", F.lit(0))
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = ordered.select("cube_id", "leg", "at", "time", "height", "width", "data", "cloud").repartition(parts, "cube_id", "leg").sortWithinPartitions("cube_id", "leg", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for k in range(batch.num_rows):
                    cube, leg, at, time, h, w, data, cloud = (batch.column(c)[k] for c in range(8))
                    yield (cube.as_py(), leg.as_py()), at.as_py(), time.as_py(), np.frombuffer(data.as_buffer(), np.float32).reshape(h.as_py(), w.as_py()).astype(float), cloud.as_py()

        stream, pending = rows(), None
        while (head := pending or next(stream, None)) is not None:
            (cube, leg), at, time, start, _ = head
            pending = None
            if mode == "anchor" and leg == 0:
                yield _shift_rows([(cube, time, 0.0, 0.0, 0, 0, True)])

            def members(own=(cube, leg)) -> Iterator[tuple]:
                nonlocal pending
                for row in stream:
                    if row[0] != own:
                        pending = row
                        return
                    yield row[2], row[3], row[4]

            for found in chain(members(), start, matching, keep, update_ref, max_cloud):
                yield _shift_rows([(cube, *found)])

    return ready.mapInArrow(run, SHIFTS)


def _shift_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.timestamp("us"), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SHIFTS.split(", ")])


def _median_frames(frames: DataFrame, rows: int = 256) -> DataFrame:
    """A frame of each cube, pixel by pixel the median over its frames (0 counts as missing), by blocks of rows so that no
    task holds many whole frames."""
    width = 4 * F.col("width")
    block = F.explode(F.sequence(F.lit(0), ((F.col("height") - 1) / rows).cast("int"))).alias("block")
    cut = frames.select("cube_id", "time", "height", "width", block, "data")
    cut = cut.withColumn("data", F.substring(F.col("data"), (F.col("block") * rows * width + 1).cast("int"), (F.lit(rows) * width).cast("int")))

    def median(table: pa.Table) -> pa.Table:
        stack = np.stack([np.frombuffer(d.as_buffer(), np.float32) for d in table.column("data")])
        stack = np.sort(np.where(stack == 0, np.nan, stack), axis=0)  # missing ones last
        n = np.isfinite(stack).sum(axis=0)
        at = np.arange(stack.shape[1])
        low, high = stack[np.maximum(n - 1, 0) // 2, at], stack[np.minimum(n // 2, len(stack) - 1), at]
        out = np.where(n > 0, (low + high) / 2, np.nan).astype(np.float32)
        return table.slice(0, 1).select(["cube_id", "height", "width", "block"]).append_column("data", pa.array([out.tobytes()], pa.binary()))

    blocks = cut.groupBy("cube_id", "block").applyInArrow(median, "cube_id string, height int, width int, block int, data binary")

    def whole(table: pa.Table) -> pa.Table:
        parts = table.sort_by("block").column("data").to_pylist()
        kinds = dict(zip((c.split()[0] for c in FRAME.split(", ")), (pa.string(), pa.timestamp("us"), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.float64()), strict=True))
        given = {"cube_id": table.column("cube_id")[0].as_py(), "height": table.column("height")[0].as_py(), "width": table.column("width")[0].as_py(), "data": b"".join(parts)}
        return pa.table([pa.array([given.get(n)], t) for n, t in kinds.items()], names=list(kinds))

    return blocks.groupBy("cube_id").applyInArrow(whole, FRAME)


def estimate_shifts(
    pixels: DataFrame, band: str, size: int = 64, windows: int = 50, keep: int | str = "auto", composite_days: int = 30, mode: str = "composite", anchor=None, update_ref: int | str = "auto",
    max_cloud_update_ref: float | None = None, cloud: str | None = None, clear=None, coarse: int = 10, passes: int = 1,
) -> DataFrame:
    """Shift of every scene of a cube: SHIFTS.

    ``composite`` starts from the median of the first ``composite_days`` days; ``anchor`` from one scene, the nearest to
    a time or the best one, forward and backward at once. A scene is kept when ``keep`` windows agree (``auto``: 6 % of
    them, at least 3) and becomes the reference when ``update_ref`` do (16 %, at least 3) and its ``cloud`` column is at
    most ``max_cloud_update_ref``, or missing. ``clear``, a condition, leaves out pixels from matching only. Each pass
    after the first matches the scenes moved by what is known and adds what is found; scenes that were not kept stay so."""
    if isinstance(passes, bool) or not isinstance(passes, int) or passes < 1:
        raise ValueError("passes are 1 or more")
    found = _passes(pixels, band, size, windows, keep, composite_days, mode, anchor, update_ref, max_cloud_update_ref, cloud, clear, coarse, passes)
    return list(itertools.islice(found, passes))[-1]


def _passes(pixels, band, size=64, windows=50, keep="auto", composite_days=30, mode="composite", anchor=None, update_ref="auto", max_cloud_update_ref=None, cloud=None, clear=None, coarse=10, most=1) -> Iterator[DataFrame]:
    """SHIFTS after one pass, two passes, and so on; where there are several, each is written before the next."""
    if mode not in ("composite", "anchor"):
        raise ValueError("mode must be composite or anchor")
    source = pixels if clear is None else pixels.withColumn(band, F.when(clear, F.col(band)))
    frames = frames_of(source, band, cloud)
    frames = written(frames, "frames") if most > 1 else frames
    matching = Matching(size, windows, coarse)
    how = {"composite_days": composite_days, "keep": keep, "update_ref": update_ref, "max_cloud": max_cloud_update_ref}
    shifts = shifts_of_frames(frames, matching, mode, anchor, **how)
    while True:
        shifts = written(shifts, "shifts") if most > 1 else shifts
        yield shifts
        more = shifts_of_frames(moved_frames(frames, shifts), matching, mode, anchor, **how)
        more = more.select("cube_id", "time", F.col("shift_row").alias("dr"), F.col("shift_col").alias("dc"), F.col("inliers").alias("i"), F.col("windows").alias("w"), F.col("kept").alias("k"))
        both = shifts.join(more, ["cube_id", "time"], "left")
        used = F.col("kept") & F.coalesce("k", F.lit(False))
        total = lambda a, b: F.col(a) + F.when(used, F.col(b)).otherwise(0.0)  # noqa: B023, E731
        shifts = both.select("cube_id", "time", total("shift_row", "dr").alias("shift_row"), total("shift_col", "dc").alias("shift_col"), F.when(used, F.col("i")).otherwise(F.col("inliers")).alias("inliers"), F.when(used, F.col("w")).otherwise(F.col("windows")).alias("windows"), "kept")


MAX_PASSES, LEAST_GAIN = 5, 0.02


def coregister(pixels: DataFrame, bands: Sequence[str], match_band: str = "auto", passes: int | str = 1, **how) -> tuple[DataFrame, DataFrame]:
    """Pixels of the scenes that matched, moved once by their whole shift, and the shifts.

    ``match_band`` ``auto`` is the first of nir, red, green and blue that is there. With ``passes`` ``auto`` a further
    pass is taken as long as it lowers the edge roughness of the cubes by more than LEAST_GAIN, MAX_PASSES at most."""
    if match_band == "auto":
        match_band = next((b for b in ("nir", "red", "green", "blue") if b in bands), bands[0])
    if passes != "auto":
        return moved(pixels, bands, shifts := estimate_shifts(pixels, match_band, passes=passes, **how)), shifts
    best = rough = None
    for shifts in itertools.islice(_passes(pixels, match_band, most=MAX_PASSES, **how), MAX_PASSES):
        now = _roughness(moved(pixels, [match_band], shifts), match_band)
        if best is not None and (rough is None or now is None or not now < rough * (1 - LEAST_GAIN)):
            break
        best, rough = shifts, now
    return moved(pixels, bands, best), best


def _roughness(pixels: DataFrame, band: str) -> float | None:
    return edge_roughness(pixels, band, ["cube_id"]).first()["roughness"]


def moved(pixels: DataFrame, bands: Sequence[str], shifts: DataFrame) -> DataFrame:
    """The kept scenes, each moved back by its shift in one cubic warp."""
    joined = pixels.join(shifts.filter("kept").select("cube_id", "time", "shift_row", "shift_col"), ["cube_id", "time"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        out = pdf[["cube_id", "time", "row", "col"]].copy()
        for b in bands:
            a = np.full((h, w), np.nan)
            a[r, c] = pdf[b].to_numpy(dtype=float)
            v = warp_array(a, -float(pdf["shift_row"].iloc[0]), -float(pdf["shift_col"].iloc[0]))[r, c]
            out[b] = pd.array(np.where(np.isnan(v), None, v), dtype="Float64")
        return out

    kinds = f"cube_id {pixels.schema['cube_id'].dataType.simpleString()}, time {pixels.schema['time'].dataType.simpleString()}, row int, col int, " + ", ".join(f"{b} double" for b in bands)
    return joined.groupBy("cube_id", "time").applyInPandas(run, kinds)
