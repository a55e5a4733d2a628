"""How much of an area footprints cover together: unions of polygons, exact, in an equal-area plane.

The plane is longitude by the authalic sine of latitude on WGS84; corners are projected and edges are straight in it.
Where a group has many footprints, the area's height is cut into bands, and each footprint goes to the bands that it
reaches, so that no task holds a large group. Within a band the heights of all corners and of all crossings of edges cut it into strips. No edges
meet inside a strip, so covered lengths change evenly over it, and its covered area is its height times the covered
length of its middle line: there, each footprint is the intervals between its crossings, odd to even, which makes inner
rings holes; intervals are merged, and cut with those of the area."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

Ring = Sequence[tuple[float, float]]
#: Of the WGS84 ellipsoid.
ECCENTRICITY = math.sqrt((2 - 1 / 298.257223563) / 298.257223563)


def authalic(lat: Column) -> Column:
    """What has the sine's part on a sphere: heights in an equal-area cylinder projection, but for a factor."""
    s, e = F.sin(F.radians(lat)), ECCENTRICITY
    return (s / (1 - e * e * s * s) + F.log((1 + e * s) / (1 - e * s)) / (2 * e)) * ((1 - e * e) / 2)


def authalic_of(lat: np.ndarray) -> np.ndarray:
    s, e = np.sin(np.radians(lat)), ECCENTRICITY
    return (s / (1 - e * e * s * s) + np.log((1 + e * s) / (1 - e * s)) / (2 * e)) * ((1 - e * e) / 2)


def box_ring(bounds: Sequence[float]) -> list[tuple[float, float]]:
    left, bottom, right, top = bounds
    return [(left, bottom), (right, bottom), (right, top), (left, top)]


def edges_of(rings: Sequence[Ring]) -> np.ndarray:
    """(x0, y0, x1, y1) of all edges but level ones, upward; rings may or may not repeat their first corner."""
    out = []
    for ring in rings:
        p = np.asarray(ring, dtype=float).reshape(-1, 2)
        if len(p) < 3:
            continue
        q = np.roll(p, -1, axis=0)
        e = np.hstack((p, q))[p[:, 1] != q[:, 1]]
        down = e[:, 1] > e[:, 3]
        e[down] = e[down][:, [2, 3, 0, 1]]
        out.append(e)
    return np.vstack(out) if out else np.zeros((0, 4))


def area_of(rings: Sequence[Ring]) -> float:
    """Area inside an odd number of rings."""
    e = edges_of(rings)
    return covered(e, np.zeros(len(e), dtype=np.int64), e, -np.inf, np.inf) if len(e) else 0.0


def _crossings(e: np.ndarray, block: int = 512) -> np.ndarray:
    """Heights where two edges cross, in blocks of edges by those whose spans overlap."""
    x0, y0, x1, y1 = e.T
    slope = (x1 - x0) / (y1 - y0)
    base = x0 - slope * y0
    out = []
    for k in range(0, len(e), block):
        part = slice(k, k + block)
        with np.errstate(divide="ignore", invalid="ignore"):
            y = (base[None] - base[part, None]) / (slope[part, None] - slope[None])
            low, high = np.maximum(y0[part, None], y0[None]), np.minimum(y1[part, None], y1[None])
            out.append(y[(y > low) & (y < high)])
    return np.concatenate(out) if out else np.zeros(0)


def _intervals(e: np.ndarray, owner: np.ndarray, y: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, on the lines at ``y``, of what each owner's edges enclose; line k lies ``k * far`` to the right."""
    line, edge = np.nonzero((e[None, :, 1] <= y[:, None]) & (e[None, :, 3] > y[:, None]))
    x0, y0, x1, y1 = e[edge].T
    x = x0 + (y[line] - y0) * (x1 - x0) / (y1 - y0) + line * far
    x = x[np.lexsort((x, owner[edge], line))]
    return x[0::2], x[1::2]


def _measure(start: np.ndarray, end: np.ndarray, far: float, lines: int) -> np.ndarray:
    """Length of the union of intervals on each line."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    before = np.concatenate(([-np.inf], reach[:-1]))
    new = np.maximum(reach - np.maximum(start, before), 0)
    return np.bincount(np.clip(np.floor(start / far + 0.5).astype(np.int64), 0, lines - 1), weights=new, minlength=lines)


def covered(edges: np.ndarray, owner: np.ndarray, aoi: np.ndarray, low: float, high: float, cells: int = 1 << 21) -> float:
    """Area of the AOI between two heights that lies in any of the polygons given by edges and their owners."""
    low, high = max(low, aoi[:, 1].min()), min(high, aoi[:, 3].max())
    meets = (edges[:, 3] > low) & (edges[:, 1] < high)
    edges, owner, aoi = edges[meets], owner[meets], aoi[(aoi[:, 3] > low) & (aoi[:, 1] < high)]
    both = np.unique(np.vstack((edges, aoi)), axis=0)
    if not len(edges) or not len(aoi):
        return 0.0
    cuts = np.concatenate((both[:, 1], both[:, 3], _crossings(both), [low, high]))
    cuts = np.unique(cuts[(cuts >= low) & (cuts <= high)])
    # Lines are laid side by side, each in a stretch of its own, with what they cut in its middle.
    middle = (both[:, [0, 2]].min() + both[:, [0, 2]].max()) / 2
    edges, aoi = edges - [middle, 0, middle, 0], aoi - [middle, 0, middle, 0]
    far = 4 * max(float(np.ptp(both[:, [0, 2]])), 1e-300)
    total, step = 0.0, max(1, cells // max(1, len(edges)))
    for k in range(0, len(cuts) - 1, step):
        a, z = cuts[k : k + step], cuts[k + 1 : k + step + 1]
        a = a[: len(z)]
        y = (a + z) / 2
        (s, t), (u, v) = _intervals(edges, owner, y, far), _intervals(aoi, np.zeros(len(aoi)), y, far)
        n = len(y)
        total += float(((z - a) * (_measure(s, t, far, n) + _measure(u, v, far, n) - _measure(np.concatenate((s, u)), np.concatenate((t, v)), far, n))).sum())
    return max(total, 0.0)


@dataclass(frozen=True)
class Area:
    """An area in the plane: its edges, extent and size."""

    edges: np.ndarray
    size: float
    x0: float
    x1: float
    y0: float
    y1: float

    @classmethod
    def of(cls, rings: Sequence[Ring]) -> Area:
        flat = [[(x, float(authalic_of(np.array(y)))) for x, y in ring] for ring in rings]
        e, size = edges_of(flat), area_of(flat)
        if not size > 0:
            raise ValueError("an area has no extent")
        return cls(e, size, *(float(f(e[:, on])) for on in ([0, 2], [1, 3]) for f in (np.min, np.max)))


def feature_shares(footprints: DataFrame, features: dict[object, Sequence[Ring]], key: Sequence[str], rings: str = "geometry", band_footprints: int = 64) -> DataFrame:
    """(feature_id, key, share) of each area and group: the share of the area, from 0 to 1, that the footprints of the
    group cover together.

    Areas and footprints are rings in degrees, footprints as array<array<struct<x, y>>>; inner rings are holes. Equal
    footprints of a group count once. Null and degenerate footprints cover nothing, but their group has a row. The
    areas go to every task, footprints only to the areas and bands whose extent they meet; a group has a band for
    every ``band_footprints`` footprints that meet an area."""
    if not features:
        raise ValueError("there is no area")
    areas = [Area.of(r) for r in features.values()]
    keys = {c: f"__k{k}" for k, c in enumerate(key)}
    plane = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p["x"].cast("double").alias("x"), authalic(p["y"]).alias("y"))))
    points = F.flatten("__rings")
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    each = footprints.select(*(F.col(c).alias(k) for c, k in keys.items()), plane.alias("__rings")).distinct()
    by = list(keys.values())
    boxed = each.select(*by, "__rings", F.array_min(xs).alias("__x0"), F.array_max(xs).alias("__x1"), F.array_min(ys).alias("__y0"), F.array_max(ys).alias("__y1"))
    extents = F.array(*(F.struct(F.lit(k).alias("f"), *(F.lit(v).alias(n) for n, v in (("x0", a.x0), ("x1", a.x1), ("y0", a.y0), ("y1", a.y1)))) for k, a in enumerate(areas)))
    met = F.filter(extents, lambda a: (F.col("__x1") > a["x0"]) & (F.col("__x0") < a["x1"]) & (F.col("__y1") > a["y0"]) & (F.col("__y0") < a["y1"]))
    near = boxed.select(*by, F.xxhash64("__rings").alias("__owner"), "__rings", "__y0", "__y1", F.explode(met).alias("__a"))
    near = near.select(*by, "__owner", "__rings", "__y0", "__y1", F.col("__a.f").alias("__f"), F.col("__a.y0").alias("__low"), ((F.col("__a.y1") - F.col("__a.y0"))).alias("__high"))
    sizes = near.groupBy(*by, "__f").agg(F.ceil(F.count(F.lit(1)) / band_footprints).cast("int").alias("__bands"))
    same = reduce(and_, [near[c].eqNullSafe(sizes[c]) for c in (*by, "__f")])
    near = near.join(sizes, same).select(near["*"], "__bands")
    number = lambda y: F.greatest(F.lit(0), F.least(F.col("__bands") - 1, F.floor((y - F.col("__low")) / F.col("__high") * F.col("__bands")).cast("int")))
    dealt = near.withColumn("__band", F.explode(F.sequence(number(F.col("__y0")), number(F.col("__y1")))))
    # An edge is two corners, the last one back to the first.
    ring = F.explode("__rings").alias("__ring")
    edges = dealt.select(*by, "__f", "__band", "__bands", "__owner", ring).filter(F.size("__ring") > 2)
    ends = F.explode(F.arrays_zip(F.col("__ring").alias("p"), F.concat(F.slice("__ring", 2, F.size("__ring")), F.slice("__ring", 1, 1)).alias("q"))).alias("e")
    edges = edges.select(*by, "__f", "__band", "__bands", "__owner", ends).filter("e.p.y <> e.q.y")
    up = F.col("e.p.y") < F.col("e.q.y")
    lower, upper = F.when(up, F.col("e.p")).otherwise(F.col("e.q")), F.when(up, F.col("e.q")).otherwise(F.col("e.p"))
    flat = edges.select(*by, "__f", "__band", "__bands", "__owner", *(v[n].alias(f"__{n}{k}") for k, v in enumerate((lower, upper)) for n in "xy"))
    whole = ["__f", "__band", *by]
    parts = int(footprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = F.struct(*whole).alias("__g")
    together = flat.select(F.xxhash64(*whole).alias("__h"), named, "__bands", "__owner", "__x0", "__y0", "__x1", "__y1").repartition(parts, "__h").sortWithinPartitions("__h", "__g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def flush() -> pa.RecordBatch:
            data = np.concatenate([h[0] for h in held], axis=1)
            area, band, bands = areas[now["__f"]], now["__band"], int(data[0, 0])
            step = (area.y1 - area.y0) / bands
            top = area.y1 if band == bands - 1 else area.y0 + (band + 1) * step
            owner = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)[1]
            size = covered(np.ascontiguousarray(data[1:].T), owner, area.edges, area.y0 + band * step, top)
            return pa.RecordBatch.from_arrays([held[0][2], pa.array([size])], ["__g", "area"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("__g")
            marks = [np.asarray(batch.column("__h"))] + [c.dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in g.flatten()]
            change = np.flatnonzero(np.append(True, np.any([np.nan_to_num(m[1:].astype(float), nan=-1) != np.nan_to_num(m[:-1].astype(float), nan=-1) if m.dtype.kind == "f" else m[1:] != m[:-1] for m in marks], axis=0)))
            numbers = np.array([np.asarray(batch.column(c), dtype=np.float64) for c in ("__bands", "__x0", "__y0", "__x1", "__y1")])
            owners = np.asarray(batch.column("__owner"))
            for a, z in zip(change.tolist(), [*change[1:].tolist(), batch.num_rows], strict=True):
                at = g[a].as_py()
                if held and at != now:
                    yield flush()
                    held = []
                now = at
                held.append((numbers[:, a:z], owners[a:z], g.slice(a, 1)))
        if held:
            yield flush()

    found = together.mapInArrow(run, StructType([together.schema["__g"], StructField("area", DoubleType())])).select(*(F.col(f"__g.{c}").alias(c) for c in (*by, "__f")), "area")
    none = each.select(*by).distinct().select(*by, F.explode(F.array(*(F.lit(k) for k in range(len(areas))))).alias("__f"), F.lit(0.0).alias("area"))
    sums = found.unionByName(none).groupBy(*by, "__f").agg(F.sum("area").alias("area"))
    names, extent = (F.array(*(F.lit(v) for v in values)) for values in (features, [a.size for a in areas]))
    return sums.select(names[F.col("__f")].alias("feature_id"), *(F.col(k).alias(c) for c, k in keys.items()), F.least(F.lit(1.0), F.col("area") / extent[F.col("__f")]).alias("share"))


def union_share(footprints: DataFrame, aoi: Sequence[Ring], key: Sequence[str], rings: str = "geometry", band_footprints: int = 64) -> DataFrame:
    """(key, share) of one area: see ``feature_shares``."""
    return feature_shares(footprints, {0: aoi}, key, rings, band_footprints).drop("feature_id")
