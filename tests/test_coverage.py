"""Shares of areas that polygons cover together, against closed forms and a count of points."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.operators import coverage as C
from meridian.operators import scenes as SC
from meridian.operators.grid import Grid
from meridian.plans.cube import _in_degrees

SCHEMA = "item_id int, solar_day string, geometry array<array<struct<x:double,y:double>>>"


def frame(spark, rows):
    return spark.createDataFrame([(k, day, None if rings is None else [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, (day, rings) in enumerate(rows)], SCHEMA)


def inside(rings, x, y):
    n = np.zeros(x.shape, dtype=int)
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if y0 != y1:
                n += ((y0 > y) != (y1 > y)) & (x < x0 + (y - y0) / (y1 - y0) * (x1 - x0))
    return n % 2 == 1


def test_heights_are_equal_area():
    e = C.ECCENTRICITY
    lat = np.linspace(-80, 80, 1601)
    s = np.sin(np.radians(lat))
    ring = (1 - e**2) * np.cos(np.radians(lat)) / (1 - e**2 * s**2) ** 2  # area of a ring of the ellipsoid by its definition
    got = np.gradient(C.authalic_of(lat), np.radians(lat))
    assert np.allclose(got[1:-1], ring[1:-1], rtol=1e-5)


def test_random_polygons_against_points(spark):
    rng = np.random.default_rng(5)
    flat = lambda rings: [[(x, float(C.authalic_of(np.array(y)))) for x, y in ring] for ring in rings]
    aoi = [[(0, 40), (9, 41), (10, 50), (4, 46), (1, 51)], [(3, 43), (5, 43), (5, 45), (3, 45)]]
    rows = []
    for day in range(6):
        for _ in range(rng.integers(1, 9)):
            turn, n = rng.uniform(0, 6), int(rng.integers(3, 8))
            at = rng.uniform((-1, 39), (11, 52))
            a = np.sort(rng.uniform(0, 2 * np.pi, n)) + turn
            outer = [tuple(at + rng.uniform(1, 4) * np.array((np.cos(v), np.sin(v)))) for v in a]
            hole = [tuple(at + 0.3 * np.array((np.cos(v), np.sin(v)))) for v in (0, 2, 4)]
            rows.append((str(day), [outer, hole] if rng.random() < 0.5 else [outer]))
    got = {r["solar_day"]: r["share"] for r in C.union_share(frame(spark, rows), aoi, ["solar_day"]).collect()}
    lo, hi = C.authalic_of(np.array(40.0)), C.authalic_of(np.array(51.0))
    x, y = np.meshgrid(np.linspace(0, 10, 901), np.linspace(lo, hi, 901))
    x, y = x + 1e-7, y + 1e-9
    area = inside(flat(aoi), x, y)
    for day in got:
        hit = np.zeros(x.shape, dtype=bool)
        for d, rings in rows:
            if d == day:
                hit |= inside(flat(rings), x, y)
        assert got[day] == pytest.approx((hit & area).sum() / area.sum(), abs=3e-3)


def test_bands_do_not_matter_and_boxes_agree(spark):
    rng = np.random.default_rng(1)
    boxes = [(str(k % 3), *np.sort(rng.uniform(-0.3, 1.3, 2)), *np.sort(rng.uniform(-0.3, 1.3, 2))) for k in range(30)]
    df = frame(spark, [(d, [C.box_ring((x0, y0, x1, y1))]) for d, x0, x1, y0, y1 in boxes])
    aoi = [C.box_ring((0, 0, 1, 1))]
    one = {r["solar_day"]: r["share"] for r in C.union_share(df, aoi, ["solar_day"], band_footprints=1000).collect()}
    many = {r["solar_day"]: r["share"] for r in C.union_share(df, aoi, ["solar_day"], band_footprints=1).collect()}
    assert one == pytest.approx(many, rel=1e-12)
    flat = spark.createDataFrame([(d, *map(float, v)) for d, *v in boxes], "solar_day string, x0 double, x1 double, y0 double, y1 double")
    by_boxes = {r["solar_day"]: r["share"] for r in SC.boxes_union_share(flat, (0, 0, 1, 1), ["solar_day"]).collect()}
    assert one == pytest.approx(by_boxes, rel=1e-4)  # a sphere and an ellipsoid


def test_edges(spark):
    aoi = [C.box_ring((0, 0, 2, 2))]
    rows = [("a", [C.box_ring((0, 0, 1, 2))]), ("a", [C.box_ring((0, 0, 1, 2))]), ("b", None), ("c", [[(0, 0), (1, 1)]]), ("d", [C.box_ring((5, 5, 6, 6))]), ("e", [C.box_ring((-9, -9, 9, 9))]), (None, [C.box_ring((0, 0, 1, 2))]), ("f", [])]
    rows.append(("g", [C.box_ring((-1, -1, 3, 3)), C.box_ring((0, 0, 1, 2))]))
    got = {r["solar_day"]: r["share"] for r in C.union_share(frame(spark, rows).withColumns({"__band": F.lit("x"), "share": F.lit(1)}), aoi, ["solar_day"]).collect()}
    assert got == pytest.approx({"a": 0.5, "b": 0, "c": 0, "d": 0, "e": 1, None: 0.5, "f": 0, "g": 0.5}, abs=1e-9)
    assert C.union_share(frame(spark, []), aoi, ["solar_day"]).count() == 0
    with pytest.raises(ValueError, match="no extent"):
        C.union_share(frame(spark, rows), [[(0, 1), (1, 1), (2, 1)]], ["solar_day"])
    with pytest.raises(ValueError, match="no area"):
        C.feature_shares(frame(spark, rows), {}, ["solar_day"])


def test_prefilter_keeps_what_cannot_be_judged_and_refuses_to_drop_all(spark):
    rows = [("a", [C.box_ring((0, 0, 1, 2))]), ("b", [C.box_ring((0, 0, 0.1, 2))]), ("b", None), (None, [C.box_ring((0, 0, 0.1, 2))])]
    df = frame(spark, rows)
    assert sorted(r["item_id"] for r in SC.by_footprint(df, [C.box_ring((0, 0, 2, 2))], 0.4).collect()) == [0, 2, 3]
    with pytest.raises(ValueError, match="covers 50.00%"):
        SC.by_footprint(df, [C.box_ring((0, 0, 2, 2))], 0.9)
    assert SC.by_footprint(frame(spark, [("b", None)]), [C.box_ring((0, 0, 2, 2))], 0.9).count() == 1


def test_outlines_of_a_slanted_swath_are_not_their_boxes(spark):
    swath = [[(0, 0), (1, 0), (2, 2), (1, 2)]]
    df = frame(spark, [("a", swath)])
    assert C.union_share(df, [C.box_ring((0, 0, 2, 2))], ["solar_day"]).first()["share"] == pytest.approx(0.5, abs=1e-3)


def test_rings_of_a_grid_in_degrees(spark):
    g = Grid("EPSG:32632", 10, -10, 500_000, 5_000_000, 10, 10)
    (lon, lat), (east, _) = _in_degrees([[(500_000, 5_000_000), (510_000, 5_000_000)]], g)[0]
    assert lon == pytest.approx(9.0, abs=1e-9) and lat == pytest.approx(45.153, abs=1e-2) and 9.12 < east < 9.14
    assert _in_degrees([[(1, 2)]], g) == [[(1, 2)]]


def test_probe_widens_until_it_finds_scenes(spark):
    rows = [(k, d, "EPSG:3263" + str(k % 2)) for k, d in enumerate(("2023-01-01", "2024-01-01", "2024-02-20", "2024-02-21"))]
    df = spark.createDataFrame(rows, "item_id int, d string, crs string").withColumn("datetime", F.to_timestamp_ntz("d"))
    ids = lambda *a: sorted(r["item_id"] for r in SC.probe(df, *a).collect())
    assert ids(None, "2024-02-25") == [2, 3] and ids(None, "2024-03-20") == [2, 3] and ids(None, "2024-06-01") == [1, 2, 3]
    assert ids("2024-05-01", "2024-06-01") == [] and ids(None, "2030-01-01") == []
    assert SC.native_crs_probe(df, None, "2030-01-01").count() == 0
    geo = df.withColumn("geometry", F.array(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in C.box_ring((0, 0, 1, 2))))))
    got = SC.native_crs_probe(geo, None, "2024-02-25", [C.box_ring((0, 0, 2, 2))]).collect()
    assert [(r["crs"], r["scenes"], round(r["share"], 6)) for r in got] == [("EPSG:32630", 1, 0.5), ("EPSG:32631", 1, 0.5)]
