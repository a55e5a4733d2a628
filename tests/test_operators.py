from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridian import views as V
from meridian.operators import composites, coregistration, filters, grid, joins, masks, mosaic, neighbourhood, resample, scenes, statistics, update


def px(spark, rows, bands="nir double"):
    return spark.createDataFrame(rows, f"time string, row int, col int, {bands}").withColumn("time", F.to_timestamp_ntz("time"))


def test_class_mask_keeps_or_drops(spark):
    d = px(spark, [("2024-01-01", 0, k, 0.5, s) for k, s in enumerate((0, 4, 8, None))], "nir double, scl int")
    got = {r["col"]: r["nir"] for r in masks.class_mask(d, "s2", ["nir"]).collect()}
    assert got == {0: None, 1: 0.5, 2: None, 3: None}
    kept = masks.class_mask(d, "s2", ["nir"], keep_clouds=True, keep_layer=True)
    assert {r["col"]: r["nir"] for r in kept.collect()} == {0: None, 1: 0.5, 2: 0.5, 3: None} and "scl" in kept.columns


def test_mask_names():
    assert masks.masking_status("cloud_mask_scl") == "scl_masked"
    assert masks.masking_status("cloudshadow_mask_70") == "cloudshadow_masked_70"
    assert masks.masking_status("mine") is None
    with pytest.raises(ValueError):
        masks.threshold_masks(None, [0.0])


def test_mask_bands_need_the_same_days(spark):
    a = px(spark, [("2024-01-01", 0, 0, 1.0), ("2024-01-02", 0, 0, 1.0)])
    b = px(spark, [("2024-01-01", 0, 0, 2.0)])
    with pytest.raises(ValueError, match="2024-01-02"):
        masks.add_mask_bands(a, b, ["nir"])
    assert masks.add_mask_bands(b, b.withColumn("nir", F.lit(3.0)), ["nir"]).first()["nir"] == 3.0


def test_composite_requests():
    assert [(r.op, r.period) for r in composites.parse_requests(["mean", "mean_all", "max_monthly"])] == [("max", "monthly"), ("mean", "timeseries")]
    for bad in ("sum", "mean_weekly"):
        with pytest.raises(ValueError):
            composites.parse_requests(bad)
    with pytest.raises(ValueError):
        composites.Custom("mean", "2024-01-01", "02-01")


def test_priority_coalesce_skips_missing(spark):
    d = px(spark, [("2024-01-01", 0, 0, None, 1), ("2024-01-01", 0, 0, 2.0, 2), ("2024-01-01", 0, 0, 3.0, 3)], "nir double, ord int")
    assert composites.solar_day_mosaic(d, ["nir"], F.col("ord"), ("time", "row", "col")).first()["nir"] == 2.0


def test_update_equals_rebuild(spark, sf):
    cube = V.cube(spark, sf).select("time", "row", "col", "nir")
    a, b = cube.filter(F.month("time") < 7), cube.filter(F.month("time") >= 5)
    out = update.append_dates(a, b)
    assert out.exceptAll(cube).isEmpty() and cube.exceptAll(out).isEmpty()


def test_scene_filters_commute(spark, sf):
    cloud, imaged = masks.cloud_and_imaged(F.col("scl"), "s2")
    s = statistics.scene_statistics(V.pixels(spark, sf), cloud, imaged, 64)
    a = filters.by_cloud(filters.by_coverage(s, 0.05), 50).count()
    assert a == filters.by_coverage(filters.by_cloud(s, 50), 0.05).count() > 0
    with pytest.raises(filters.NothingLeft):
        filters.require_rows(filters.by_cloud(s, -1), "none")


def test_mosaic_of_pieces_is_the_whole(spark):
    rows = [("2024-01-01", r, c, float(r * 40 + c)) for r in range(40) for c in range(40)]
    whole = px(spark, rows)
    pieces = []
    for r0 in (0, 20):
        for c0 in (0, 20):
            p = whole.filter(F.col("row").between(r0, r0 + 19) & F.col("col").between(c0, c0 + 19)).withColumns({"row": F.col("row") - r0, "col": F.col("col") - c0})
            pieces.append(mosaic.Piece(p, grid.Grid("EPSG:32632", 10, -10, 100 + 10 * c0, 900 - 10 * r0, 20, 20), f"{r0}{c0}", ("nir",)))
    out, g, _ = mosaic.mosaic(pieces)
    assert (g.width, g.height, g.c, g.f) == (40, 40, 100, 900)
    assert out.exceptAll(whole.select(out.columns)).isEmpty() and out.count() == 1600
    off = mosaic.Piece(whole, grid.Grid("EPSG:32632", 10, -10, 104, 900, 40, 40), "x", ("nir",))
    with pytest.raises(ValueError, match="phase"):
        mosaic.mosaic([pieces[0], off])
    with pytest.raises(ValueError, match="mission"):
        mosaic.check_compatible([mosaic.Piece(whole, g, "a", (), {"mission": 1}), mosaic.Piece(whole, g, "b", (), {"mission": 2})])


def test_asof_without_key(spark):
    left = spark.createDataFrame([(k, f"2024-0{m}-10") for k, m in enumerate((1, 3, 7))], "id int, t string").withColumn("time", F.to_timestamp_ntz("t"))
    right = spark.createDataFrame([("2024-01-12", 1.0), ("2024-06-01", 2.0)], "t string, v double").withColumn("time", F.to_timestamp_ntz("t"))
    got = {r["id"]: r["v"] for r in joins.asof_nearest(left.drop("t"), right.drop("t"), "v").collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 2.0}


def test_asof_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    day = lambda k: f"2024-{1 + k // 28:02d}-{1 + k % 28:02d}"
    left = [(k, None if k % 7 == 0 else k % 2, int(rng.integers(0, 330))) for k in range(60)]
    right = [(None if k % 5 == 0 else k % 2, int(rng.integers(0, 330)), float(k)) for k in range(25)]
    a = spark.createDataFrame([(i, k, day(t)) for i, k, t in left], "id int, k int, t string").select("id", "k", F.to_timestamp_ntz("t").alias("time"))
    b = spark.createDataFrame([(k, day(t), v) for k, t, v in right], "k int, t string, v double").select("k", F.to_timestamp_ntz("t").alias("time"), "v")
    at = lambda k: np.datetime64(day(k))
    for by, days in (([], None), (["k"], None), (["k"], 20)):
        got = {r["id"]: r["v"] for r in joins.asof_nearest(a, b if by else b.drop("k"), "v", by, tolerance=f"{days} DAYS" if days else None).collect()}
        for i, k, t in left:
            near = sorted((abs((at(t) - at(u)).astype(int)), at(u), -v) for j, u, v in right if not by or j == k)
            want = -near[0][2] if near and (days is None or near[0][0] <= days) else None
            assert got[i] == want


def test_fill_nearest_is_nearest():
    rng = np.random.default_rng(0)
    a = np.where(rng.random((23, 31)) < 0.9, np.nan, rng.random((23, 31)))
    out, good = resample.fill_nearest(a), np.argwhere(~np.isnan(a))
    for r, c in np.argwhere(np.isnan(a)):
        d = ((good - (r, c)) ** 2).sum(axis=1)
        assert out[r, c] in {a[tuple(g)] for g in good[d == d.min()]}
    assert np.array_equal(out[~np.isnan(a)], a[~np.isnan(a)]) and np.isnan(resample.fill_nearest(np.full((3, 3), np.nan))).all()


def test_cloud_pixels_take_the_layer_made_for_the_threshold(spark):
    d = px(spark, [("2024-01-01", 0, 0, 90, 0, 1), ("2024-01-01", 0, 1, 0, 1, 0)], "cloud_prob int, cloud_mask_45 int, cloud_mask_70 int")
    cols = lambda df: {r["col"] for r in df.collect()}
    assert cols(neighbourhood.cloud_pixels(d, 45, (1, 2))) == {1}
    assert cols(neighbourhood.cloud_pixels(d.drop("cloud_mask_45"), 45, (1, 2), 0, 0)) == {0}
    assert cols(neighbourhood.cloud_pixels(d.drop("cloud_prob", "cloud_mask_45"), 45, (1, 2))) == {0}
    with pytest.raises(ValueError, match="cloud_prob"):
        neighbourhood.cloud_pixels(d.select("time", "row", "col"), 45, (1, 2))
    clouds = neighbourhood.cloud_pixels(d, 45, (1, 2))
    with pytest.raises(Exception, match="azimuth"):
        neighbourhood.with_azimuth(clouds, spark.createDataFrame([], "day date, sun_azimuth double")).collect()


def test_other_zone_and_bounds(spark):
    there, back = grid.between("EPSG:32632", "EPSG:32633"), grid.between("EPSG:32633", "EPSG:32632")
    assert grid.between("EPSG:32632", "EPSG:32632") is None
    x, y = there(F.lit(700000.0), F.lit(5000000.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).select("x", "y", *back(F.col("x"), F.col("y"))).first()
    assert abs(r[2] - 700000) < 1e-3 and abs(r[3] - 5000000) < 1e-3 and 200000 < r[0] < 300000
    ring = [(8.0, 45.0), (10.0, 45.0), (10.0, 46.0), (8.0, 46.0)]
    few, many = grid.bounds_in(spark, ring, "EPSG:32632", 1), grid.bounds_in(spark, ring, "EPSG:32632")
    assert many[1] < few[1] - 100 and many[3] == few[3] and abs(many[0] - few[0]) < 1
    with pytest.raises(ValueError, match="UTM"):
        grid.between("EPSG:3035", "EPSG:32632")


def test_required_days(spark):
    a, b = px(spark, [("2024-01-01", 0, 0, 1.0)]), px(spark, [("2024-01-02", 0, 0, 1.0)])
    with pytest.raises(ValueError, match="2024-01-01"):
        joins.require_days(a, b, "mask")
    g = grid.Grid("EPSG:32632", 10, -10, 0, 20, 2, 2)
    xy = spark.createDataFrame([(5.0, 15.0), (15.0, 5.0)], "x double, y double")
    assert sorted((r["row"], r["col"]) for r in joins.snap_to_grid(xy, g).collect()) == [(0, 0), (1, 1)]
    with pytest.raises(Exception, match="grid"):
        joins.snap_to_grid(spark.createDataFrame([(55.0, 15.0)], "x double, y double"), g).collect()


def test_grids():
    g = grid.Grid.from_centres("EPSG:32632", [105, 115, 125], [895, 885])
    assert (g.a, g.e, g.c, g.f, g.width, g.height) == (10, -10, 100, 900, 3, 2)
    with pytest.raises(ValueError):
        grid.Grid.from_centres("EPSG:32632", [1, 2, 4], [1, 2])
    with pytest.raises(ValueError, match="0.5000"):
        grid.require_same_grid(grid.Grid("a", 10, -10, 105, 900, 3, 2), grid.Grid("a", 10, -10, 100, 900, 3, 2))
    assert [grid.snap_unit("s2", 10, b) for b in (["red"], ["red", "swir16"], ["coastal"])] == [10, 20, 60]
    assert grid.snap_unit("s2", 25, ["swir16"]) == 100 and grid.snap_unit("s2", 7, ["coastal"]) == 7 and grid.snap_unit("s2", None) is None
    assert grid.snap_bounds((665939.9999999999, 0, 665950.0000001, 10), 10) == (665940, 0, 665950, 10)
    assert grid.near_square(6, 300, 200) == (2, 3) and grid.near_square(2, 100, 100) == (1, 2)
    assert grid.clipped_area([(0, 0), (4, 0), (4, 4), (0, 4)], (2, 2, 6, 6)) == 4
    assert grid.validate_crs("epsg:32632") == "EPSG:32632" and grid.aoi_utm((10, 45, 11, 46)) == "EPSG:32632" and grid.aoi_utm((179, 0, -179, 1)) is None
    with pytest.raises(ValueError):
        grid.validate_crs("EPSG:4326")


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 200), st.integers(1, 200))
def test_splits_cover(total, parts):
    if parts > total:
        with pytest.raises(ValueError):
            grid.split_evenly(total, parts)
    else:
        s = grid.split_evenly(total, parts)
        assert sum(s) == total and len(s) == parts and max(s) - min(s) <= 1 and s == sorted(s, reverse=True)


def test_tiles_are_disjoint_and_cover(spark):
    p = grid.tile_grid(spark, (1003, 2001, 1987, 2688), 10.0, chip_size=16, chips_per_piece=3).collect()
    assert sum((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) for r in p) == (max(r["x1"] for r in p) - min(r["x0"] for r in p)) * (max(r["y1"] for r in p) - min(r["y0"] for r in p))
    assert all(r["x0"] % 160 == 0 and r["y0"] % 160 == 0 for r in p)
    named = grid.fill_pieces(grid.tile_grid(spark, (0, 0, 100, 100), 10.0, n_pieces=4), [(0, 0), (60, 0), (0, 40)]).orderBy("piece").collect()
    assert [r["piece"] for r in named][0] == "p01" and sum(r["aoi_km2"] for r in named) == pytest.approx(1200 / 1e6)


def test_utm(spark):
    e, n = grid.utm(F.lit(9.0), F.lit(45.0), F.lit(32))
    r = spark.range(1).select(e, n, grid.utm_zone(F.lit(9.0))).first()
    assert r[0] == pytest.approx(500000.0, abs=1e-6) and r[1] == pytest.approx(4982950.40, abs=0.05) and r[2] == 32


def test_shadow_goes_away_from_the_sun(spark):
    cloud = px(spark, [("2024-01-01", 10, 10, 0.0)]).withColumn("sun_azimuth", F.col("nir")).drop("nir")
    for az, (dr, dc) in {0: (1, 0), 90: (0, -1), 180: (-1, 0), 270: (0, 1)}.items():
        z = neighbourhood.shadow_zone(cloud.withColumn("sun_azimuth", F.lit(float(az))), 60, 180, 60)
        assert sorted((r["row"], r["col"]) for r in z.collect()) == sorted((10 + k * dr, 10 + k * dc) for k in (1, 2, 3))
        assert neighbourhood.shadow_steps(az, 60, 180, 60) == [(k * dr, k * dc) for k in (1, 2, 3)]


def test_disks_and_majority_against_numpy(spark):
    # Rows of a filled circle of radius 2 and 4 as drawn by the midpoint rule.
    assert ["".join(".#"[v] for v in row) for row in neighbourhood.disk(2).astype(int)] == ["..#..", ".###.", "#####", ".###.", "..#.."]
    assert [int(row.sum()) for row in neighbourhood.disk(4)] == [1, 5, 7, 7, 9, 7, 7, 5, 1]
    rng = np.random.default_rng(0)
    m = rng.random((12, 12)) < 0.55
    d = px(spark, [("2024-01-01", int(r), int(c), 1.0) for r, c in np.argwhere(m)])
    k = neighbourhood.disk(2)
    pad = np.pad(m, 2, mode="symmetric")
    mean = np.array([[(pad[r : r + 5, c : c + 5] & k).sum() / k.sum() for c in range(12)] for r in range(12)])
    got = {(r["row"], r["col"]) for r in neighbourhood.majority(d, 2, (12, 12)).collect()}
    assert got == {tuple(map(int, x)) for x in np.argwhere(mean > 0.5)}


def test_tiled_kernel_equals_whole(spark):
    rng = np.random.default_rng(0)
    a = rng.random((50, 50))
    d = px(spark, [("2024-01-01", r, c, float(a[r, c])) for r in range(50) for c in range(50)])
    out = resample.warp(d, ["nir"], 0.3, -1.25, tile=16)
    want = resample.warp_array(a, 0.3, -1.25)
    for r in out.collect():
        w = want[r["row"], r["col"]]
        assert (r["nir"] is None) == bool(np.isnan(w)) and (r["nir"] is None or r["nir"] == pytest.approx(w))


def test_phase_shift_and_consensus():
    rng = np.random.default_rng(2)
    a = rng.random((64, 64))
    for s in ((3, -2), (0, 1), (-3, 3)):
        r, c, rel = coregistration.phase_shift(a, np.roll(a, s, (0, 1)))
        assert (round(r), round(c)) == s and rel > 50


def test_coregistration_undoes_shifts(spark):
    rng = np.random.default_rng(3)
    a = np.kron(rng.random((16, 16)), np.ones((4, 4)))
    shifts = [(0, 0)] * 3 + [(2, -1)]
    rows = [("c", f"2024-01-0{k + 1}", r, c, float(np.roll(a, s, (0, 1))[r, c])) for k, s in enumerate(shifts) for r in range(64) for c in range(64)]
    d = spark.createDataFrame(rows, "cube_id string, time string, row int, col int, red double").withColumn("time", F.to_timestamp_ntz("time"))
    out, found = coregistration.coregister(d, ["red"], "red", size=32)
    got = [(r["shift_row"], r["shift_col"]) for r in found.orderBy("time").collect()]
    assert np.allclose(got, shifts, atol=0.3)
    assert out.select("time").distinct().count() == 4


@pytest.mark.parametrize("mode", ["composite", "anchor"])
def test_shifts_are_chained(spark, mode):
    rng = np.random.default_rng(6)
    a, b = rng.random((64, 64)), rng.random((64, 64))
    half = (a + b) / 2
    # From the first scene to the last the ground changes altogether; only neighbours look alike.
    scenes = [(a, (0, 0)), (half, (2, -1)), (b, (4, 1))]
    days = ["2024-01-01", "2024-03-01", "2024-05-01"]
    rows = [("c", t, r, c, float(np.roll(x, s, (0, 1))[r, c])) for t, (x, s) in zip(days, scenes, strict=True) for r in range(64) for c in range(64)]
    d = spark.createDataFrame(rows, "cube_id string, time string, row int, col int, red double").withColumn("time", F.to_timestamp_ntz("time")).withColumn("cc", F.lit(50.0))
    how = {"mode": mode, **({"anchor": days[2]} if mode == "anchor" else {})}
    got = [(r["shift_row"], r["shift_col"]) for r in coregistration.estimate_shifts(d, "red", size=32, **how).orderBy("time").collect()]
    start = scenes[2][1] if mode == "anchor" else (0, 0)
    assert np.allclose(got, np.array([s for _, s in scenes]) - start, atol=0.4)
    fixed = coregistration.estimate_shifts(d, "red", size=32, cloud="cc", max_cloud_update_ref=10.0, **how).orderBy("time").collect()
    far = fixed[0 if mode == "anchor" else 2]
    assert not np.allclose((far["shift_row"], far["shift_col"]), np.array(scenes[0 if mode == "anchor" else 2][1]) - start, atol=0.4)


def test_a_chain_holds_two_scenes(monkeypatch):
    """However long a chain is, the frames alive at a time are the reference, the one that is matched and the next."""
    import weakref

    rng, alive, most = np.random.default_rng(1), weakref.WeakSet(), 0

    class Frame(np.ndarray):
        pass

    base = rng.random((48, 48))

    def frames():
        nonlocal most
        for k in range(60):
            a = np.roll(base, (k % 3, -(k % 2)), (0, 1)).view(Frame)
            alive.add(a)
            most = max(most, len(alive))
            yield k, a, None
            del a

    monkeypatch.setattr(Frame, "__hash__", lambda self: id(self), raising=False)
    monkeypatch.setattr(Frame, "__eq__", lambda self, other: self is other, raising=False)
    m = coregistration.Matching(size=24, windows=9)
    monkeypatch.setattr(coregistration.Matching, "shift", lambda self, ref, tgt: coregistration.Votes(0.0, 0.0, 9, 0.0, 9))
    assert len(list(coregistration.chain(frames(), base, m))) == 60 and most <= 3


def test_votes_equal_the_consensus_of_tables(spark):
    rng = np.random.default_rng(4)
    rows = [(g, *map(float, (*rng.normal((g, -g), 0.15 if k % 4 else 3.0), rng.uniform(20, 90)))) for g in range(6) for k in range(int(rng.integers(1, 30)))]
    df = spark.createDataFrame(rows, "g int, x double, y double, reliability double")
    for r in coregistration.consensus(df, ["g"]).collect():
        v = coregistration.Votes.count([q[1:] for q in rows if q[0] == r["g"]])
        assert (v.x, v.y, v.spread) == pytest.approx((r["x"], r["y"], r["spread"])) and (v.inliers, v.windows) == (r["inliers"], r["windows"])


def test_coarse_windows_decide_where_they_agree(monkeypatch):
    rng, looked = np.random.default_rng(8), []
    a = rng.random((128, 128))
    real = coregistration.phase_shift
    monkeypatch.setattr(coregistration, "phase_shift", lambda *x: looked.append(1) or real(*x))
    m = coregistration.Matching(size=32, windows=30, coarse=6)
    v = m.shift(a, np.roll(a, (2, 1), (0, 1)))
    assert (round(v.y), round(v.x)) == (2, 1) and len(looked) == v.windows == 6
    looked.clear()
    noisy = np.roll(a, (2, 1), (0, 1))
    noisy[:, :64] = rng.random((128, 64))
    v = m.shift(a, noisy)
    assert len(looked) == v.windows > 6


def test_windows_are_clear_with_their_surroundings():
    clear = np.ones((96, 96), dtype=bool)
    clear[40, 40] = False
    places = coregistration.window_positions(clear, 32, 20, stride=4, apart=8)
    assert places and all(clear[r - 1 : r + 33, c - 1 : c + 33].all() and r >= 1 and c >= 1 and r + 33 <= 96 for r, c in places)
    spread = [min(abs(p[0] - q[0]) + abs(p[1] - q[1]) for q in places[:k]) for k, p in enumerate(places) if k]
    assert spread == sorted(spread, reverse=True)
    holes = np.random.default_rng(0).random((96, 96)) > 0.05
    assert coregistration.window_positions(holes, 32, 5, 8, 16) and not coregistration.window_positions(np.zeros((96, 96), dtype=bool), 32, 5, 8, 16)


def test_masked_pixels_do_not_steer_the_match(spark):
    rng = np.random.default_rng(3)
    a, cloud = rng.random((72, 72)), rng.random((72, 72)) + 3
    rows = []
    for k, s in enumerate(((0, 0), (0, 0), (3, -2))):
        x = np.roll(a, s, (0, 1))
        rows += [("c", f"2024-01-0{k + 1}", r, c, float(cloud[r, c] if r < 30 else x[r, c]), r < 30) for r in range(72) for c in range(72)]
    d = spark.createDataFrame(rows, "cube_id string, time string, row int, col int, red double, cloudy boolean").withColumn("time", F.to_timestamp_ntz("time"))
    got = {str(r["time"])[:10]: (r["shift_row"], r["shift_col"]) for r in coregistration.estimate_shifts(d, "red", size=24, clear=~F.col("cloudy"), mode="anchor", anchor="2024-01-01").collect()}
    assert np.allclose(got["2024-01-03"], (3, -2), atol=0.2)


def test_anchor_is_chosen_by_time(spark):
    rows = [("2024-01-01", 0.0, 0.0, 9.0), ("2024-01-20", 0.0, 0.0, 2.0), ("2024-01-22", 50.0, 0.0, 8.0), ("2024-01-25", None, 0.0, 3.0), ("2024-02-10", 0.0, 0.5, 7.0)]
    df = spark.createDataFrame(rows, "time string, cloud_percentage double, missing double, gradient double").withColumn("time", F.to_timestamp_ntz("time"))
    assert str(coregistration.auto_anchor(df).first()["time"])[:10] == "2024-01-25"
    assert str(coregistration.auto_anchor(df.filter("cloud_percentage = 50 or missing = 0.5")).first()["time"])[:10] == "2024-01-22"


def test_patches_and_upsampling():
    assert resample.patch_positions(100) == [0] and resample.patch_positions(400)[-1] == 272
    a = np.arange(200 * 180, dtype=float).reshape(1, 200, 180)
    up = lambda x: np.stack([np.kron(b, np.ones((2, 2))) for b in x])
    assert (resample.predict_patches(a, up, 2) == up(a)).all()
    b = np.array([[1.0, np.nan], [np.nan, np.nan]])
    assert (resample.fill_nearest(b) == 1).all()


def test_super_resolution_equals_whole(spark):
    rng = np.random.default_rng(4)
    a = rng.random((40, 40))
    d = px(spark, [("2024-01-01", r, c, float(a[r, c])) for r in range(40) for c in range(40)])
    got = np.full((80, 80), np.nan)
    for r in resample.super_resolve(d, ["nir"], 2, tile=16).collect():
        got[r["row"], r["col"]] = r["nir"]
    assert np.allclose(got, resample.upsample_bilinear(a, 2))


def test_bilinear_keeps_planes(spark):
    d = px(spark, [("2024-01-01", r, c, float(3 * r + c)) for r in range(10) for c in range(10)])
    s, t = grid.Grid("m", 10, -10, 0, 100, 10, 10), grid.Grid("m", 5, -5, 20, 80, 8, 8)
    for r in resample.reproject_bilinear(d, s, t, ["nir"]).collect():
        y, x = (100 - (80 - 5 * (r["row"] + 0.5))) / 10 - 0.5, (20 + 5 * (r["col"] + 0.5)) / 10 - 0.5
        assert r["nir"] == pytest.approx(3 * y + x)


def test_slope_of_a_plane(spark):
    d = spark.createDataFrame([(r, c, float(10 * c)) for r in range(5) for c in range(5)], "row int, col int, dem double")
    got = {(r["row"], r["col"]): r for r in neighbourhood.slope_aspect(d, "dem", 10.0).collect()}
    assert got[2, 2]["slope"] == pytest.approx(45.0) and got[2, 2]["aspect"] == pytest.approx(270.0) and got[0, 0]["slope"] is None


def test_footprint_shares_against_a_raster(spark):
    rng = np.random.default_rng(5)
    boxes = [(int(k % 4), *map(float, (x, y, x + 0.4, y + 0.3))) for k, (x, y) in enumerate(rng.random((30, 2)).round(2) - 0.2)]
    df = spark.createDataFrame(boxes, "day int, x0 double, y0 double, x1 double, y1 double")
    lat = (np.arange(1000) + 0.5) / 1000
    w = np.cos(np.radians(lat))
    for r in scenes.boxes_union_share(df, (0, 0, 1, 1), ["day"]).collect():
        hit = np.zeros((1000, 1000), bool)
        for _, x0, y0, x1, y1 in (b for b in boxes if b[0] == r["day"]):
            hit |= ((lat > x0) & (lat < x1))[:, None] & ((lat > y0) & (lat < y1))[None, :]
        assert r["share"] == pytest.approx((hit * w).sum() / (w.sum() * 1000), abs=2e-3)


def test_failed_catalogue_is_null(spark):
    df = spark.createDataFrame([("2024-01-01", "a")], "day string, source string")
    r = scenes.availability(df, ["a", "b"], ["element84"]).first()
    assert (r["a"], r["b"], r["Element84"]) == (1, 0, None)
    assert scenes.findings(0, None, None, 0) and scenes.findings(3, 1.0, 1.0, 1) == ["Every date covers the area."]


def test_rolling_needs_a_full_window(spark):
    s = spark.createDataFrame([(k, float(k)) for k in range(9)], "t int, v double")
    got = [r["v_rolling"] for r in statistics.rolling_mean(s, "v", 7, "t").orderBy("t").collect()]
    assert got == [None] * 3 + [3.0, 4.0, 5.0] + [None] * 3
    d = px(spark, [(f"2024-01-{t:02d}", r, c, float((r * 7 + c * 3 + t * t) % 11)) for t in range(1, 6) for r in range(5) for c in range(5)])
    assert statistics.edge_roughness(d, "nir").first()["roughness"] > 0


def test_arrays_project_as_columns_do(spark):
    rng = np.random.default_rng(0)
    x, y = rng.uniform(200_000, 800_000, 50), rng.uniform(100_000, 8_000_000, 50)
    for a, b in (("EPSG:32632", "EPSG:32633"), ("EPSG:32733", "EPSG:32732"), ("EPSG:32631", "EPSG:32731")):
        move = grid.between(a, b)
        rows = spark.createDataFrame([(float(p), float(q)) for p, q in zip(x, y, strict=True)], "x double, y double")
        want = np.array([tuple(r) for r in rows.select(*move(F.col("x"), F.col("y"))).collect()])
        assert np.allclose(np.array(grid.between_arrays(a, b)(x, y)).T, want, rtol=0, atol=1e-3)
    assert grid.between_arrays("EPSG:32632", "EPSG:32632")(x, y)[0] is x


@pytest.mark.parametrize("method", ["bilinear", "cubic"])
def test_tiles_resample_as_the_relational_form_does(spark, method):
    rng = np.random.default_rng(7)
    rows = [(f"2024-01-0{1 + t}", r, c, None if rng.random() < 0.2 else float(rng.random()), int(rng.integers(0, 12)) if rng.random() < 0.9 else None) for t in range(2) for r in range(40) for c in range(50) if rng.random() < 0.9]
    px = spark.createDataFrame(rows, "time string, row int, col int, nir double, scl int")
    a, b = grid.Grid("EPSG:32632", 10, -10, 700_000, 5_300_000, 50, 40), grid.Grid("EPSG:32632", 7, -7, 700_033, 5_299_990, 61, 53)
    same = lambda x, y: (x, y)
    want = resample.reproject_weighted(px, a, b, ["nir", "scl"], same, method=method)
    key = lambda r: (r["time"], r["row"], r["col"])
    for tile in (16, 256):
        got = {key(r): (r["nir"], r["scl"]) for r in resample.resample_tiles(px, a, b, ["nir", "scl"], method, tile=tile).collect()}
        for r in want.collect():
            v, k = got.pop(key(r))
            assert k == r["scl"] and (v is None) == (r["nir"] is None) and (v is None or v == pytest.approx(r["nir"], rel=1e-9))
        assert not got
    twice = resample.resample_tiles(px.unionByName(px), a, b, ["nir", "scl"], method)
    assert twice.count() == want.count()
    coarse = grid.Grid("EPSG:32632", 80, -80, 700_000, 5_300_000, 6, 5)
    assert resample.resample_tiles(px, a, coarse, ["nir"], method).count() > 0


def test_mosaic_of_two_zones(spark):
    west, east = grid.Grid("EPSG:32632", 1000, -1000, 720_000, 5_323_000, 8, 8), grid.Grid("EPSG:32633", 1000, -1000, 273_055, 5_323_000, 9, 9)
    flat = lambda g, v: spark.createDataFrame([("2024-01-01", r, c, v) for r in range(g.height) for c in range(g.width)], "time string, row int, col int, nir double")
    pieces = [mosaic.Piece(flat(west, 1.0), west, "w", ("nir",)), mosaic.Piece(flat(east, 2.0), east, "e", ("nir",))]
    with pytest.raises(ValueError, match="another grid"):
        mosaic.mosaic(pieces)
    for how in ({"on_grid_mismatch": "resample"}, {"crs": "EPSG:32632"}, {"resolution": 500.0, "resampling": "bilinear"}):
        out, onto, _ = mosaic.mosaic(pieces, **how)
        rows = out.filter("nir is not null").collect()
        assert onto.crs in ("EPSG:32632", "EPSG:32633") and abs(onto.a) == how.get("resolution", 1000)
        assert {r["nir"] for r in rows} <= {1.0, 2.0} and len({r["nir"] for r in rows}) == 2
        assert all(0 <= r["row"] < onto.height and 0 <= r["col"] < onto.width for r in rows)
        area = len(rows) * onto.a**2 / 1e6
        assert 64 <= area <= 64 + 81
    with pytest.raises(ValueError, match="error or resample"):
        mosaic.mosaic(pieces, on_grid_mismatch="x")


def test_columns_say_what_functions_say(spark):
    sizes = spark.range(1, 700, 7)
    assert all(r["s"] == resample.patch_positions(r["id"]) for r in sizes.select("id", resample.patch_starts(F.col("id").cast("int")).alias("s")).collect())
    assert all(r["u"] == grid.snap_unit("s2", r["id"], ["coastal"]) for r in sizes.select("id", grid.snap_unit_column(F.col("id"), 60.0).alias("u")).collect())
    bytes_ = spark.createDataFrame([(float(v),) for v in (0, 1, 1023, 1024, 1536, 5e6, 3e9, 7e12, 9e15, -2048)], "n double")
    assert all(r["t"] == grid.human_size(r["n"]) for r in bytes_.select("n", grid.human_size_column(F.col("n")).alias("t")).collect())
    for code in ("EPSG:32632", "epsg:32760", "32700", "32761", "4326", "3035", "EPSG:6933", "x", "326011"):
        got = spark.createDataFrame([(code,)], "c string").select(grid.is_metric_crs(F.col("c"))).first()[0]
        try:
            assert bool(grid.validate_crs(code)) == got
        except ValueError:
            assert not got
    rows = spark.createDataFrame([("a", "red"), ("a", "nir"), ("b", "nir"), ("b", "nir"), ("b", "evi")], "cube string, layer string")
    want = mosaic.layer_report({"a": ["red", "nir"], "b": ["nir", "evi"]})
    got = {r["layer"]: r["kind"] for r in mosaic.layer_table(rows).collect()}
    assert {k: sorted(x for x in got if got[x] == k) for k in ("common", "only_some")} == want
