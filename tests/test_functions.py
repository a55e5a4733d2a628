from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meridian.functions import expr, indices, radiometry, registry, scene, temporal


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_missing_stays_missing(spark):
    r = one(spark, expr.clamp(F.lit(None).cast("double"), -1, 1), expr.safe_div(F.lit(1.0), F.lit(0.0)), expr.normalized_difference(F.lit(3.0), F.lit(-1.0)), expr.percent(F.lit(1), F.lit(0)), expr.percent(F.lit(1), F.lit(8)))
    assert list(r) == [None, None, 1.0, 0, 13]


def test_bands():
    assert expr.resolve_band(["NIR08", "Red"], "nir", "nir08") == "NIR08"
    with pytest.raises(ValueError, match="nir"):
        expr.resolve_band(["red"], "nir")
    assert expr.is_categorical("SCL") and expr.is_categorical("qa_pixel") and not expr.is_categorical("red")
    assert registry.common_band("b04") == "red"
    assert registry.band_map("s2", "cdse")["red"] == "B04_10m"
    assert registry.endpoint("s2", "pc")[1] == "sentinel-2-l2a"
    with pytest.raises(ValueError):
        registry.endpoint("landsat_c2_l2", "element84")


def test_indices(spark):
    px = spark.createDataFrame([(0.1, 0.2, 0.3, 0.5)], "blue double, green double, red double, nir08 double")
    r = indices.with_indices(px, ["NDVI", "evi", "savi"], "s2").first()
    assert r["ndvi"] == pytest.approx(0.25)
    assert r["evi"] == pytest.approx(2.5 * 0.2 / (0.5 + 1.8 - 0.75 + 1))
    assert r["savi"] == pytest.approx(1.5 * 0.2 / 1.3)
    with pytest.raises(ValueError, match="rvi"):
        indices.with_indices(px, ["rvi"], "s2")
    indices.register(spark)
    assert spark.sql("SELECT nd(0.5D, 0.3D), nd(NULL, 1D), savi(0.3D, 0.5D)").first()[0] == pytest.approx(0.25)


def test_scaling(spark):
    t = F.lit("2022-01-25").cast("timestamp_ntz")
    r = one(spark, radiometry.scaled(F.lit(0), "s2"), radiometry.scaled(F.lit(3000), "s2", "pc", t), radiometry.scaled(F.lit(3000), "s2", "pc", F.lit("2022-01-24").cast("timestamp_ntz")), radiometry.scaled(F.lit(500), "s2_l1c", baseline=F.lit(4.0)))
    assert r[0] is None and list(r)[1:] == pytest.approx([0.2, 0.3, -0.05])


def test_packing_round_trip(spark):
    df = spark.createDataFrame([(v,) for v in (-0.2, None, 0.5, 1.6)], "v double")
    packed, s, o = radiometry.pack_int16(df.withColumn("p", F.col("v")), ["p"])
    for r in packed.select("v", "p", radiometry.unpacked(F.col("p"), s, o).alias("b")).collect():
        assert (r["v"] is None and r["p"] == -32768 and r["b"] is None) or abs(r["v"] - r["b"]) <= s / 2 + 1e-12
    wide = spark.createDataFrame([(0.0,), (9.0,)], "p double")
    assert radiometry.pack_int16(wide, ["p"])[1] is None


def test_lut(spark):
    lut = radiometry.piecewise_lut([(0, (0, 0, 0)), (1, (255, 255, 255))])
    assert lut[0] == (0, 0, 0) and lut[-1] == (255, 255, 255) and len(lut) == 256
    assert one(spark, radiometry.apply_lut(F.lit(1.0), lut), radiometry.apply_lut(F.lit(None).cast("double"), lut))[0] == [255, 255, 255]


def test_date_ranges():
    p = temporal.parse_daterange
    assert p(["2024-01-01", "2024-02-01"], "s2") == [("2024-01-01", "2024-02-01")]
    assert p({"season": ["11-01", "03-31"], "years": "2020-2021"}, "s2") == [("2020-11-01", "2021-03-31"), ("2021-11-01", "2022-03-31")]
    assert p({"season": ["02-01", "02-29"], "years": [2023, 2024]}, "s2") == [("2023-02-01", "2023-02-28"), ("2024-02-01", "2024-02-29")]
    assert p(None, "s2") == []
    assert temporal.parse_years("2019,2021", "s2") == [2019, 2021]
    assert temporal.parse_years("all", "s1", dt.date(2016, 5, 1)) == [2014, 2015, 2016]
    for bad in (["2024-02-01", "2024-01-01"], ["x", "y"], {"season": ["13-01", "01-01"]}):
        with pytest.raises(ValueError):
            p(bad, "s2")
    with pytest.raises(ValueError):
        p(["01-01", "02-01"], "cop_dem")
    assert temporal.parse_daterange_input("season", "04-01 10-31 2020 2021") == {"season": ["04-01", "10-31"], "years": "2020,2021"}
    with pytest.raises(ValueError, match="unknown"):
        temporal.parse_daterange_input("x", "")
    assert temporal.shrinking_probe("2024-01-01", "2024-01-20", 14) == [("2024-01-06", "2024-01-20"), ("2024-01-01", "2024-01-20")]


def test_solar_day_near_the_date_line(spark):
    at = F.lit("2024-06-01 12:30:00").cast("timestamp_ntz")
    r = one(spark, temporal.solar_day(at, F.lit(179.0)), temporal.solar_day(at, F.lit(-179.0)), temporal.solar_day(at, F.lit(None).cast("double")))
    assert [str(x) for x in r] == ["2024-06-01", "2024-06-01", "2024-06-01"]
    late = F.lit("2024-06-01 13:30:00").cast("timestamp_ntz")
    assert str(one(spark, temporal.solar_day(late, F.lit(179.0)))[0]) == "2024-06-02"


def test_filters_reach_the_scan(spark, sf):
    df = temporal.filter_dates(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_shipdate", "l_tax"), [("1996-01-01", "1996-01-31")], "l_shipdate")
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan


def test_scene_properties(spark):
    def props(**kw):
        return F.create_map(*(F.lit(x) for k, v in kw.items() for x in (k.replace("__", ":"), v)))

    p = props(mgrs__utm_zone="7", mgrs__latitude_band="T", mgrs__grid_square="PK", s2__product_uri="S2A_MSIL2A_x_R065_T07TPK", s2__mean_solar_zenith="30", processing__version="05.12")
    assert list(one(spark, scene.tile(p), scene.relative_orbit(p), scene.sun_elevation(p), scene.baseline(p), scene.crs(p), scene.orbit_label(p))) == ["07TPK", 65, 60.0, 5.12, "EPSG:32607", "65"]
    q = props(grid__code="MGRS-21HUB", proj__epsg="32721", s2__datastrip_id="S2B_x_S20180615T040541_N02")
    r = one(spark, scene.tile(q), scene.crs(q), scene.granule(q), scene.orbit_label(q), scene.utm_of_tile(scene.tile(q)))
    assert (r[0], r[1], r[2]["sensed"], r[3], r[4]) == ("21HUB", "EPSG:32721", "20180615T040541", "unknown", "EPSG:32721")
    n = props(x="1")
    assert list(one(spark, scene.tile(n), scene.baseline(n), scene.crs(n))) == ["unknown", None, None]
