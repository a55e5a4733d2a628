from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from meridian import views as V
from meridian.operators.grid import Grid
from meridian.plans.cube import Cube, build, build_features
from meridian.plans.request import CubeRequest
from meridian.sources import stac, store, vector
from meridian.streaming import scenes as stream


def items(path, n=6):
    with open(path, "w") as f:
        for k in range(n):
            p = {"datetime": f"2024-01-0{k + 1}T10:00:00Z", "eo:cloud_cover": 10 * k, "grid:code": "MGRS-32TPK", "sat:orbit_state": "ascending"}
            geo = {"type": "Polygon", "coordinates": [[[9, 45], [10, 45], [10, 46], [9, 46], [9, 45]]]}
            f.write(json.dumps({"id": f"s{k}", "collection": "c", "geometry": geo if k else None, "properties": p, "assets": {"B04": {"href": "x", "proj:code": "EPSG:32632"}}}) + "\n")
    return str(path)


def test_items(spark, tmp_path):
    df = stac.read_items(spark, items(tmp_path / "i.json"))
    assert df.count() == 6 and df.filter("cloud_cover <= 20").count() == 3
    r = stac.footprints(df).orderBy("item_id").first()
    assert (r["item_id"], r["tile"], r["crs"], r["orbit"], str(r["solar_day"])) == ("s1", "32TPK", "EPSG:32632", "ascending", "2024-01-02")


def test_data_source_pushes_filters(spark, tmp_path):
    spark.dataSource.register(stac.StacSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("stac").option("path", items(tmp_path / "i.json")).option("partitions", "2").load()
    assert sorted(r["item_id"] for r in df.filter("cloud_cover <= 20").collect()) == ["s0", "s1", "s2"]
    assert df.filter("item_id = 's4'").count() == 1


def test_vectors(spark, tmp_path):
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": "1"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 1], [0, 0]]]}}]}))
    assert vector.bbox(vector.read_geojson(spark, str(path))) == (0, 0, 2, 1)
    assert vector.bbox(vector.bbox_rings(spark, (1, 2, 3, 4))) == (1, 2, 3, 4)
    assert vector.points(spark, [1.0], [2.0]).first()["point"] == "point01"
    with pytest.raises(ValueError):
        vector.points(spark, [100.0], [2.0])
    assert vector.feature_names("a/b.nc", 3) == ["a/b_01.nc", "a/b_02.nc", "a/b_03.nc"]


def test_cube_round_trip_and_swap(spark, sf, tmp_path):
    g = Grid("EPSG:32632", 10, -10, 0, 80, 8, 8)
    px = V.cube(spark, sf).select("time", "row", "col", "red", "nir").filter(F.year("time") == 1996)
    path = str(tmp_path / "cube")
    cube = Cube(px, ("red", "nir"), g, None, {"mission": "s2", "stac_api": "element84"}).indices("ndvi")
    cube.write(path)
    back = Cube.open(spark, path)
    assert back.grid == g and back.bands == ("red", "nir", "ndvi") and back.pixels.count() == px.count()
    back.between("1996-03-01", "1996-03-31").write(path)  # reads what it replaces
    assert 0 < Cube.open(spark, path).pixels.count() < px.count()
    assert os.listdir(tmp_path) == ["cube"]
    assert store.resolve_path(f"{path}/pixels") == path
    assert store.days(store.open_cube(spark, path)[0], "1996-03-05", "1996-03-10").count() >= 0
    with pytest.raises(FileExistsError):
        cube.write(path, overwrite=False)
    p = store.stored_parameters(spark, path)
    assert p["resolution"] == 10 and p["mission"] == "s2" and p["daterange"][0].startswith("1996-03")


def test_sidecars(spark, sf, tmp_path):
    out = store.write_settings(str(tmp_path / "a.parquet"), {"bands": ("red",), "polygon": spark})
    assert store.read_settings(out) == {"bands": ["red"], "polygon": "<SparkSession>"}
    cube = Cube(V.cube(spark, sf).select("time", "row", "col", "red"), ("red",))
    csv = store.write_statistics_csv(cube.statistics(), str(tmp_path / "s.csv"))
    assert open(csv).readline().strip() == "period,label,band,n_dates,mean,median,min,max,std"
    assert store.band_order(["blue", "nir", "red", "green"]) == ["red", "green", "blue", "nir"]
    text = store.vrt([("2024-01-01", "c/2024-01-01.tif"), ("2024-01-02", "c/2024-01-02.tif")], Grid("EPSG:32632", 10, -10, 0, 80, 8, 8), ["red", "nir"], scale=0.1, offset=1.0)
    assert text.count("<VRTRasterBand") == 4 and "2024-01-02 nir" in text and text.count("c/2024-01-01.tif</SourceFilename><SourceBand>2") == 1


GOOD = {"mission": "s2", "bands": ["B04", "nir"], "indices": ["ndvi"], "daterange": ["2024-01-01", "2024-02-01"]}


def test_request_round_trip():
    r = CubeRequest.from_json(json.dumps({"parameters": GOOD}))
    assert r.mission == "sentinel_2_l2a" and r.bands == ["red", "nir"] and r.resolution == 10
    assert CubeRequest.from_json(r.to_json()).to_json() == r.to_json()


@pytest.mark.parametrize(
    "bad",
    [
        {"mission": "x"}, {"bands": ["zz"]}, {"indices": ["rvi"]}, {"max_cc": 101}, {"min_scene_coverage": 2}, {"tile_handling": "x"}, {"partial_scene_handling": "x"},
        {"resampling_method": "x"}, {"mission": "s1", "bands": None, "indices": None, "source": "pc", "cloud_masking": True}, {"keep_clouds": True}, {"shadow_masking": True},
        {"aggregator": "max"}, {"stats": ["sum"]}, {"keep_timeseries": False}, {"crs": "EPSG:4326"}, {"vrt": True}, {"daterange": ["a", "b"]}, {"resolution": -1}, {"source": "nowhere"},
        {"nonsense": 1}, {"output": "x.nc", "export_format": "csv"},
    ],
)
def test_requests_are_refused(bad):
    with pytest.raises(ValueError):
        CubeRequest.from_json(json.dumps({"parameters": {**GOOD, **bad}}))


def test_build_keeps_the_order_of_steps(spark, sf):
    g = Grid("EPSG:32632", 10, -10, 0, 80, 8, 8)
    r = CubeRequest("s2", bands=["red", "nir"], indices=["ndvi"], cloud_masking=True, stats=["mean"], partial_scene_handling="remove", min_scene_coverage=0.01)
    cube, layers = build(r, V.pixels(spark, sf), g, order=F.col("ord"))
    assert cube.bands == ("red", "nir", "ndvi") and cube.attrs["cloud_status"] == "scl_masked"
    assert layers.count() == 64 and cube.pixels.groupBy("time", "row", "col").count().filter("count > 1").isEmpty()
    narrow = cube.select("red").long("red")
    assert "nir" not in narrow.columns
    assert cube.tiled(4).select("trow", "tcol").distinct().count() == 4


@pytest.mark.parametrize("what, why", [({"max_cc": 20}, "max_cc"), ({"shadow_masking": True, "cloud_masking": True}, "shadow_masking"), ({"scene_metadata": ["sun_azimuth"]}, "scene_metadata"), ({"mission": "s2_l1c"}, "sentinel_2_l1c"), ({"min_footprint_coverage": 0.5, "polygon": [0, 0, 1, 1]}, "min_footprint")])
def test_build_needs_the_scenes_for_what_the_catalogue_knows(spark, sf, what, why):
    r = CubeRequest(**{"mission": "s2", "bands": ["nir"], **what})
    with pytest.raises(ValueError, match=why):
        build(r, V.pixels(spark, sf), Grid("EPSG:32632", 10, -10, 0, 80, 8, 8))


@pytest.mark.parametrize("bad", [{"polygon": "x"}, {"clip_raster": True}, {"min_footprint_coverage": 0.5}, {"cloud_mask_output": "x"}, {"stats": [{"op": "mean", "start": "2024-01-01", "end": "02-01"}]}, {"stats": [{"op": "mean", "start": "01-01", "end": "02-01", "years": [2024]}] * 2}])
def test_more_requests_are_refused(bad):
    with pytest.raises(ValueError):
        CubeRequest(**{"mission": "s2", **bad}).checked()


def test_many_areas_refuse_what_they_cannot_do(spark, sf):
    with pytest.raises(ValueError, match="shadow_masking"):
        build_features(CubeRequest("s2", bands=["nir"], cloud_masking=True, shadow_masking=True), V.pixels(spark, sf), Grid("EPSG:32632", 10, -10, 0, 80, 8, 8))


def test_build_writes_what_is_asked(spark, sf, tmp_path):
    g = Grid("EPSG:32632", 10, -10, 0, 80, 8, 8)
    out = str(tmp_path / "cube")
    ask = {"mission": "s2", "bands": ["red", "nir"], "cloud_masking": True, "daterange": ["1996-01-01", "1996-06-30"], "stats": ["mean"], "output": out, "export_settings": True, "statistics_csv": True, "vrt": True, "cloud_mask_output": str(tmp_path / "mask"), "metadata_output": str(tmp_path / "meta")}
    cube, layers = build(CubeRequest(**ask), V.pixels(spark, sf), g, F.col("ord"))
    back = Cube.open(spark, out)
    assert back.pixels.count() == cube.pixels.count() and back.stats.count() == cube.stats.count()
    assert spark.read.parquet(f"{out}_composites").count() == layers.count()
    assert store.read_settings(f"{out}_settings.json")["bands"] == ["red", "nir"]
    assert (tmp_path / "cube_statistics.csv").read_text().startswith("period,label,band") and "<VRTDataset" in (tmp_path / "cube.vrt").read_text()
    mask = Cube.open(spark, str(tmp_path / "mask"))
    assert mask.bands == ("cloud_mask_scl",) and {r[0] for r in mask.pixels.select("cloud_mask_scl").distinct().collect()} == {0, 1}
    assert spark.read.parquet(str(tmp_path / "meta")).count() == cube.stats.count()
    none, only = build(CubeRequest(**{**ask, "keep_timeseries": False, "output": f"{out}2", "vrt": False, "statistics_csv": False}), V.pixels(spark, sf), g, F.col("ord"))
    assert none is None and only.count() == layers.count()
    with pytest.raises(ValueError, match="no time series"):
        build(CubeRequest("s2", bands=["nir"], update=f"{out}2"), V.pixels(spark, sf), g, F.col("ord"))


def test_stream_appends_days_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "t string, v int").select(F.to_timestamp_ntz("t").alias("time"), "v")
    rows.write.parquet(src)
    for k in range(2):
        stream.append_new_days(spark.readStream.schema(rows.schema).parquet(src), out, str(tmp_path / f"cp{k}")).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_stream_per_day_and_unique(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "2024-01-01 01:00:00"), ("a", "2024-01-01 02:00:00"), ("b", "2024-01-02 00:00:00"), ("c", "2024-01-09 00:00:00")], "item_id string, t string").select("item_id", F.to_timestamp("t").alias("datetime")).write.parquet(src)
    raw = spark.readStream.schema("item_id string, datetime timestamp").parquet(src)
    for name, df in (("uniq", stream.unique_items(raw, "2 days")), ("perday", stream.per_day(raw))):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["item_id"] for r in spark.table("uniq").collect()) == ["a", "b", "c"]
    assert [r["n"] for r in spark.table("perday").orderBy("day").collect()][:2] == [2, 1]
