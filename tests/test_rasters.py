"""Images and chunk stores: files by the letter of their formats, round trips, and what is opened for a window."""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian import queries_rasters as Q
from meridian import views as V
from meridian.operators.grid import Grid
from meridian.plans.cube import Cube, build
from meridian.plans.request import CubeRequest
from meridian.sources import chunks, geotiff, store, tiff

GRID = Grid("EPSG:32632", 10, -10, 500_000, 5_000_000, 40, 24)


def image(dtype="f4", tile=16, names=("red", "a&b")):
    """A file in memory, and its arrays by (level, band)."""
    rng, shapes = np.random.default_rng(1), [(40, 24), (20, 12), (10, 6)]
    d = tiff.Directory(shapes, list(names), dtype, tile, GRID, -99 if dtype[0] != "u" else 0)
    data, arrays = {}, {}
    for k, (w, h) in enumerate(shapes):
        across, down = -(-w // tile), -(-h // tile)
        for b in range(len(names)):
            full = np.zeros((down * tile, across * tile), dtype)
            full[:h, :w] = (rng.normal(size=(h, w)) * 100).astype(dtype)
            arrays[k, b] = full[:h, :w]
            for t in range(across * down):
                r, c = divmod(t, across)
                data[k, b, t] = tiff.encode(full[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile])
    d.sizes = {q: len(v) for q, v in data.items()}
    return d.head() + b"".join(data[q] for q in sorted(data, key=lambda q: (-q[0], q[1], q[2]))), arrays


@pytest.mark.parametrize("dtype", ["f4", "f8", "i2", "u1", "u2", "i4"])
def test_levels_and_bands_come_back(dtype):
    blob, arrays = image(dtype)
    r = tiff.parse(lambda at, n: blob[at : at + n])
    assert r.grid == GRID and r.names == ("red", "a&b") and len(r.levels) == 3
    for k, v in enumerate(r.levels):
        for t, tr, tc in v.tiles():
            x = v.read(lambda at, n: blob[at : at + n], t, [1, 0])
            for j, b in enumerate((1, 0)):
                assert (x[:, :, j] == arrays[k, b][tr * 16 : tr * 16 + x.shape[0], tc * 16 : tc * 16 + x.shape[1]]).all()


def test_file_by_the_letter_of_the_format():
    """Tags read with nothing but struct; a tile decoded by the definition of its predictor, byte by byte."""
    blob, arrays = image("f4", names=("red",))
    assert blob[:4] == b"II*\0"
    at = struct.unpack("<I", blob[4:8])[0]
    tags = {}
    for k in range(struct.unpack("<H", blob[at : at + 2])[0]):
        tag, kind, n, value = struct.unpack("<HHII", blob[at + 2 + 12 * k : at + 14 + 12 * k])
        tags[tag] = (kind, n, value)
    assert list(tags) == sorted(tags)
    assert [tags[t][2] & 0xFFFF for t in (256, 257, 258, 259, 262, 277, 284, 317, 322, 323, 339)] == [40, 24, 32, 8, 1, 1, 2, 3, 16, 16, 3]
    assert struct.unpack("<3d", blob[tags[33550][2] : tags[33550][2] + 24]) == (10, 10, 0) and struct.unpack("<6d", blob[tags[33922][2] : tags[33922][2] + 48]) == (0, 0, 0, 500_000, 5_000_000, 0)
    keys = struct.unpack(f"<{tags[34735][1]}H", blob[tags[34735][2] : tags[34735][2] + 2 * tags[34735][1]])
    assert keys[:4] == (1, 1, 0, 3) and (3072, 0, 1, 32632) == keys[12:16]
    first, size = struct.unpack("<I", blob[tags[324][2] : tags[324][2] + 4])[0], struct.unpack("<I", blob[tags[325][2] : tags[325][2] + 4])[0]
    raw = bytearray(zlib.decompress(blob[first : first + size]))
    row = raw[: 16 * 4]
    for k in range(1, len(row)):
        row[k] = (row[k] + row[k - 1]) % 256
    values = [struct.unpack(">f", bytes(row[plane * 16 + c] for plane in range(4)))[0] for c in range(16)]
    assert values == arrays[0, 0][0, :16].tolist()


def test_strips_together_in_the_other_byte_order():
    """A hand-made file: two bands together, strips of 3 rows, predictor 2, big-endian, nothing geographic."""
    x = np.random.default_rng(0).integers(-3000, 3000, (7, 5, 2)).astype(">i2")
    strips = []
    for k in range(0, 7, 3):
        part = x[k : k + 3].astype(np.int16)
        part[:, 1:] -= x[k : k + 3, :-1].astype(np.int16)
        strips.append(zlib.compress(part.astype(">i2").tobytes()))
    out, places = bytearray(b"MM\0*\0\0\0\0"), []
    for s in strips:
        places.append(len(out))
        out += s
    longs = len(out)
    out += struct.pack(">3I3I", *places, *map(len, strips))
    struct.pack_into(">I", out, 4, len(out))
    tags = [(256, 3, 1, 5 << 16), (257, 3, 1, 7 << 16), (258, 3, 2, 16 << 16 | 16), (259, 3, 1, 8 << 16), (273, 4, 3, longs), (277, 3, 1, 2 << 16), (278, 3, 1, 3 << 16), (279, 4, 3, longs + 12), (317, 3, 1, 2 << 16), (339, 3, 2, 2 << 16 | 2)]
    out += struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + struct.pack(">I", 0)
    blob = bytes(out)
    r = tiff.parse(lambda at, n: blob[at : at + n])
    v = r.levels[0]
    assert r.grid is None and r.names == ("band_1", "band_2") and not v.apart
    got = np.concatenate([v.read(lambda at, n: blob[at : at + n], t, [0, 1]) for t, _, _ in v.tiles()])
    assert (got == x).all()
    with pytest.raises(ValueError, match="not a TIFF"):
        tiff.parse(lambda at, n: b"PK\3\4" + b"\0" * 12)


def test_window_opens_only_its_tiles(tmp_path):
    path = str(tmp_path / "s_2024-05-06.tif")
    blob, arrays = image("f8")
    (tmp_path / "s_2024-05-06.tif").write_bytes(blob)
    system, _ = geotiff.filesystem(path)
    geotiff.HEAD, head = 2048, geotiff.HEAD
    try:
        reader = geotiff.GeoTiffReader(path, ["a&b"], ["double"], 0, (2, 10, 17, 30), False, 1 << 20)
        opened = geotiff.Opened(system, path)
        rows = [r for b in reader.pixels(opened, path) for r in b.to_pylist()]
    finally:
        geotiff.HEAD = head
    level = tiff.parse(opened.read_at).levels[0]
    tiles = {o for o in level.offsets if any(at == o for at, _ in opened.reads)}
    assert tiles == {level.offsets[6 + 1]}  # one of twelve tiles: the second of the first row, in the second band
    assert {(r["row"], r["col"]) for r in rows} == {(r, c) for r in range(2, 10) for c in range(17, 30)}
    assert all(r["a&b"] == arrays[0, 1][r["row"], r["col"]] and r["layer"] == "s" and str(r["time"]) == "2024-05-06 00:00:00" for r in rows)
    shares = [[r for b in reader.pixels(geotiff.Opened(system, path), path, k, 5) for r in b.to_pylist()] for k in range(5)]
    assert sorted(map(str, sum(shares, []))) == sorted(map(str, rows))


def test_filters_leave_out_files(spark, tmp_path):
    for name in ("2024-01-01", "2024-01-02", "ndvi_mean", "ndvi_2023-01-01"):
        (tmp_path / f"{name}.tif").write_bytes(image()[0])
    df = geotiff.read_geotiff(spark, str(tmp_path))
    assert df.count() == 4 * 40 * 24 and df.columns == ["layer", "time", "row", "col", "red", "a&b"]
    assert df.filter("time >= timestamp_ntz'2024-01-02'").count() == 40 * 24 and df.filter("layer = 'ndvi'").select("time").distinct().count() == 1
    assert df.filter("time is null").select("layer").first()[0] == "ndvi_mean"
    reader = geotiff.GeoTiffReader(str(tmp_path), ["red"], ["double"], 0, None, False, 1)
    reader.files = [("time", "LessThan", __import__("datetime").datetime(2024, 1, 2))]
    assert {p.value[0][0].rsplit("/", 1)[1] for p in reader.partitions()} == {"2024-01-01.tif", "ndvi_2023-01-01.tif"}
    with pytest.raises(Exception, match="no band"):
        geotiff.read_geotiff(spark, str(tmp_path), bands="blue").count()
    with pytest.raises(Exception, match="3 levels"):
        geotiff.read_geotiff(spark, str(tmp_path), level=3).count()


def test_export_edges(spark, tmp_path):
    rows = [("b/x:1", 0, 0, 1.0, None, 4), ("b/x:1", 23, 39, None, 2.0, 5), ("b/x:1", 30, 0, 9.0, 9.0, 6), ("empty", 3, 3, None, None, None), ("c d", 1, 0, 7.0, 1.0, 8)]
    px = spark.createDataFrame(rows, "layer string, row int, col int, nir double, red double, scl int")
    path = str(tmp_path / "out")
    assert geotiff.export_geotiffs(px, path, GRID, ["nir", "red", "scl"], key="layer", prefix="p_", tile=16, nearest=["scl"]) == ["p_b_x_1.tif", "p_c_d.tif"]
    back = geotiff.read_geotiff(spark, path)
    assert sorted(map(tuple, back.drop("time").collect())) == [("p_b_x_1", 0, 0, 1.0, None, 4.0), ("p_b_x_1", 23, 39, None, 2.0, 5.0), ("p_c_d", 1, 0, 7.0, 1.0, 8.0)]
    one = geotiff.read_geotiff(spark, path, level=1).drop("time").collect()
    assert sorted(map(tuple, one), key=str) == [("p_b_x_1", 0, 0, 1.0, None, 4.0), ("p_b_x_1", 11, 19, None, 2.0, None), ("p_c_d", 0, 0, 7.0, 1.0, None)]
    with pytest.raises(FileExistsError):
        geotiff.export_geotiffs(px, path, GRID, ["nir"], key="layer", overwrite=False)
    with pytest.raises(Exception, match="two pixels"):
        geotiff.export_geotiffs(px.unionByName(px), path, GRID, ["nir"], key="layer")
    with pytest.raises(Exception, match="does not fit"):
        geotiff.export_geotiffs(px, path, GRID, ["nir"], key="layer", dtype="int16", scale=1e-6)
    assert geotiff.read_geotiff(spark, path).count() == 3  # failed exports leave what was there
    empty = spark.createDataFrame([], px.schema)
    assert geotiff.export_geotiffs(empty, str(tmp_path / "none"), GRID, ["nir"], key="layer") == [] and os.listdir(tmp_path / "none") == []


def test_red_green_blue_first_and_grid_of_north_up(spark, sf, tmp_path):
    px = V.cube(spark, sf).select("time", "row", "col", "blue", "nir", "red", "green").filter("time < timestamp_ntz'1995-01-20'")
    up = Grid("EPSG:4326", 0.5, 0.5, 9.0, 45.0, 8, 8)
    Cube(px, ("blue", "nir", "red", "green"), up).export_images(str(tmp_path / "o"), tile=16)
    r = geotiff.open_raster(str(tmp_path / "o"))
    assert r.names == ("red", "green", "blue", "nir") and r.grid == up and len(r.levels) == 1


def test_chunk_store_by_the_letter(spark, tmp_path):
    rng = np.random.default_rng(3)
    smooth = np.cumsum(rng.normal(size=(24, 40)), axis=1) * 0.01
    rows = [(f"2024-01-0{t + 1}", r, c, float(smooth[r, c] + t)) for t in range(3) for r in range(24) for c in range(40) if not (t == 1 and c < 20)]
    px = spark.createDataFrame(rows, "d string, row int, col int, red double").select(F.to_timestamp_ntz("d").alias("time"), "row", "col", "red")
    path = str(tmp_path / "c.zarr")
    mixed = chunks.write_zarr(px, path, GRID, ["red"], "int16", scale=1e-4, chunk=20)
    spec = json.load(open(f"{path}/Time_Series/.zarray"))
    assert (spec["shape"], spec["chunks"], spec["dtype"], spec["fill_value"]) == ([3, 1, 24, 40], [1, 1, 20, 20], "<i2", -32768)
    assert spec["filters"] == [{"id": "shuffle", "elementsize": 2}] and spec["compressor"] == {"id": "zlib", "level": 5}
    names = sorted(n for n in os.listdir(f"{path}/Time_Series") if not n.startswith("."))
    assert names == sorted(f"{t}.0.{r}.{c}" for t in range(3) for r in range(2) for c in range(2) if not (t == 1 and c == 0))
    raw = zlib.decompress(open(f"{path}/Time_Series/2.0.1.1", "rb").read())
    block = np.array([struct.unpack("<h", bytes((raw[k], raw[400 + k])))[0] for k in range(400)]).reshape(20, 20)
    assert (block[4:] == -32768).all() and (block[:4] == np.floor((smooth[20:24, 20:] + 2) / 1e-4 + 0.5)).all()
    assert json.load(open(f"{path}/.zmetadata"))["metadata"]["time/.zattrs"]["units"].startswith("seconds since")
    plain = chunks.write_zarr(px, path, GRID, ["red"], "int16", scale=1e-4, chunk=20, shuffled=False)
    assert mixed < plain
    assert chunks.read_zarr(spark, path, start="2024-01-02", end="2024-01-03").count() == 24 * 20
    assert chunks.read_zarr(spark, path, window=(5, 5, 0, 40)).count() == 0 and chunks.read_zarr(spark, path, window=(23, 99, 39, 99)).count() == 3
    # Only the chunks asked for are opened: one that is broken and not asked for does no harm, else it fails.
    open(f"{path}/Time_Series/0.0.0.0", "wb").write(b"no")
    assert chunks.read_zarr(spark, path, window=(20, 24, 20, 40)).count() == 3 * 4 * 20
    with pytest.raises(Exception, match="(?i)error"):
        chunks.read_zarr(spark, path).count()
    with pytest.raises(ValueError, match="no band"):
        chunks.read_zarr(spark, path, ["nir"])
    with pytest.raises(Exception, match="does not fit"):
        chunks.write_zarr(px, path, GRID, ["red"], "int16", scale=1e-6)
    with pytest.raises(Exception, match="two pixels"):
        chunks.write_zarr(px.unionByName(px), path, GRID, ["red"])


def test_chunk_numbers():
    spec = {"shape": [9, 2, 100, 50], "chunks": [1, 1, 30, 20]}
    assert [list(r) for r in chunks.chunk_numbers(spec, range(2, 4), (29, 31, 0, 20))] == [[2, 3], [0, 1], [0]]
    assert [list(r) for r in chunks.chunk_numbers(spec, range(2, 4), (0, 10**6, 49, 10**6))] == [[2, 3], [0, 1, 2, 3], [2]]
    assert not any(chunks.chunk_numbers(spec, range(2, 4), (200, 300, 0, 20)))


def test_build_writes_images_and_a_virtual_raster(spark, sf, tmp_path):
    ask = {"mission": "s2", "bands": ["red", "nir"], "daterange": ["1996-01-01", "1996-01-31"], "stats": ["max"], "vrt": True}
    out = str(tmp_path / "img")
    cube, layers = build(CubeRequest(**ask, output=out, export_format="geotiff"), V.pixels(spark, sf), Q.FRAME, F.col("ord"))
    names = sorted(os.listdir(out))
    assert [n for n in names if n.startswith("max")] and len(names) == cube.pixels.select("time").distinct().count() + 1
    text = (tmp_path / "img.vrt").read_text()
    assert text.count("<VRTRasterBand") == 2 * len(names) and f"img/{names[0]}" in text and os.path.exists(tmp_path / "img" / names[0])
    back = geotiff.read_geotiff(spark, out).filter("time is not null").agg(F.count("nir"), F.sum("nir")).first()
    want = cube.pixels.agg(F.count("nir"), F.sum("nir")).first()
    assert back[0] == want[0] and abs(back[1] - want[1]) < 1e-3
    z = str(tmp_path / "a.zarr")
    build(CubeRequest(**{**ask, "vrt": False, "stats": None}, output=z, export_format="zarr"), V.pixels(spark, sf), Q.FRAME, F.col("ord"))
    assert chunks.read_zarr(spark, z, ["nir"]).count() == back[0]
    plain = str(tmp_path / "cube")
    build(CubeRequest(**{**ask, "stats": None}, output=plain), V.pixels(spark, sf), Q.FRAME, F.col("ord"))
    assert "cube_images/1996-01-0" in (tmp_path / "cube.vrt").read_text() and store.Files(spark, plain).exists(f"{plain}_images")


@pytest.mark.parametrize(
    ("ask", "drop", "why"),
    [({"bands": ["red", "rededge3"]}, [], "no band rededge3"), ({"scene_cloud_coverage": 30}, ["scl"], "scene_cloud_coverage"), ({"partial_scene_handling": "remove"}, ["scl"], "partial_scene_handling"),
     ({"cloud_masking": True}, ["scl"], "cloud_masking"), ({"metadata_output": "m"}, ["scl"], "metadata_output"), ({}, ["red"], "no band red")],
)
def test_build_refuses_what_it_cannot_do(spark, sf, ask, drop, why):
    with pytest.raises(ValueError, match=why):
        build(CubeRequest(**{"mission": "s2", "bands": ["red", "nir"], **ask}), V.pixels(spark, sf).drop(*drop), Q.FRAME)


def test_build_makes_a_day_mosaic_without_an_order(spark, sf, tmp_path):
    meta = str(tmp_path / "meta")
    cube, _ = build(CubeRequest("s2", bands=["red", "nir"], metadata_output=meta), V.pixels(spark, sf), Q.FRAME)
    assert cube.pixels.count() == cube.pixels.select("time", "row", "col").distinct().count() < V.pixels(spark, sf).count()
    assert spark.read.parquet(meta).count() == cube.pixels.select("time").distinct().count()
    rows = [("2024-01-01 12:00:00", 5.0), ("2024-01-01 09:00:00", None), ("2024-01-01 10:00:00", 3.0), ("2024-01-01 10:00:00", 2.0)]
    px = spark.createDataFrame(rows, "t string, red double").select(F.to_timestamp_ntz("t").alias("time"), F.lit(0).alias("row"), F.lit(0).alias("col"), "red")
    assert build(CubeRequest("s2", bands=["red"]), px, Q.FRAME)[0].pixels.first()["red"] == pytest.approx(2.0 / 10000, rel=0.6)
    table = str(tmp_path / "t.csv")
    build(CubeRequest("s2", bands=["red"], output=table, export_format="csv", compress=True), px, Q.FRAME)
    assert any(n.endswith(".csv.gz") for n in os.listdir(table))


def _files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_update_writes_only_the_months_it_touches(spark, sf, tmp_path):
    path, px = str(tmp_path / "cube"), V.pixels(spark, sf)
    ask = {"mission": "s2", "bands": ["nir"], "cloud_masking": True}
    build(CubeRequest(**ask, daterange=["1996-01-01", "1996-04-10"], output=path), px, Q.FRAME, F.col("ord"))
    before = _files(path)
    cube, _ = build(CubeRequest(**ask, daterange=["1996-02-01", "1996-06-30"], update=path), px, Q.FRAME, F.col("ord"))
    after = _files(path)
    of = lambda files, month: {k: v for k, v in files.items() if f"month=1996-{month}" in k}
    assert all(of(before, m) == of(after, m) for m in ("01", "02", "03")) and of(before, "04") != of(after, "04") and of(after, "06")
    whole = build(CubeRequest(**ask, daterange=["1996-01-01", "1996-06-30"]), px, Q.FRAME, F.col("ord"))[0]
    key = ["time", "row", "col", "nir"]
    assert cube.pixels.select(*key).exceptAll(whole.pixels.select(*key)).count() == 0 and cube.pixels.count() == whole.pixels.count()
    assert os.listdir(tmp_path) == ["cube"]
    build(CubeRequest(**ask, daterange=["1996-02-01", "1996-06-30"], update=path), px, Q.FRAME, F.col("ord"))
    assert _files(path) == after
    with pytest.raises(ValueError, match="differ in red"):
        store.merge_days(px.select("time", "row", "col", "nir", "red"), path)
    more, _ = build(CubeRequest(**{**ask, "bands": ["red"]}, daterange=["1996-01-01", "1996-06-30"], update=path), px, Q.FRAME, F.col("ord"))
    assert more.bands == ("nir", "red") and more.pixels.filter("red is not null").count() > 0
