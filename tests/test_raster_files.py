"""GeoTIFF files as tiles: compressions and predictors, ranges that filters leave, files written by tasks."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan, StringContains

from strandline.sources import raster_files, rasters

GEO = [300000.0, 15.0, 0.0, 6200000.0, 0.0, -15.0]


def lzw(data):
    """Codes of 9 to 12 bits, high bits first."""
    table, width, held, bits, out = None, 9, 0, 0, bytearray()

    def put(code):
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    own = b""
    put(256)
    table = {bytes([k]): k for k in range(256)}
    free = 258
    for byte in data:
        longer = own + bytes([byte])
        if longer in table:
            own = longer
            continue
        put(table[own])
        table[longer], free, own = free, free + 1, bytes([byte])
        if free == 4094:
            put(256)
            table, free, width = {bytes([k]): k for k in range(256)}, 258, 9
        elif free > (1 << width) - 1:
            width += 1
    if own:
        put(table[own])
        free += 1
        if free > (1 << width) - 1 and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def encoded(bands, compression=1, predictor=1, tile=16, planar=1, order="<"):
    cube = np.stack(bands, -1)
    h, w, n = cube.shape
    size, parts = cube.dtype.itemsize, []
    for plane in [cube[..., k : k + 1] for k in range(n)] if planar == 2 else [cube]:
        for r in range(0, h, tile):
            for c in range(0, w, tile):
                whole = np.zeros((tile, tile, plane.shape[-1]), cube.dtype)
                part = plane[r : r + tile, c : c + tile]
                whole[: part.shape[0], : part.shape[1]] = part
                if predictor == 2:
                    whole[:, 1:] = whole[:, 1:] - whole[:, :-1]
                raw = whole.astype(cube.dtype.newbyteorder(order)).tobytes()
                if predictor == 3:
                    split = np.frombuffer(whole.astype(cube.dtype.newbyteorder(">")).tobytes(), "u1").reshape(tile, -1, size).swapaxes(1, 2).reshape(tile, -1, plane.shape[-1])
                    raw = np.concatenate([split[:, :1], split[:, 1:] - split[:, :-1]], 1).tobytes()
                parts.append({1: bytes, 5: lzw, 8: zlib.compress}[compression](raw))
    starts = np.cumsum([8, *map(len, parts)]).tolist()
    fields = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [8 * size] * n), 259: ("H", [compression]), 277: ("H", [n]), 284: ("H", [planar]), 317: ("H", [predictor]), 322: ("I", [tile]), 323: ("I", [tile])}
    fields |= {324: ("I", starts[:-1]), 325: ("I", list(map(len, parts))), 339: ("H", [{"u": 1, "i": 2, "f": 3}[cube.dtype.kind]] * n)}
    fields |= {33550: ("d", [GEO[1], -GEO[5], 0.0]), 33922: ("d", [0.0, 0.0, 0.0, GEO[0], GEO[3], 0.0]), 34735: ("H", [1, 1, 0, 1, 3072, 0, 1, 32756])}
    entries, extra, beyond = b"", b"", starts[-1] + 2 + 12 * len(fields) + 4
    for tag, (c, values) in sorted(fields.items()):
        raw = struct.pack(order + c * len(values), *values)
        value = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", beyond + len(extra))
        extra += raw if len(raw) > 4 else b""
        entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "d": 12}[c], len(values)) + value
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, starts[-1]) + b"".join(parts) + struct.pack(order + "H", len(fields)) + entries + b"\0" * 4 + extra


def whole(rows):
    """Bands of a file from its rows of tiles."""
    out = np.zeros((rows[0].bands, rows[0].height, rows[0].width))
    for r in rows:
        out[r.band, r.r0 : r.r0 + r.rows, r.c0 : r.c0 + r.cols] = np.reshape(np.array(r["values"], float), (r.rows, r.cols))
    return out


@pytest.mark.parametrize("length", [0, 1, 300, 5000, 60000])
def test_lzw(length):
    rnd = np.random.default_rng(length)
    for data in (rnd.integers(0, 256, length).astype("u1").tobytes(), rnd.integers(0, 2, length).astype("u1").tobytes(), b"a" * length):
        assert rasters.unlzw(lzw(data)) == data
    with pytest.raises(ValueError, match="broken"):
        rasters.unlzw(bytes([0b10000000, 0b01111111, 0b11000000, 0]))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("planar", [1, 2])
@pytest.mark.parametrize("compression", [1, 5, 8])
def test_compressions_and_predictors(compression, planar, order):
    rnd = np.random.default_rng(compression)
    for kind, predictors in (("u1", (1, 2)), ("i2", (1, 2)), ("u4", (1, 2)), ("f4", (1, 3)), ("f8", (1, 3))):
        bands = [(rnd.normal(size=(20, 35)) * 100).astype(kind) for _ in range(3)]
        for predictor in predictors:
            got = rasters.decoded(encoded(bands, compression, predictor, 16, planar, order))
            assert all((a == b.ravel()).all() for a, b in zip(got["bands"], bands, strict=True)), (kind, predictor)
            assert (got["georef"], got["epsg"]) == (GEO, 32756)


def test_filters_leave_ranges(tmp_path, monkeypatch):
    bands = [np.random.default_rng(k).normal(size=(64, 64)) for k in range(3)]
    (tmp_path / "a.tif").write_bytes(encoded(bands, planar=2, tile=16))
    ranges = []
    fetch = raster_files.Ranged.fetch
    monkeypatch.setattr(raster_files.Ranged, "fetch", lambda self, at, n: ranges.append((at, n)) or fetch(self, at, n))
    monkeypatch.setattr(raster_files, "HEAD", 8)
    reader = raster_files.TileReader({"path": str(tmp_path)})
    # one band of a window of two tiles
    asked = [EqualTo(("band",), 1), GreaterThan(("x_max",), GEO[0] + 15 * 20), LessThan(("x_min",), GEO[0] + 15 * 40), GreaterThan(("y_max",), GEO[3] - 15 * 10), StringContains(("path",), "a")]
    assert list(reader.pushFilters(asked)) == asked[4:]
    rows = [r for share in reader.partitions() for batch in reader.read(share) for r in batch.to_pylist()]
    assert [(r["band"], r["r0"], r["c0"]) for r in rows] == [(1, 0, 16), (1, 0, 32)]
    assert all((np.reshape(r["values"], (16, 16)) == bands[1][:16, r["c0"] : r["c0"] + 16]).all() for r in rows)
    tiles = [x for x in ranges if x[1] == 16 * 16 * 8]
    assert tiles == [(8 + (16 + k) * 2048, 2048) for k in (1, 2)]
    assert sum(n for _, n in ranges) < 2 * 2048 + 1000
    ranges.clear()
    headers = raster_files.TileReader({"path": str(tmp_path), "pixels": "false"})
    assert sum(b.num_rows for s in headers.partitions() for b in headers.read(s)) == 48 and not [x for x in ranges if x[1] == 2048]


def test_scan(spark, tmp_path):
    bands = [np.random.default_rng(k).normal(size=(40, 50)) for k in range(2)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "sub" / "a.tif").write_bytes(encoded(bands, 5, 3, 16, 2))
    (tmp_path / "b.tif").write_bytes(encoded([b.astype("i2") for b in bands], 8, 2))
    (tmp_path / "c.tif").write_bytes(b"II*\0")
    (tmp_path / "_hidden" / "d.tif").write_bytes(b"")
    tiles = raster_files.tiles_of_files(spark, str(tmp_path), split=6000)
    assert tiles.rdd.getNumPartitions() > 2
    rows = tiles.collect()
    of = lambda name: [r for r in rows if r.path.endswith(name)]
    assert (whole(of("a.tif")) == np.stack(bands)).all() and (whole(of("b.tif")) == np.stack(bands).astype("i2")).all()
    (broken,) = of("c.tif")
    assert broken.error and broken["values"] is None and not of("d.tif")
    # the filter is in the scan, and the answer is that of a filter behind it
    some = tiles.where("band = 1 AND x_min < 300300 AND y_max > 6199700")
    assert sorted((r.path, r.r0, r.c0) for r in some.collect()) == sorted((r.path, r.r0, r.c0) for r in rows if r.band == 1 and r.x_min < 300300 and r.y_max > 6199700)
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan and "Filter" in tiles.where("values[0] > 0")._jdf.queryExecution().optimizedPlan().toString()
    (tmp_path / "none").mkdir()
    assert raster_files.tiles_of_files(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("kind", ["f8", "f4", "i2"])
def test_files_from_pixels_and_back(spark, tmp_path, kind):
    rnd = np.random.default_rng(1)
    files = {"a.tif": rnd.integers(-9, 9, (2, 40, 50)).astype(float), "b.tif": rnd.integers(0, 9, (1, 5, 5)).astype(float)}
    rows = [(n, b, r, c, float(v)) for n, m in files.items() for (b, r, c), v in np.ndenumerate(m) if (r, c) != (3, 3)]
    sides = spark.createDataFrame([(n, m.shape[1], m.shape[2], m.shape[0]) for n, m in files.items()], "path string, height int, width int, bands int")
    pixels = spark.createDataFrame(rows, "path string, band int, r int, c int, v double")
    tiles = raster_files.tiles_of_pixels(pixels, ["path", "band"], "v", 16).join(sides, "path")
    tiles = tiles.where("NOT (path = 'a.tif' AND band = 1 AND r0 = 16)").withColumns({"georef": F.array(*map(F.lit, GEO)), "epsg": F.lit(32756), "other": F.lit(1)})
    at = str(tmp_path / "out")
    raster_files.tiles_written(tiles, at, 16, kind)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.tif", "b.tif"]
    got = raster_files.tiles_of_files(spark, at).collect()
    files["a.tif"][1, 16:32] = 0
    for n, m in files.items():
        m[:, 3, 3] = np.nan if kind[0] == "f" else 0
        own = [r for r in got if r.path.endswith(n)]
        assert np.array_equal(whole(own), m, equal_nan=True) and {(tuple(r.georef), r.epsg) for r in own} == {(tuple(GEO), 32756)}
        back = rasters.decoded((tmp_path / "out" / n).read_bytes())
        assert np.array_equal(np.reshape(back["bands"], m.shape), m, equal_nan=True)
    # a name that exists, and a task that fails, leave what was there
    before = {p: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    with pytest.raises(Exception, match="exists"):
        raster_files.tiles_written(tiles.where("path = 'b.tif'"), at, 16, kind)
    broken = tiles.withColumn("r0", F.when(F.col("path") == "b.tif", 3).otherwise(F.col("r0"))).withColumn("path", F.concat(F.lit("new_"), "path"))
    with pytest.raises(Exception, match="grid"):
        raster_files.tiles_written(broken, at, 16, kind)
    assert {p: p.read_bytes() for p in (tmp_path / "out").iterdir()} == before
    raster_files.tiles_written(tiles.where("path = 'b.tif'").withColumn("values", F.transform("values", lambda _: F.lit(1.0))), at, 16, kind, overwrite=True)
    assert set(rasters.decoded((tmp_path / "out" / "b.tif").read_bytes())["bands"][0]) == {1.0} and len(list((tmp_path / "out").iterdir())) == 2


def test_files_and_scenes_left_out(spark):
    rows = [("x/1_L8_A_ms.tif", None), ("x/1_L8_A_mask.tif", None), ("x/2_L8_A_ms.tif", None), ("x/3_L8_A_ms_dup1.tif", None), ("x/3_L8_A_mask_dup1.tif", "broken"), ("x/4_L8_A_pan.tif", None), ("x/other.tif", None)]
    files = spark.createDataFrame(rows, "path string, error string")
    got = sorted((r.scene_id, r.path or "", r.reason) for r in rasters.left_out(files).collect())
    want = [("2_L8_A", "", "missing: mask"), ("3_L8_A_dup1", "", "missing: mask"), ("3_L8_A_dup1", "x/3_L8_A_mask_dup1.tif", "unreadable: broken"), ("4_L8_A", "", "missing: ms, mask"), ("other", "x/other.tif", "no kind of file")]
    assert got == want and rasters.left_out(files.limit(0)).count() == 0
