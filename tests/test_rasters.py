"""Distances, level lines and connected parts over many tasks, against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp
from pyspark.sql import functions as F

from strandline.functions import kernels
from strandline.operators import contours, distances, parts


@settings(max_examples=200, deadline=None)
@given(hnp.arrays(float, st.tuples(st.integers(1, 4), st.integers(1, 9)), elements=st.sampled_from([0.0, 1.0, 4.0, 9.0, 2.25, np.inf])), st.lists(st.floats(-3, 12), min_size=1, max_size=5))
def test_envelopes(cost, xs):
    at = np.tile(np.arange(cost.shape[1], dtype=float), (len(cost), 1))
    line, x = np.repeat(np.arange(len(cost)), len(xs)), np.tile(sorted(xs), len(cost))
    got = kernels.lowest(kernels.envelopes(at, cost), at, cost, line, x)
    want = np.array([((v - at[k]) ** 2 + cost[k]).min() for k, v in zip(line, x, strict=True)])
    assert np.allclose(got, want)


def test_distances_against_brute_force(spark):
    rnd = np.random.default_rng(4)
    masks = {"a": rnd.random((17, 23)) < 0.03, "none": np.zeros((5, 6), bool), "one": np.eye(1, 40, 3) > 0}
    rows = [(s, int(r), int(c), bool(v) if s != "one" or v else None) for s, m in masks.items() for (r, c), v in np.ndenumerate(m)]
    rasters = spark.createDataFrame(rows, "s string, r int, c int, m boolean").withColumns({"row": F.lit(-1), "_at": F.lit("x")})
    spots = [("a", 3.0, 4.25), ("a", 3.0, 4.25), ("a", 7.5, 9.0), ("a", 7.5, 9.25), ("a", 0.0, 22.0), ("a", 16.0, 0.0), ("none", 1.0, 1.5), ("one", 0.0, 39.0), ("a", None, 1.0), ("gone", 1.0, 1.0)]
    spots += [("a", float(rnd.integers(17)), float(rnd.random() * 22)) for _ in range(40)] + [("a", float(rnd.random() * 16), float(rnd.integers(23))) for _ in range(40)]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(spots)], "k int, s string, row double, col double")
    got = {r.k: r.far for r in distances.to_masked(points, rasters, ["s"], {"far": "m", "m2": "m"}).collect()}
    assert len(got) == len(spots)
    for k, (s, row, col) in enumerate(spots):
        at = np.argwhere(masks.get(s, np.zeros((0, 0))))
        want = None if row is None or not len(at) else np.hypot(at[:, 0] - row, at[:, 1] - col).min()
        assert got[k] == (want if want is None else pytest.approx(want, abs=1e-9))
    whole = distances.transformed(rasters.where("s = 'a'"), ["s"], "m").collect()
    at = np.argwhere(masks["a"])
    assert len(whole) == 17 * 23 and all(r.distance == pytest.approx(np.hypot(at[:, 0] - r.r, at[:, 1] - r.c).min()) for r in whole)
    assert distances.to_masked(points.limit(0), rasters, ["s"], {"distance": "m"}).count() == 0
    assert [r.distance for r in distances.to_masked(points.limit(2), rasters.limit(0), ["s"], {"distance": "m"}).collect()] == [None, None]


def walked(segments):
    """Lines by walking from loose ends, then from the lowest segment left; where several meet in a point the first goes on as the first."""
    starts, ends = {}, {}
    for k, a, b in segments:
        starts.setdefault(a, []).append(k)
        ends.setdefault(b, []).append(k)
    after = {i: j for p, own in ends.items() for i, j in zip(sorted(own), sorted(starts.get(p, [])), strict=False)}
    of, left, lines = {k: (a, b) for k, a, b in segments}, dict.fromkeys(sorted(k for k, _, _ in segments)), {}
    for first in [k for k in left if k not in after.values()] + list(left):
        k, points = first, []
        while k in left:
            del left[k]
            points.append(of[k][0])
            last, k = k, after.get(k)
        if points:
            lines[first] = [*points, of[last][1]]
    return lines


@pytest.mark.parametrize("level", [0.5, 1.0, 0.37])
def test_lines_against_walking(spark, level):
    rnd = np.random.default_rng(8)
    rasters = [rnd.integers(0, 3, (14, 15)).astype(float), np.add.outer(np.arange(40.0), np.arange(3.0)) / 20, rnd.random((9, 9))]
    rasters[2][4, 4] = np.nan
    df = spark.createDataFrame([(s, int(r), int(c), float(v)) for s, m in enumerate(rasters) for (r, c), v in np.ndenumerate(m)], "s int, r int, c int, v double")
    segments = contours.contour_segments(df, ["s"], "v", F.lit(level)).cache()
    lines = {}
    for r in contours.contour_lines(segments, ["s"]).orderBy("pt_idx").collect():
        own = lines.setdefault((r.s, r.line), [])
        assert r.pt_idx == len(own)
        own.append((r.row, r.col))
    of = {}
    for r in segments.collect():
        of.setdefault(r.s, []).append((r.segment, (r.row0, r.col0), (r.row1, r.col1)))
    assert lines == {(s, k): p for s, own in of.items() for k, p in walked(own).items()}
    assert contours.contour_lines(segments.limit(0), ["s"]).count() == 0


@pytest.mark.parametrize("tile", [1, 2, 5])
def test_lines_over_tiles(spark, tile):
    rnd = np.random.default_rng(tile)
    far = np.hypot(*(np.indices((23, 21)) - 10.3))
    rasters = [rnd.integers(0, 3, (14, 15)).astype(float), np.abs(far - 6), rnd.random((17, 12))]
    df = spark.createDataFrame([(s, int(r), int(c), float(v)) for s, m in enumerate(rasters) for (r, c), v in np.ndenumerate(m)], "s int, r int, c int, v double")
    segments = contours.contour_segments(df, ["s"], "v", F.lit(1.0 if tile == 2 else 0.5)).cache()  # 1 is a pixel's value
    lines, of = {}, {}
    for r in contours.contour_lines(segments, ["s"], tile).orderBy("pt_idx").collect():
        lines.setdefault((r.s, r.line), []).append((r.pt_idx, (r.row, r.col)))
    for r in segments.collect():
        of.setdefault(r.s, []).append((r.segment, (r.row0, r.col0), (r.row1, r.col1)))
    assert lines == {(s, k): list(enumerate(p)) for s, own in of.items() for k, p in walked(own).items()}
    assert max(map(len, lines.values())) > 40


def test_rounds_take_only_what_crosses_tiles(spark):
    df = spark.createDataFrame([(0, r, c, float((r % 4, c % 4) == (2, 2))) for r in range(32) for c in range(32)], "s int, r int, c int, v double")
    pieces = contours._chains(contours.contour_segments(df, ["s"], "v", F.lit(0.5)), ["s"], 8)
    assert pieces.where("whole").count() == 8 * 8 * 4 and contours._linked(pieces, ["s"]).count() == 0


def strip(zone, scene, shift, sat="L8"):
    """A scene of 12 x 14 pixels of 15 m in a UTM zone, water in the west, its shoreline near 150 degrees east."""
    v = np.tile(np.linspace(-0.8, 0.8, 14), (12, 1))
    g, rest = np.full(v.shape, 0.2), np.full(v.shape, 0.1)
    index = (0.2 + 0.2 * v) / (1 - v)
    bands = [rest, g, rest, index, index]
    return {"scene_id": scene, "site": "s", "satname": sat, "height": 12, "width": 14, "bands": [b.ravel().tolist() for b in bands], "qa": [1] * 168, "georef": [*shift[:1], 15.0, 0.0, shift[1], 0.0, -15.0], "epsg": zone}


def test_scenes_of_two_zones_give_one_table(spark):
    from datetime import datetime

    from strandline.functions import projections
    from strandline.operators.scenes import TILES
    from strandline.operators.transects import near_transects
    from strandline.plans import extraction

    at = lambda epsg: spark.range(1).select(*(c.alias(n) for c, n in zip(projections.converted(F.lit(150.0), F.lit(-33.0), 4326, epsg), "xy", strict=True))).first()
    a, b = at(32755), at(32756)
    made = [strip(32755, "55", (a.x - 105, a.y + 90)), strip(32756, "56", (b.x - 105, b.y + 90)), strip(2154, "unknown", (0.0, 0.0))]
    rows = [[{**r, "acq_ts": datetime(2024, 1, 1), "pan": None, "cloud_prob": None}[c.split()[0]] for c in TILES.split(", ")] for r in made]
    settings = extraction.Detection(min_length_sl=100, min_beach_area=0, output_epsg=28356, max_dist_ref=60)
    classes = extraction.classified_scenes(spark.createDataFrame(rows, TILES), lambda x: np.where(x[:, 6] > 0, 1, 3), settings).cache()
    assert {r.scene_id: r.reason for r in classes.collect()} == {"55": None, "56": None, "unknown": "unknown reference system: 2154"}
    out = at(28356)
    reference = spark.createDataFrame([("s", out.x, out.y + k * 15.0) for k in range(-7, 8)], "site string, x double, y double")
    shores = extraction.shorelines(classes, settings, reference).cache()
    got = {r.scene_id: np.array([(p.x, p.y) for p in r.pts]) for r in shores.collect()}
    assert set(got) == {"55", "56"}
    # each shoreline lies in the output system where its scene's threshold puts it on the scene's grid, whose seventh column is at `out`
    off = {r.scene_id: 15 * ((r.threshold + 0.8) / (1.6 / 13) - 7) for r in shores.collect()}
    for k, p in got.items():
        assert len(p) >= 8 and np.hypot(*(p - [out.x, out.y]).T).min() == pytest.approx(abs(off[k]), abs=0.1) and abs(off[k]) < 45
    # the grids of the zones meet at the difference of their convergences
    turn = [np.degrees(np.arctan2(*(p[np.argmax(p[:, 1])] - p[np.argmin(p[:, 1])]))) for p in (got["55"], got["56"])]
    meets = spark.range(1).select(*(projections.grid_convergence(F.lit(150.0), F.lit(-33.0), e).alias(str(e)) for e in (32755, 32756))).first()
    assert (turn[0] - turn[1]) == pytest.approx(meets["32755"] - meets["32756"], abs=0.02) and abs(turn[1]) < 0.02
    transects = spark.createDataFrame([("t", out.x - 60, out.y, out.x + 60, out.y)], "name string, x0 double, y0 double, x1 double, y1 double")
    met = near_transects(shores.select("scene_id", F.inline("pts")), transects, 25, ["scene_id"]).collect()
    assert {r.scene_id for r in met} == {"55", "56"} and all(r.chainage == pytest.approx(60 + off[r.scene_id], abs=2) for r in met)
    with pytest.raises(Exception, match="unknown reference system of unknown"):
        extraction.shorelines(classes.withColumn("reason", F.lit(None).cast("string")), settings).collect()


def test_projection_of_known_points(spark):
    from strandline.functions import projections

    rows = [(9.0, 45.0, 32632, 500000.0, 4982950.4002), (3.0, 60.0, 25831, 500000.0, 6651411.1902), (10.0, 0.0, 3857, 1113194.9079, 0.0), (10.0, 5.0, 4283, 10.0, 5.0), (10.0, 5.0, 9999, None, None), (None, 5.0, 32632, None, None), (1.0, 1.0, None, None, None)]
    df = spark.createDataFrame(rows, "lon double, lat double, epsg int, want_x double, want_y double")
    for r in projections.reprojected(df, "lon", "lat", 4326, F.col("epsg")).collect():
        assert (r.x, r.y) == ((None, None) if r.want_x is None else (pytest.approx(r.want_x, abs=1e-3), pytest.approx(r.want_y, abs=1e-3)))
    # forth and back, in and far beyond the zone; the expression and the staged form agree
    every = [(lon, lat, 32600 + 31 + 100 * (lat < 0)) for lon in (-12.0, 0.5, 3.0, 5.9, 20.0) for lat in (-79.0, -33.3, 0.0, 12.0, 60.0)]
    df = spark.createDataFrame(every, "lon double, lat double, epsg int")
    x, y = projections.converted(F.col("lon"), F.col("lat"), 4326, F.col("epsg"))
    there = projections.reprojected(df, "lon", "lat", 4326, F.col("epsg")).withColumn("ex", x).withColumn("ey", y)
    for r in projections.reprojected(there, "x", "y", F.col("epsg"), 4326, ("a", "b")).collect():
        assert (r.a, r.b) == (pytest.approx(r.lon, abs=1e-9), pytest.approx(r.lat, abs=1e-9)) and (r.ex, r.ey) == (pytest.approx(r.x), pytest.approx(r.y))


@pytest.mark.parametrize("size, diagonal", [(4, False), (5, True), (1, True), (50, False)])
def test_parts_of_tiles_are_those_of_the_raster(spark, size, diagonal):
    rnd = np.random.default_rng(size)
    masks = {"noise": rnd.random((13, 17)) < 0.5, "snake": np.zeros((11, 12), bool), "none": np.zeros((3, 9), bool), "all": np.ones((9, 6), bool)}
    masks["snake"][::2] = True
    masks["snake"][1::4, -1] = masks["snake"][3::4, 0] = True
    rows = [(k, *m.shape, [bool(v) or (None if k == "none" else False) for v in m.ravel()]) for k, m in masks.items()] + [("null", 2, 2, None), ("empty", 0, 0, [])]
    scenes = spark.createDataFrame(rows, "s string, height int, width int, m array<boolean>")
    tiles = parts.tiled(scenes, ["s"], "m", size).cache()

    def whole(df):
        out = {k: np.zeros(m.shape, bool) for k, m in masks.items()} | {"null": np.zeros((2, 2), bool)}
        for r in df.collect():
            out[r.s][r.r0 : r.r0 + r.height, r.c0 : r.c0 + r.width] = np.array(r["mask"]).reshape(r.height, r.width)
        return out

    got = whole(parts.without_small(tiles, ["s"], 6, diagonal))
    for k, m in masks.items():
        assert (got[k] == kernels.without_small(m, 6, diagonal)).all(), k
    assert not got["null"].any()
    seeds = {"noise": tuple(int(x) for x in np.argwhere(masks["noise"])[40]), "snake": (0, 0), "none": (1, 1), "all": (8, 5)}
    got = whole(parts.flooded(tiles, spark.createDataFrame([(k, *p) for k, p in seeds.items()], "s string, r int, c int"), ["s"]))
    for k, m in masks.items():
        same = kernels.labelled(m, True)
        assert (got[k] == (m & (same == same[seeds[k]]))).all(), k
    assert parts.without_small(tiles.limit(0), ["s"], 6).count() == 0


def test_rounds_of_parts_send_nothing_to_the_driver(spark, monkeypatch):
    plans, table = [], parts.Rounds.table
    monkeypatch.setattr(parts.Rounds, "table", lambda self, df, name, last=False: plans.append(df._jdf.queryExecution().executedPlan().toString()) or table(self, df, name, last))
    tiles = parts.tiled(spark.createDataFrame([("s", 6, 6, [True] * 36)], "s string, height int, width int, m array<boolean>"), ["s"], "m", 2)
    made = parts.without_small(tiles, ["s"], 36)
    assert all(all(r["mask"]) for r in made.collect())
    plans.append(made._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)
