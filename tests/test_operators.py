"""Operators against plain Python on small cases, the edge cases of the fixtures' list first."""

import json
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import kernels, scalar
from strandline.operators import catalog, pixels, scenes, series, transects, validation
from strandline.sources import formats

T0 = datetime(2020, 1, 1)


def test_as_of_edges(spark):
    left = spark.createDataFrame([(1, T0 + timedelta(hours=h)) for h in (-1, 0, 1, 2, 3, 9)], "site int, ts timestamp")
    right = spark.createDataFrame([(1, T0, 10.0), (1, T0 + timedelta(hours=2), 20.0), (1, T0 + timedelta(hours=2), 99.0), (1, T0 + timedelta(hours=4), 30.0)], "site int, t timestamp, v double")
    near = [r.v for r in series.as_of_nearest(left, right, ["site"], "ts", "t", "v", "v").orderBy("ts").collect()]
    assert near == [10.0, 10.0, 10.0, 20.0, 20.0, 30.0]
    later = [r.v for r in series.as_of_next(left, right, ["site"], "ts", "t", "v", "v").orderBy("ts").collect()]
    assert later == [10.0, 20.0, 20.0, 30.0, 30.0, None]


@pytest.mark.parametrize(("gap", "left"), [(300, 1), (301, 2)])
def test_duplicates_within_five_minutes(spark, gap, left):
    rows = [(1, T0, 5, 5, "L8", 0), (1, T0 + timedelta(seconds=gap), 5, 5, "L8", 1)]
    df = spark.createDataFrame(rows, "site int, ts timestamp, l int, n int, satname string, k int")
    got = series.without_duplicates(df, ["site"], "ts", "l", "n", "satname", ["k"]).collect()
    assert [r.k for r in got] == [0, 1][:left]


def test_duplicates_without_points_and_of_l7(spark):
    rows = [(1, T0, 0, 0, "L8", 0), (1, T0, 1, 1, "L8", 1), (2, T0, 9, 9, "L7", 2), (2, T0, 3, 3, "L9", 3)]
    df = spark.createDataFrame(rows, "site int, ts timestamp, l int, n int, satname string, k int")
    assert [r.k for r in series.without_duplicates(df, ["site"], "ts", "l", "n", "satname", ["k"]).collect()] == [3]


@pytest.mark.parametrize(
    ("values", "kept"),
    [([], []), ([1], [1]), ([0, 100], [100]), ([0, 0, 100, 0, 0], [0, 0, 0, 0]), ([100, 0, 0, 0], [0, 0, 0]), ([0, 0, 0, 100], [0, 0, 0]), ([0, 0, 0, 90, 90, 0, 0, 0], [0] * 6), ([0, 1, 2, 1, 0], [0, 1, 2, 1, 0])],
)
def test_despike(values, kept):
    v = np.array(values, float)
    assert v[series.despiked(v, 40)].tolist() == kept


def test_reject_outliers_needs_points(spark):
    df = spark.createDataFrame([("a", T0 + timedelta(days=k), float(k % 3)) for k in range(29)] + [("b", T0 + timedelta(days=k), float(k % 3)) for k in range(30)], "name string, ts timestamp, v double")
    assert {r.name for r in series.reject_outliers(df, ["name"], "ts", "v", 40, []).collect()} == {"b"}


def test_removed_points_are_null_rows(spark):
    rows = [("a", T0 + timedelta(days=k), v, t) for k, (v, t) in enumerate([(0.0, 0.0), (1.0, 0.0), (100.0, 0.0), (None, 0.0), (2.0, 9.0), (1.0, None), (2.0, 0.1)])] + [("b", T0, None, 0.0)]
    df = spark.createDataFrame(rows, "name string, ts timestamp, v double, t double").withColumn("_n", F.lit(1)).drop("_n")
    got = series.reject_outliers(df, ["name"], "ts", "v", 40, [], "t", (-0.5, 0.5), least=2).orderBy("ts").collect()
    assert [(r.name, r.v) for r in got] == [("a", v) for v in (0.0, 1.0, None, None, None, None, 2.0)]


def scan_from_the_front(v, c):
    """The rules as they are written: after each removal from the very front."""
    own, at = list(v), list(range(len(v)))
    again = True
    while again and len(own) > 1:
        again = False
        for k in range(len(own)):
            if series._spike(own, k, c):
                again = k + 1 < len(own) - 1
                del own[k], at[k]
                break
    return [k in at for k in range(len(v))]


def test_despike_goes_on_where_it_may(spark):
    rng = np.random.default_rng(0)
    for n in range(400):
        v = rng.choice([0.0, 1, 50, 90, -50], rng.integers(0, 14), p=[0.4, 0.2, 0.15, 0.15, 0.1])
        assert series.despiked(v, 40).tolist() == scan_from_the_front(v, 40), v.tolist()


def test_series_across_batches(spark):
    rng = np.random.default_rng(1)
    frames = [pd.DataFrame({"s": f"s{k:03}", "ts": [T0 + timedelta(days=i) for i in range(n)], "v": rng.choice([0.0, 1, 100], n, p=[0.5, 0.3, 0.2])}) for k, n in enumerate(rng.integers(1, 40, 60))]
    df = spark.createDataFrame(pd.concat(frames))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = series.reject_outliers(df, ["s"], "ts", "v", 40, [], least=1).toPandas().sort_values(["s", "ts"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = np.concatenate([scan_from_the_front(f["v"].to_numpy(), 40) for f in frames])
    assert (got["v"].notna().to_numpy() == want).all()


def test_a_million_readings_of_one_site(spark):
    tides = spark.range(1_000_000).select(F.lit(1).alias("site"), F.timestamp_seconds(F.col("id") * 900).alias("t"), F.col("id").cast("double").alias("v"))
    scenes_ = spark.range(0, 1_000_000, 50).select(F.lit(1).alias("site"), F.timestamp_seconds(F.col("id") * 900 + 100).alias("ts"), F.col("id"))
    near = series.as_of_nearest(scenes_, tides, ["site"], "ts", "t", "v", "v")
    later = series.as_of_next(scenes_, tides, ["site"], "ts", "t", "v", "v")
    assert near.where("v <> id").count() == 0 and later.where("v <> id + 1").count() == 0


def test_as_of_without_points_times_or_sites(spark):
    left = spark.createDataFrame([(1, T0), (2, T0), (None, T0), (1, None)], "site int, ts timestamp")
    right = spark.createDataFrame([(1, T0 - timedelta(days=4000), 5.0), (1, T0 + timedelta(days=3000), 6.0), (None, T0, 9.0), (1, None, 8.0)], "site int, t timestamp, v double")
    near = {(r.site, r.ts): r.v for r in series.as_of_nearest(left, right, ["site"], "ts", "t", "v", "v").collect()}
    assert near == {(1, T0): 6.0, (2, T0): None, (None, T0): None, (1, None): None}
    later = {(r.site, r.ts): r.v for r in series.as_of_next(left, right, ["site"], "ts", "t", "v", "v").collect()}
    assert later == {(1, T0): 6.0, (2, T0): None, (None, T0): None, (1, None): None}
    assert series.as_of_next(left.limit(0), right.limit(0), ["site"], "ts", "t", "v", "v").count() == 0


def test_december_of_the_last_year_has_no_season(spark):
    df = spark.createDataFrame([("a", datetime(2019, 11, 3), 1.0), ("a", datetime(2019, 12, 3), 5.0)], "name string, ts timestamp, v double")
    assert [(str(r.season), r.mean) for r in series.seasonal_average(df, ["name"], "ts", "v").collect()] == [("2019-10-01", 1.0)]


def test_contour_position(spark):
    df = spark.createDataFrame([("p", 0.0, 5.0), ("p", 10.0, 3.0), ("p", 20.0, 1.0), ("q", 0.0, 9.0)], "profile string, chainage double, elevation double")
    assert {r.profile: r.position for r in series.contour_position(df, ["profile"], "elevation", "chainage", 2.0).collect()} == {"p": 15.0, "q": None}


def test_georef_filter(spark):
    df = spark.createDataFrame([(1, "PASSED", None), (2, "FAILED", 1.0), (3, None, -1.0), (4, None, 10.0), (5, None, 10.1), (6, None, None)], "k int, geo_flag string, geo_rmse double")
    assert {r.k for r in catalog.accurately_placed(df, 10).collect()} == {1, 4}
    assert {r.k for r in catalog.accurately_placed(df, 10, failed_is_minus_one=False).collect()} == {1, 3, 4}


def test_one_projection(spark):
    rows = [("s", "55", T0 + timedelta(hours=h), h) for h in (0, 1, 2, 60)] + [("s", "56", T0, 100)]
    df = spark.createDataFrame(rows, "site string, zone string, ts timestamp, k int")
    assert sorted(r.k for r in catalog.one_projection(df, "site", "zone", "ts", "k").collect()) == [0, 1, 60]


def test_split_date_range():
    parts = scalar.split_date_range(datetime(2020, 1, 1), datetime(2020, 1, 12), 3)
    assert parts[0][0] == datetime(2020, 1, 1) and parts[-1][1] == datetime(2020, 1, 12) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    with pytest.raises(ValueError):
        scalar.split_date_range(datetime(2020, 1, 2), datetime(2020, 1, 1), 2)


def test_quality_modes(spark):
    lines = spark.createDataFrame([("T", 0.0, 0.0, 100.0, 0.0)], "name string, x0 double, y0 double, x1 double, y1 double")
    pts = spark.createDataFrame([(1, 10.0, 0.0), (1, 11.0, 0.0), (1, 12.0, 0.0), (2, 10.0, 0.0), (2, 60.0, 1.0), (2, 90.0, 2.0), (3, -500.0, 0.0)], "scene int, x double, y double")
    frame = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "scene int")
    get = lambda mode, share=0.1: {r.scene: (r.chainage, r.n) for r in transects.quality_checked(pts, lines, frame, "scene", mode=mode, share=share).collect()}
    assert get("nan") == {1: (11.0, 3), 2: (None, 3), 3: (None, 0), 4: (None, 0)}
    assert get("max")[2] == (90.0, 3) and get("auto")[2] == (90.0, 3) and get("auto", 0.25)[2] == (None, 3)
    with pytest.raises(ValueError):
        get("median")


def test_quality_is_by_site(spark):
    lines = spark.createDataFrame([("a", "T", 0.0, 0.0, 100.0, 0.0), ("b", "T", 0.0, 0.0, 100.0, 0.0), ("b", "U", 0.0, 50.0, 100.0, 50.0)], "site string, name string, x0 double, y0 double, x1 double, y1 double")
    pts = spark.createDataFrame([("a", 1, 10.0, 0.0), ("a", 1, 60.0, 0.0), ("a", 1, 90.0, 0.0), ("b", 2, 10.0, 0.0), ("b", 2, 11.0, 0.0), ("b", 2, 12.0, 0.0)], "site string, scene int, x double, y double")
    frame = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("b", 4)], "site string, scene int")
    got = {(r.site, r.scene, r["name"]): (r.chainage, r.n) for r in transects.quality_checked(pts, lines, frame, "scene", share=0.3, site=["site"]).collect()}
    # one of one scene of site a spreads; by all four scenes together it would be a quarter
    assert got == {("a", 1, "T"): (90.0, 3), ("b", 2, "T"): (11.0, 3), ("b", 3, "T"): (None, 0), ("b", 4, "T"): (None, 0), ("b", 2, "U"): (None, 0), ("b", 3, "U"): (None, 0), ("b", 4, "U"): (None, 0)}


def test_points_behind_the_origin_count_in_quality_only(spark):
    lines = spark.createDataFrame([("E", 0.0, 0.0, 100.0, 0.0), ("W", 0.0, 0.0, -100.0, 1e-9)], "name string, x0 double, y0 double, x1 double, y1 double")
    pts = spark.createDataFrame([(1, 10.0, 1.0), (1, 12.0, -1.0), (1, -30.0, 1.0), (1, -40.0, -1.0)], "scene int, x double, y double")
    got = {r["name"]: r.chainage for r in transects.intersections(pts, lines, 10, "scene").collect()}
    assert got["E"] == 11.0 and abs(got["W"] - 30) < 1e-6  # due west the half below is lost, as angles aren't wrapped
    every = {r["name"]: r.chainage for r in transects.near_transects(pts, lines, 10, ["scene"]).groupBy("name").agg(F.median("chainage").alias("chainage")).collect()}
    assert every["E"] == -10.0


def test_create_transect(spark):
    p = spark.range(1).select(transects.create_transect(F.lit(1.0), F.lit(2.0), F.lit(90.0), 3).alias("p")).first().p
    assert len(p) == 4 and abs(p[3].x - 4) < 1e-9 and abs(p[3].y - 2) < 1e-9


def test_local_std_and_masks(spark):
    rng = np.random.default_rng(1)
    image = rng.normal(size=(7, 9))
    image[2, 3] = image[0, 0] = np.nan
    rows = [(0, int(r), int(c), None if np.isnan(v) else float(v), 7, 9) for (r, c), v in np.ndenumerate(image)]
    df = spark.createDataFrame(rows, "s int, r int, c int, v double, h int, w int")
    got = np.full(image.shape, np.nan)
    for r in pixels.local_std(df, ["s"], "v", "h", "w").collect():
        got[r.r, r.c] = np.nan if r["std"] is None else r["std"]
    np.testing.assert_allclose(got, kernels.local_std(image), atol=1e-9)


def test_qa_bits(spark):
    got = [r.b for r in spark.range(32).orderBy("id").select(scalar.cloud_by_bits(F.col("id")).alias("b")).collect()]
    assert got == [bool(q >> 1 & 1 or q >> 2 & 1 or q >> 3 & 1) for q in range(32)]


def test_components_and_morphology():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 1]], bool)
    assert kernels.without_small(mask, 2).sum() == 3 and kernels.without_small(mask, 2, True).sum() == 5
    assert kernels.labelled(np.ones((2, 2), bool)).tolist() == [[1, 1], [1, 1]]
    one = np.zeros((5, 5), bool)
    one[2, 2] = True
    assert (kernels.dilated(one, kernels.disk(1)) == np.array([[0] * 5, [0, 0, 1, 0, 0], [0, 1, 1, 1, 0], [0, 0, 1, 0, 0], [0] * 5], bool)).all()
    assert not kernels.opened(one, np.ones((2, 2), bool)).any()
    block = np.zeros((20, 20), bool)
    block[7:13, 5:11] = True
    assert (kernels.opened(block, np.ones((6, 6), bool)) == block).all()
    rng = np.random.default_rng(0)
    for diagonal in (False, True):
        mask = rng.random((30, 40)) < 0.5
        parts, todo = np.zeros(mask.shape, int), {tuple(p) for p in np.argwhere(mask)}
        while todo:
            stack, number = [min(todo)], parts.max() + 1
            while stack:
                p = stack.pop()
                if p in todo:
                    todo.remove(p)
                    parts[p] = number
                    stack += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if diagonal or 0 in (i, j)]
        assert (kernels.labelled(mask, diagonal) == parts).all()
    assert kernels.flooded(np.array([[1.0, 1.1], [5, 1.2]]), (0, 0), 0.5).tolist() == [[True, True], [False, True]]


def test_scene_kernels(spark):
    bands = [[float(k + i) for i in range(12)] for k in range(5)]
    df = spark.createDataFrame([("a", 3, 4, bands, [False] * 12), ("b", 3, 5, bands, [False] * 12)], "scene_id string, height int, width int, bands array<array<double>>, cloud array<boolean>")
    got = {r.scene_id: r for r in scenes.classified(df, lambda x: (x[:, 0] > 5).astype(int), {1: 3}).collect()}
    assert sum(got["a"].labels) == 6 and got["a"].error is None and got["b"].labels is None and got["b"].error
    pan = spark.createDataFrame([("a", 3, 4, bands[:3], [float(i) for i in range(12)], [False] * 12)], "scene_id string, height int, width int, bands array<array<double>>, pan array<double>, cloud array<boolean>")
    np.testing.assert_allclose(scenes.sharpened(pan).first().bands, bands[:3], atol=1e-9)


def test_equal_pan_pixels_get_equal_values():
    x = np.random.default_rng(0).normal(size=(50, 3))
    pan = np.repeat(np.arange(10.0), 5)
    out = kernels.pansharpened(x, pan, np.zeros(50, bool))
    _, vectors = np.linalg.eigh(np.cov((x - x.mean(0)).T))
    first = (out - x.mean(0)) @ vectors[:, -1]
    assert all(np.ptp(first[pan == k]) < 1e-9 for k in range(10))
    assert kernels.histogram_matched(np.array([1.0, 1, 2, 3]), np.array([10.0, 20, 30, 40])).tolist() == [20.0, 20.0, 30.0, 40.0]


def test_polygons_and_floods(spark):
    bands = [[float(k * 7 + i % 5) for i in range(30)] for k in range(1, 6)]
    tiles = spark.createDataFrame([("a", 5, 6, bands)], "scene_id string, height int, width int, bands array<array<double>>")
    rings = spark.createDataFrame([("a", "sand", [(0.5, 0.5), (3.5, 0.5), (3.5, 2.5), (0.5, 2.5)])], "scene_id string, class string, ring array<struct<x:double,y:double>>")
    rows = scenes.labelled_by_polygons(tiles, rings).collect()
    assert len(rows) == 6 and all(r["class"] == "sand" and len(r.features) == 20 for r in rows)
    flood = tiles.select("scene_id", "height", "width", F.array(*[F.lit(v) for v in [1.0, 1.0, 5.0] * 10]).alias("values"), F.array(*[F.lit(v) for v in [0.0] * 15 + [9.0] * 15]).alias("others"), F.lit(0).alias("seed_r"), F.lit(1).alias("seed_c"), F.lit(0.5).alias("tolerance"))
    assert sum(scenes.flooded(flood).first().mask) == 6  # two columns, of which the first three rows are like the seed in the others


def flat_scene(sat="L8", **more):
    """30 x 40 pixels: water left of column 20, sand right of it; index (swir - g) / (swir + g) from -0.5 to 0.5."""
    water = np.arange(40) < 20
    plane = lambda w, s: np.tile(np.where(water, w, s), (30, 1)).ravel().tolist()
    bands = [plane(0.1, 0.3), plane(0.3, 0.3), plane(0.1, 0.3), plane(0.1, 0.6), plane(0.1, 0.9)]
    row = {"scene_id": "a", "site": "s", "satname": sat, "acq_ts": T0, "height": 30, "width": 40, "bands": bands, "pan": None, "qa": [1] * 1200, "cloud_prob": None, "georef": [1000.0, 15.0, 0.0, 5000.0, 0.0, -15.0], "epsg": 32756}
    return row | more


def extracted(spark, rows, settings, **more):
    from strandline.operators.scenes import TILES
    from strandline.plans import extraction

    by_index = lambda x: np.where(x[:, 6] > 0, 1, 3)
    classes = extraction.classified_scenes(spark.createDataFrame([[r[c.split()[0]] for c in TILES.split(", ")] for r in rows], TILES), by_index, settings).cache()
    return {r.scene_id: r for r in classes.collect()}, {r.scene_id: r for r in extraction.shorelines(classes, settings, **more).collect()}


def test_extraction(spark):
    from strandline.plans.extraction import Detection

    cloudy = [9] * 600 + [1] * 600
    some = np.ones((30, 40), int)
    some[:8, 16:26] = 9
    nan = flat_scene()["bands"][:]
    nan[0] = [float("nan")] * 41 + nan[0][41:]
    rows = [flat_scene(), flat_scene(scene_id="b", qa=cloudy), flat_scene(scene_id="c", qa=some.ravel().tolist()), flat_scene(scene_id="d", height=31), flat_scene("L7", scene_id="e"), flat_scene(scene_id="f", bands=nan)]
    settings = Detection(dist_clouds=45, min_length_sl=200)
    classes, got = extracted(spark, rows, settings)
    assert {k: bool(r.reason) for k, r in classes.items()} == {"a": False, "b": True, "c": False, "d": True, "e": False, "f": False} and classes["d"].error
    assert classes["c"].cover == pytest.approx(80 / 1200) and classes["f"].cover == 0 and classes["f"].combined == pytest.approx(41 / 1200)
    a = got["a"].pts
    # NIR and green of as many sand as water pixels give the threshold; SWIR and green cross it between columns 19 and 20
    share = (got["a"].threshold + 0.5) / 1.0
    assert len(a) == 30 and all(p.x == pytest.approx(1000 + 15 * (19 + share)) for p in a) and sorted(p.y for p in a) == [5000.0 - 15 * r for r in range(29, -1, -1)]
    assert [p.y for p in a] in (sorted(p.y for p in a), sorted((p.y for p in a), reverse=True))
    assert {p.y for p in got["c"].pts} == {5000.0 - 15 * r for r in range(10, 30)}  # rows 8 and 9 are within 45 m of cloud
    assert len(got["e"].pts) == 30 and {p.y for p in got["f"].pts} == {5000.0 - 15 * r for r in range(2, 30)}  # 30 m from what is unknown
    _, short = extracted(spark, rows[:1] + rows[4:5], Detection(min_length_sl=1000))
    assert len(short["a"].pts) == 0 and len(short["e"].pts) == 30  # Landsat 7 is held to 200 m
    _, within = extracted(spark, rows[:1], settings, area=[[(0.0, 4700.0), (9999.0, 4700.0), (9999.0, 4801.0), (0.0, 4801.0)]])
    assert {p.y for p in within["a"].pts} == {5000.0 - 15 * r for r in range(14, 20)}
    reference = spark.createDataFrame([("s", 1300.0, 5000.0 - 15 * r) for r in range(1, 10)], "site string, x double, y double")
    _, near = extracted(spark, rows[:1], Detection(min_length_sl=50, max_dist_ref=45), reference=reference)
    assert {p.y for p in near["a"].pts} == {5000.0 - 15 * r for r in range(0, 12)}  # three pixels below row 9 the disk has one column


def test_sentinel_preprocessing(spark):
    from strandline.operators.scenes import TILES

    base = flat_scene("S2")
    scaled = [(np.array(b) * 10_000).tolist() for b in base["bands"]]
    scaled[4] = np.where(np.arange(1200) % 40 < 2, 0, scaled[4]).tolist()
    prob = np.zeros((30, 40))
    prob[5:11, 30:36], prob[20, :] = 99, 99
    rows = [flat_scene("S2", bands=scaled, cloud_prob=prob.ravel().tolist()), flat_scene("S2", scene_id="a_merged", bands=scaled), flat_scene("S2", scene_id="zero", bands=[[0.0] * 1200] * 5)]
    df = spark.createDataFrame([[r[c.split()[0]] for c in TILES.split(", ")] for r in rows], TILES)
    got = {r.scene_id: r for r in scenes.preprocessed(df).collect()}
    assert np.allclose(got["a"].bands[3], base["bands"][3]) and sum(got["a"].nodata) == 60 and sum(got["a"].cloud) == 60 + 36
    assert sum(got["a_merged"].nodata) == 120 and sum(got["a_merged"].cloud) == 60 and all(got["zero"].cloud)


def test_lines_part_and_close(spark):
    from strandline.operators import contours

    v = np.zeros((6, 7))
    v[1, 1] = v[4, 4] = v[3, 5] = 1
    v[0, 6] = np.nan
    df = spark.createDataFrame([(0, int(r), int(c), float(x)) for (r, c), x in np.ndenumerate(v)], "s int, r int, c int, v double")
    lines = contours.contour_lines(contours.contour_segments(df, ["s"], "v", F.lit(0.5)), ["s"]).toPandas().sort_values("pt_idx")
    assert lines.groupby("line").size().tolist() == [5, 5, 5]  # three diamonds; the two that meet at a corner are cut apart
    for _, g in lines.groupby("line"):
        assert (g.iloc[0][["row", "col"]] == g.iloc[-1][["row", "col"]]).all()
    assert contours.contour_segments(df, ["s"], "v", F.lit(5.0)).count() == 0


def test_survey_match(spark):
    day = lambda k: (T0 + timedelta(days=k)).date()
    s = spark.createDataFrame([("p", day(k)) for k in (-5, 0, 2, 5, 12, 21, 25, 40)], "profile string, day date").withColumn("x", F.lit(0.0))
    v = spark.createDataFrame([("p", day(1), 10.0), ("p", day(11), 20.0), ("p", day(20), 30.0)], "profile string, sday date, pos double")
    got = [r.survey for r in validation.survey_match(s, v, ["profile"], "day", "x", "sday", "pos").orderBy("day").collect()]
    # the day after the last survey takes its value; five days later there is none to interpolate with, nor before the first
    assert got == [None, 10.0, 10.0, 14.0, 20.0, 30.0, None, None]


def test_seven_pairs_have_no_statistics(spark):
    df = spark.createDataFrame([(k, float(i), float(i) + 1) for k, n in (("a", 7), ("b", 8)) for i in range(n)] + [("a", None, 1.0)], "k string, est double, truth double")
    (row,) = validation.error_statistics(df, ["k"], "est", "truth", 8).collect()
    assert (row.k, row.n, row.rmse, row.mean_error, row.slope) == ("b", 8, 1.0, -1.0, 1.0)


def test_utm_of_a_known_point(spark):
    x, y = scalar.lonlat_to_utm(F.lit(151.0), F.lit(-33.0), 56, True)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x - 313152.8) < 1 and abs(r.y - 6346937.4) < 1
    lon, lat = scalar.converted(F.lit(342880.0), F.lit(6269180.0), 28356, 4326)
    r = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert abs(r.lon - 151.303) < 0.01 and abs(r.lat + 33.705) < 0.01
    with pytest.raises(ValueError):
        scalar.converted(F.lit(0.0), F.lit(0.0), 4326, 2154)


def test_formats(spark, tmp_path):
    line = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "A1"}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}}]}
    (tmp_path / "t.geojson").write_text(json.dumps(line))
    assert tuple(formats.transects_geojson(spark, str(tmp_path / "t.geojson")).first()) == ("A1", 1.0, 2.0, 3.0, 4.0)
    (tmp_path / "p.kml").write_text("<kml><Placemark><coordinates>\n 151.1,-33.5,0\n 151.2,-33.6,0\n</coordinates></Placemark></kml>")
    assert [(r.x, r.y) for r in formats.polygon_kml(spark, str(tmp_path / "p.kml")).collect()] == [(151.1, -33.5), (151.2, -33.6)]
    (tmp_path / "m.txt").write_text("filename\t2020-01-02-03-04-05_L8_X_ms.tif\nepsg\t28356\nacc_georef\tPASSED\nim_width\t10\n")
    m = formats.metadata_folder(spark, str(tmp_path / "m.txt"), "2020-01-01", "2020-02-01").first()
    assert (m.epsg, m.geo_flag, m.geo_rmse, m.im_width, m.im_height) == (28356, "PASSED", None, 10, None)
    arrays = {"dates": ["2020-01-01T00:00:00+00:00"] * 2, "shorelines": [[[1, 2], [3, 4]], []], "filename": ["a", "b"], "cloud_cover": [0.1, 0.2], "geoaccuracy": ["PASSED", "5.5"], "idx": [0, 1], "MNDWI_threshold": [0.0, 0.1], "satname": ["L8", "S2"]}
    (tmp_path / "o.json").write_text(json.dumps(arrays))
    rows = formats.shorelines_json(spark, str(tmp_path / "o.json"))
    assert [len(r.pts) for r in rows.orderBy("idx").collect()] == [2, 0]
    made = [json.loads(r.value) for r in formats.features_json(rows, "pts", "lines", ["satname"]).collect()]
    assert made == [{"type": "Feature", "properties": {"satname": "L8"}, "geometry": {"type": "LineString", "coordinates": [[1.0, 2.0], [3.0, 4.0]]}}]
    with pytest.raises(ValueError):
        formats.geometry_json(F.col("pts"), "areas")


def test_streaming(spark, tmp_path):
    from strandline.streaming import scenes as streams

    spark.createDataFrame([(1, T0, 1.0), (1, T0 + timedelta(seconds=1), 2.0)], "site int, ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    tides = spark.createDataFrame([(T0, 0.5)], "ts timestamp, tide double")
    stream = streams.corrected(streams.first_of_repeats(spark.readStream.schema("site int, ts timestamp, v double").parquet(str(tmp_path / "in")), ["site"], "ts"), tides, "ts", "v", 0.5, 0.1)
    q = stream.writeStream.format("memory").queryName("corrected").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("corrected").count() == 1


def test_training(spark, tmp_path):
    from strandline.plans import training

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    rows = spark.createDataFrame(pd.DataFrame({"y": (x[:, 0] > 0).astype(int), "x": x.tolist()}))
    table = training.training_table(rows, "y", "x").cache()
    model, matrix = training.trained(table, [3, 4, 2])
    counts = matrix.collect()
    assert sum(r.n for r in counts if r.label == r.prediction) > 0.85 * sum(r.n for r in counts)
    folds = training.cross_validated(table, [3, 2], 3)
    assert sum(n for n, _ in folds) == 200 and min(a for _, a in folds) > 0.8
    model.save(str(tmp_path / training.model_name("L8", "dark")))
    again = training.loaded(str(tmp_path), "L8", "dark")
    labels = training.predictor(again)(x)
    assert labels.tolist() == [int(r.prediction) for r in model.transform(training.training_table(rows, "y", "x")).collect()]
    for site in ("one", "two"):
        spark.createDataFrame([("sand", [1.0])], "class string, features array<double>").write.parquet(str(tmp_path / "rows" / f"site={site}"))
    assert training.united([training.training_rows(spark, str(tmp_path / "rows"), ["one", "none"])] * 2).count() == 2
    with pytest.raises(ValueError):
        training.model_name("L8", "green")


def test_chain(spark):
    from strandline.plans.shoreline_series import corrected_series

    pts = [(float(50 + k), 0.0) for k in range(5)]
    s = spark.createDataFrame([("site", "a", "L8", T0, "PASSED", None, pts), ("site", "b", "L8", T0 + timedelta(days=9), "FAILED", None, pts)], "site string, scene_id string, satname string, acq_ts timestamp, geo_flag string, geo_rmse double, pts array<struct<x:double,y:double>>")
    lines = spark.createDataFrame([("site", "T", 0.0, 0.0, 100.0, 0.0)], "site string, name string, x0 double, y0 double, x1 double, y1 double")
    tides = spark.createDataFrame([("site", T0, 0.8)], "site string, ts timestamp, tide double")
    (row,) = corrected_series(s, lines, tides).collect()
    assert row.scene_id == "a" and abs(row.chainage - 53.0) < 1e-9


def test_the_shorter_line_goes_not_the_one_of_fewer_points(spark):
    from strandline.plans.shoreline_series import corrected_series

    dense, long = [(float(50 + k / 10), 0.0) for k in range(9)], [(50.0, -5.0), (50.0, 0.0), (50.0, 5.0)]
    s = spark.createDataFrame([("site", "a", "L8", T0, "PASSED", None, dense), ("site", "b", "L8", T0 + timedelta(minutes=1), "PASSED", None, long)], "site string, scene_id string, satname string, acq_ts timestamp, geo_flag string, geo_rmse double, pts array<struct<x:double,y:double>>")
    lines = spark.createDataFrame([("site", "T", 0.0, 0.0, 100.0, 0.0)], "site string, name string, x0 double, y0 double, x1 double, y1 double")
    tides = spark.createDataFrame([("site", T0, 0.7)], "site string, ts timestamp, tide double")
    assert [r.scene_id for r in corrected_series(s, lines, tides).collect()] == ["b"]


def test_pages_and_ingest(spark):
    from strandline.sources import catalogue

    days = [datetime(2020, 1, 1) + timedelta(days=k) for k in range(40)]
    of = lambda a, b: [d for d in days if a <= d < b]
    assert len(catalogue.date_pages(days[0], days[-1], lambda a, b: len(of(a, b)), 10)) >= 4

    def fetch(a, b):
        return [{"satname": "L8", "tier": "T1", "id": str(d.date()), "properties": {"system:time_start": str(int(d.timestamp() * 1000)), "CLOUD_COVER": "5.5", "GEOMETRIC_RMSE_MODEL": "7.1"}, "bands": [{"id": "B2", "crs": "EPSG:32656"}, {"id": "MSK_CLASSI_1", "crs": "x"}]} for d in of(a, b)]

    found = catalogue.paged(spark, days[0], datetime(2020, 2, 20), lambda a, b: len(of(a, b)), fetch, 10)
    rows = catalogue.scenes_of(found).orderBy("scene_id").collect()
    assert len(rows) == 40 and (rows[0].epsg, rows[0].cloud_pct, rows[0].geo_rmse, rows[0].im_quality) == (32656, 5.5, 7.1, "NA")
    assert {len(r.bands) for r in catalogue.bands_of(found, ["B2", "MSK_CLASSI_1"]).collect()} == {1}

    def pixels_of(row):
        if row["scene_id"].endswith("03"):
            raise OSError("no connection")
        return {"height": 1, "width": 2, "bands": [[1.0, 2.0]], "qa": [1, 1], "georef": [0.0] * 6}

    got = catalogue.ingested(catalogue.scenes_of(found), pixels_of, 2, 0.0).collect()
    assert sum(r.error is not None for r in got) == 2 and all((r.error is None) == (r.bands is not None) for r in got)
    calls = []
    with pytest.raises(ValueError):
        catalogue.retried(lambda: calls.append(1) or int("x"), 3, 0.0)
    assert len(calls) == 3


def test_round_trip_of_shorelines(spark, tmp_path):
    rows = [("s", T0 + timedelta(days=k), "L8", f"f{k}", 0.1, 5.0 if k else None, None if k else "PASSED", k, 0.0, [(1.0, 2.0), (3.0, 4.0)][: 2 * k]) for k in range(2)]
    df = spark.createDataFrame(rows, "site string, acq_ts timestamp, satname string, filename string, cloud_cover double, geo_rmse double, geo_flag string, idx int, mndwi_threshold double, pts array<struct<x:double,y:double>>")
    formats.shorelines_arrays(df).drop("site").write.json(str(tmp_path / "out"))
    back = formats.shorelines_json(spark, str(tmp_path / "out")).orderBy("idx").collect()
    assert [(r.acq_ts, r.satname, r.geo_rmse, r.geo_flag, len(r.pts)) for r in back] == [(T0, "L8", None, "PASSED", 0), (T0 + timedelta(days=1), "L8", 5.0, None, 2)]
    points = formats.exploded_points(back and formats.shorelines_json(spark, str(tmp_path / "out")), "pts", "idx")
    assert [len(r.pts) for r in formats.collected_points(points, ["idx"], "pt_idx").collect()] == [2]
    (tmp_path / "series.csv").write_text("dates,A,B\n2020-01-01 00:00:00,1.5,\n")
    assert {(r["name"], r.chainage) for r in formats.series_csv(spark, str(tmp_path / "series.csv"), ["A", "B"]).collect()} == {("A", 1.5), ("B", None)}
    (tmp_path / "p.geojson").write_text(json.dumps({"features": [{"geometry": {"coordinates": [[[1, 2], [3, 4], [1, 2]]]}}]}))
    assert [(r.pt_idx, r.x, r.y) for r in formats.polygon_geojson(spark, str(tmp_path / "p.geojson")).collect()] == [(0, 1.0, 2.0), (1, 3.0, 4.0), (2, 1.0, 2.0)]
    lines = spark.createDataFrame([("T", 0.0, 1.0, 2.0, 3.0)], "name string, x0 double, y0 double, x1 double, y1 double")
    assert json.loads(formats.transects_json(lines).first().value)["geometry"] == {"type": "LineString", "coordinates": [[0.0, 1.0], [2.0, 3.0]]}


def test_pixels_and_metres():
    assert scalar.pixels_of_area(1000, 15) == 5 and scalar.pixels_of_area(900, 15) == 4 and scalar.pixels_of_distance(100, 15) == 7
    assert scalar.landsat_tier("C01") == "C02"
    with pytest.raises(ValueError):
        scalar.landsat_tier("C03")


def test_merge_plan_chains_and_drops(spark):
    at = [0, 200, 400, 600, 1000, 1301]  # five minutes at most between neighbours: a run of four, then two alone
    df = spark.createDataFrame([("a", k, datetime(2020, 1, 1) + timedelta(seconds=s)) for k, s in enumerate(at)], "site string, id int, ts timestamp")
    got = {r.id: (r.first, r.place, r.action) for r in catalog.merge_plan(df, ["site"], "ts", ["id"], "id").collect()}
    assert got == {0: (0, 1, "base"), 1: (0, 2, "merge"), 2: (0, 3, "merge"), 3: (0, 4, "drop"), 4: (4, 1, "single"), 5: (5, 1, "single")}
    assert catalog.merge_plan(df.limit(0), ["site"], "ts", ["id"], "id").count() == 0


def test_contained_footprints(spark):
    rows = [(1, 0, 0.0, 9.0, 0.0, 9.0), (1, 1, 1.0, 2.0, 1.0, 2.0), (1, 2, 0.0, 9.0, 0.0, 9.0), (2, 3, 0.0, 2.0, 0.0, 2.0), (2, 4, 1.0, 3.0, 1.0, 3.0), (3, 5, None, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "ts int, id int, x_min double, x_max double, y_min double, y_max double")
    assert sorted(r.id for r in catalog.without_contained(df, ["ts"], ["id"]).collect()) == [0, 3, 4, 5]


def test_bilinear_skips_unknown_pixels(spark):
    cells = [(0, 0, 0.0), (0, 1, 4.0), (1, 0, None), (1, 1, 8.0)]
    df = spark.createDataFrame(cells, "r int, c int, v double").withColumn("rows", F.lit(2)).withColumn("cols", F.lit(2))
    got = {(r.r, r.c): r.v for r in pixels.bilinear_resampled(df, [], "v", "rows", "cols", 2).collect()}
    assert got[0, 0] == 0 and got[0, 1] == pytest.approx(1) and got[3, 3] == 8 and (3, 0) not in got
    assert got[1, 1] == pytest.approx((0.5625 * 0 + 0.1875 * 4 + 0.0625 * 8) / 0.8125)


@pytest.mark.parametrize("factor", [1, 2, 3])
def test_bilinear_of_a_plane_is_the_plane(spark, factor):
    df = spark.createDataFrame([(r, c, 3.0 * r - c) for r in range(4) for c in range(5)], "r int, c int, v double").withColumn("rows", F.lit(4)).withColumn("cols", F.lit(5))
    got = {(r.r, r.c): r.v for r in pixels.bilinear_resampled(df, [], "v", "rows", "cols", factor).collect()}
    held = lambda k, n: min(max((k + 0.5) / factor - 0.5, 0), n - 1)
    want = {(r, c): 3 * held(r, 4) - held(c, 5) for r in range(4 * factor) for c in range(5 * factor)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_buffer_without_reference_is_everywhere(spark):
    df = spark.createDataFrame([(0, 0), (5, 5)], "r int, c int")
    points = spark.createDataFrame([(4.9, 5.2), (0.5, 0.5), (99.0, 99.0)], "row double, col double")
    assert {(r.r, r.near) for r in pixels.reference_buffer(df, [], points.limit(0), 2).collect()} == {(0, True), (5, True)}
    assert not any(r.near for r in pixels.reference_buffer(df, [], points, 2).collect())  # neither hits a pixel of the scene past the edge
    near = pixels.reference_buffer(df.union(df.select(F.col("r") - 1, F.col("c"))), [], points, 2)
    assert {(r.r, r.near) for r in near.collect()} == {(-1, False), (0, False), (4, True), (5, True)}


def test_densified_leaves_the_end_out(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 2.5, 0.0), (1, 2, 2.5, 0.0), (2, 0, 1.0, 1.0)], "line int, k int, x double, y double")
    assert sorted((r.line, r.x, r.y) for r in pixels.densified(df, ["line"], "k").collect()) == [(1, 0.0, 0.0), (1, 1.0, 0.0), (1, 2.0, 0.0)]


def tiff(bands, georef, epsg, order="<", deflated=False, tile=None, planar=1):
    """A small GeoTIFF file, by hand."""
    import struct
    import zlib

    cube = np.stack(bands, -1)
    h, w, n = cube.shape
    kind = cube.dtype.newbyteorder(order)
    size, fields, parts = cube.dtype.itemsize, {}, []
    planes = [cube[..., k : k + 1] for k in range(n)] if planar == 2 else [cube]
    for plane in planes:
        if tile:
            for r in range(0, h, tile):
                for c in range(0, w, tile):
                    whole = np.zeros((tile, tile, plane.shape[-1]), cube.dtype)
                    part = plane[r : r + tile, c : c + tile]
                    whole[: part.shape[0], : part.shape[1]] = part
                    parts.append(whole.astype(kind).tobytes())
        else:
            parts += [plane[r : r + 2].astype(kind).tobytes() for r in range(0, h, 2)]
    parts = [zlib.compress(p) for p in parts] if deflated else parts
    starts, body = [], b""
    for p in parts:
        starts.append(8 + len(body))
        body += p
    body += b"\0" * (len(body) % 2)
    code = {"u": 1, "i": 2, "f": 3}[cube.dtype.kind]
    fields = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [8 * size] * n), 259: ("H", [8 if deflated else 1]), 277: ("H", [n]), 284: ("H", [planar]), 339: ("H", [code] * n)}
    fields |= {322: ("I", [tile]), 323: ("I", [tile]), 324: ("I", starts), 325: ("I", list(map(len, parts)))} if tile else {273: ("I", starts), 278: ("I", [2]), 279: ("I", list(map(len, parts)))}
    fields |= {33550: ("d", [georef[1], -georef[5], 0.0]), 33922: ("d", [0.0, 0.0, 0.0, georef[0], georef[3], 0.0]), 34735: ("H", [1, 1, 0, 1, 3072, 0, 1, epsg])}
    at, extra, entries = 8 + len(body), b"", b""
    beyond = at + 2 + 12 * len(fields) + 4
    for tag, (c, values) in sorted(fields.items()):
        raw = struct.pack(order + c * len(values), *values)
        if len(raw) > 4:
            value, extra = struct.pack(order + "I", beyond + len(extra)), extra + raw
        else:
            value = raw.ljust(4, b"\0")
        entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "d": 12}[c], len(values)) + value
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + body + struct.pack(order + "H", len(fields)) + entries + struct.pack(order + "I", 0) + extra


def test_geotiffs(spark, tmp_path):
    from strandline.sources import rasters

    rng = np.random.default_rng(0)
    geo = [300000.0, 15.0, 0.0, 6200000.0, 0.0, -15.0]
    bands = [rng.normal(size=(5, 7)).astype("f4") for _ in range(5)]
    for k, more in enumerate([{}, {"order": ">"}, {"deflated": True}, {"tile": 4}, {"planar": 2}, {"tile": 4, "planar": 2, "deflated": True, "order": ">"}]):
        got = rasters.decoded(tiff(bands, geo, 32756, **more))
        assert (got["height"], got["width"], got["georef"], got["epsg"]) == (5, 7, geo, 32756), k
        assert all((a == b.ravel()).all() for a, b in zip(got["bands"], bands, strict=True)), k
    for name, raw in (("ms", bands), ("pan", bands[:1]), ("mask", [np.arange(35, dtype="u2").reshape(5, 7)])):
        (tmp_path / f"2020-01-02-03-04-05_L8_MY_SITE_{name}.tif").write_bytes(tiff(raw, geo, 32756))
    for name, raw in (("ms", bands), ("swir", bands[4:]), ("mask", [np.ones((5, 7), "u2")])):
        (tmp_path / f"2020-01-02-03-04-05_S2_MY_SITE_{name}_dup1.tif").write_bytes(tiff(raw, geo, 32756))
    (tmp_path / "broken_ms.tif").write_bytes(b"II*")
    files = rasters.geotiffs(spark, str(tmp_path))
    assert [r.path.rsplit("/")[-1] for r in files.where("error is not null").collect()] == ["broken_ms.tif"]
    a, b = rasters.scene_tiles(files).orderBy("satname").collect()
    assert (a.satname, a.site, a.acq_ts, a.height, a.width, len(a.bands), a.qa[3], a.cloud_prob) == ("L8", "MY_SITE", datetime(2020, 1, 2, 3, 4, 5), 5, 7, 5, 3, None) and len(a.pan) == 35
    assert (b.satname, b.site, b.pan) == ("S2", "MY_SITE", None) and b.bands[4] == b.cloud_prob == bands[4].ravel().astype(float).tolist()
    assert set(a.asDict()) == {c.split()[0] for c in scenes.TILES.split(", ")}
