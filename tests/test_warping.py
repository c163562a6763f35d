"""Rasters on other grids, against plain interpolation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import projections
from strandline.operators import warping
from strandline.sources.raster_files import tiles_of_pixels


def interpolated(image, u, v, nearest):
    """The value at column u and row v, measured from the raster's corner; unknown pixels are left out."""
    h, w = image.shape
    if not (0 <= u < w and 0 <= v < h):
        return None
    if nearest:
        x = image[int(np.floor(v)), int(np.floor(u))]
        return None if np.isnan(x) else x
    total = weight = 0.0
    for i in range(h):
        for j in range(w):
            k = max(0, 1 - abs(v - 0.5 - i)) * max(0, 1 - abs(u - 0.5 - j))
            if k > 0 and not np.isnan(image[i, j]):
                total, weight = total + k * image[i, j], weight + k
    return total / weight if weight else None


@pytest.fixture(scope="module")
def source(spark):
    rnd = np.random.default_rng(3)
    image = rnd.random((11, 13))
    image[4, 4] = image[0, 0] = image[10, 8:] = np.nan
    rows = [("a", "m", r, c, float(v)) for (r, c), v in np.ndenumerate(image) if (r, c) != (7, 7)]
    image[7, 7] = np.nan
    middle = spark.range(1).select(*(c.alias(n) for c, n in zip(projections.converted(F.lit(150.0), F.lit(-33.0), 4326, 32755), "xy", strict=True))).first()
    geo = [round(middle.x) - 90.0, 15.0, 0.0, round(middle.y) + 80.0, 0.0, -15.0]
    pixels = spark.createDataFrame(rows, "site string, other string, r int, c int, v double")
    tiles = tiles_of_pixels(pixels, ["site"], "v", 4).withColumns({"height": F.lit(11), "width": F.lit(13), "georef": F.array(*map(F.lit, geo)), "epsg": F.lit(32755), "r": F.lit("x")})
    return image, geo, tiles.cache()


@pytest.mark.parametrize("epsg", [32755, 32756])
@pytest.mark.parametrize("nearest", [False, True])
def test_other_grids(spark, source, epsg, nearest):
    image, geo, tiles = source
    at = spark.range(1).select(*(c.alias(n) for c, n in zip(projections.converted(F.lit(geo[0]), F.lit(geo[3]), 32755, epsg), "xy", strict=True))).first()
    to = [at.x - 20.0, 6.5, 0.0, at.y + 11.0, 0.0, -9.25]
    grids = spark.createDataFrame([("a", 23, 35, to, epsg), ("none", 5, 5, to, epsg)], "site string, height int, width int, georef array<double>, epsg int")
    got = {(r.r, r.c): r.value for r in warping.warped(tiles, grids, ["site"], 4, nearest, 10).collect()}
    assert len(got) == 23 * 35
    centres = [(r, c, to[0] + (c + 0.5) * to[1], to[3] + (r + 0.5) * to[5]) for r in range(23) for c in range(35)]
    back = projections.reprojected(spark.createDataFrame(centres, "r int, c int, x double, y double"), "x", "y", epsg, 32755) if epsg != 32755 else spark.createDataFrame(centres, "r int, c int, x double, y double")
    known = 0
    for p in back.collect():
        want = interpolated(image, (p.x - geo[0]) / 15, (p.y - geo[3]) / -15, nearest)
        assert got[p.r, p.c] == (None if want is None else pytest.approx(want, abs=1e-9)), (p.r, p.c)
        known += want is not None
    assert known > 400


def test_unknown_systems_and_empty_tables(spark, source):
    _, geo, tiles = source
    grids = spark.createDataFrame([("a", 3, 2, geo, None)], "site string, height int, width int, georef array<double>, epsg int")
    assert [r.value for r in warping.warped(tiles, grids, ["site"], 4).collect()] == [None] * 6
    assert warping.warped(tiles.limit(0), grids, ["site"], 4).count() == warping.warped(tiles, grids.limit(0), ["site"], 4).count() == 0
    assert warping.warped(tiles, grids.withColumn("georef", F.lit(None).cast("array<double>")), ["site"], 4).count() == 0
    same = spark.createDataFrame([("a", 11, 13, geo, 32755)], grids.schema)
    got = warping.warped(tiles, same, ["site"], 4).where("value IS NOT NULL").count()
    assert got == 11 * 13 - 8


def test_grids_of_half_the_pixels(spark):
    rows = [("ten", 4, 6, [100.0, 10.0, 0.0, 50.0, 0.0, -10.0]), ("fifteen", 4, 6, [100.0, 15.0, 0.0, 50.0, 0.0, -15.0]), ("one", 4, 6, [0.0, 1.0, 0.0, 0.0, 0.0, -1.0]), ("null", 4, 6, None)]
    df = spark.createDataFrame(rows, "n string, height int, width int, georef array<double>")
    got = {r.n: r for r in warping.target_grids(df, double_res=True).collect()}
    assert (got["ten"].height, got["ten"].width, got["ten"].georef, got["ten"].error) == (8, 12, [100.0, 5.0, 0.0, 50.0, 0.0, -5.0], None)
    assert all(got[n].georef is None and got[n].error for n in ("fifteen", "one", "null"))
    assert {r.n: r.error for r in warping.target_grids(df).collect()} == {"ten": None, "fifteen": None, "one": None, "null": "no georeference"}


def test_both_values_in_one_pass(spark, source):
    image, geo, tiles = source
    to = [geo[0] - 20.0, 6.5, 0.0, geo[3] + 11.0, 0.0, -9.25]
    grids = spark.createDataFrame([("a", 23, 35, to, 32755)], "site string, height int, width int, georef array<double>, epsg int")
    got = warping.warped_both(tiles, grids, ["site"], 4, 10).collect()
    assert len(got) == 23 * 35
    for p in got:
        u, v = (to[0] + (p.c + 0.5) * to[1] - geo[0]) / 15, (to[3] + (p.r + 0.5) * to[5] - geo[3]) / -15
        for value, nearest in ((p.linear, False), (p.nearest, True)):
            want = interpolated(image, u, v, nearest)
            assert value == (None if want is None else pytest.approx(want, abs=1e-9)), (p.r, p.c, nearest)
