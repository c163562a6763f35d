"""Whole scenes as rows (scene_id, satname, height, width, bands as arrays, ...) through numpy kernels: one Arrow crossing a scene."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import kernels

#: Columns of a scene: bands B, G, R, NIR and SWIR1; pan and cloud_prob may be NULL.
TILES = (
    "scene_id string, site string, satname string, acq_ts timestamp, height int, width int, bands array<array<double>>, pan array<double>, qa array<int>, "
    "cloud_prob array<double>, georef array<double>, epsg int"
)


def _each(tiles: DataFrame, make: Callable[[pd.Series], dict], schema: str) -> DataFrame:
    """tiles with the columns of `schema`, made of each scene by itself, and `error`: why that failed, the columns then being NULL."""
    added = T._parse_datatype_string(schema)
    kept = [c for c in tiles.columns if c not in added.names and c != "error"]
    failed = "error" in tiles.columns

    def one(row: pd.Series) -> dict:
        if failed and row["error"] is not None:
            return {"error": row["error"]}
        try:
            return make(row)
        except Exception as problem:  # a scene that can't be read is skipped with its reason
            return {"error": str(problem) or type(problem).__name__}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [one(row) for _, row in f.iterrows()]
            yield f[kept].assign(**{c: [m.get(c) for m in made] for c in [*added.names, "error"]})

    fields = [f for f in tiles.schema.fields if f.name in kept] + added.fields + [T.StructField("error", T.StringType())]
    return tiles.mapInPandas(run, T.StructType(fields))


def _cube(row: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(b, float).reshape(int(row["height"]), int(row["width"])) for b in row["bands"]], -1)


def _plane(row: pd.Series, column: str, kind: type) -> np.ndarray:
    return np.asarray(row[column], kind).reshape(int(row["height"]), int(row["width"]))


def _planes(cube: np.ndarray) -> list[np.ndarray]:
    return [cube[..., k].ravel() for k in range(cube.shape[-1])]


def cleaned_masks(tiles: DataFrame, least: int = 40) -> DataFrame:
    """tiles with `mask` without 4-connected parts of fewer than `least` pixels."""
    return _each(tiles, lambda row: {"mask": kernels.without_small(_plane(row, "mask", bool), least).ravel()}, "mask array<boolean>")


def qa_masks(tiles: DataFrame, collection: str = "C02", issue: bool = False) -> DataFrame:
    """tiles with `cloud` by the quality band."""
    return _each(tiles, lambda row: {"cloud": kernels.cloud_mask(_plane(row, "qa", int), row["satname"], collection, issue).ravel()}, "cloud array<boolean>")


def probability_masks(tiles: DataFrame, limit: float = 60) -> DataFrame:
    """tiles with `cloud` where the cloud probability is over `limit`, opened by a square of 6."""
    return _each(tiles, lambda row: {"cloud": kernels.opened(_plane(row, "cloud_prob", float) > limit, np.ones((6, 6), bool)).ravel()}, "cloud array<boolean>")


def preprocessed(tiles: DataFrame, collection: str = "C02", issue: bool = False, apply_cloud_mask: bool = True, pan_off: bool = False, probability: float = 60) -> DataFrame:
    """tiles (TILES) with sharpened `bands`, `cloud` (cloud or no data) and `nodata`.

    No data: NaN or minus infinity in any band, the zero edges of a Sentinel-2 SWIR band, or zero in G, NIR and SWIR. Sentinel-2 is
    scaled by 10,000; a Sentinel-2 scene of zeros alone is all cloud; of a merged one no-data grows by two pixels. Without
    apply_cloud_mask the cloud mask of Landsat is what has no value, that of Sentinel-2 all no-data. From 2022 on C01 counts as C02.
    """

    def prepare(row: pd.Series) -> dict:
        cube, sat = _cube(row), row["satname"]
        own = "C02" if collection == "C01" and row["acq_ts"] is not None and row["acq_ts"].year >= 2022 else collection
        cloud = kernels.cloud_mask(_plane(row, "qa", int), sat, own, issue)
        if sat == "S2":
            cube = cube / 10_000
            if np.nansum(cube[..., :4]) < 1:
                full = np.ones(cloud.size, bool)
                return {"bands": _planes(cube), "cloud": full, "nodata": ~full}
            if row["cloud_prob"] is not None:
                cloud = cloud | kernels.opened(_plane(row, "cloud_prob", float) > probability, np.ones((6, 6), bool))
        unknown = (np.isnan(cube) | np.isneginf(cube)).any(-1)
        if sat == "S2":
            unknown = unknown | ~kernels.without_padding(cube[..., 4])
        zero = (cube[..., [1, 3, 4]] == 0).all(-1)
        nodata = unknown | zero
        merged = sat == "S2" and "merged" in row["scene_id"]
        grown = kernels.dilated(nodata, np.ones((5, 5), bool)) if merged else nodata
        if apply_cloud_mask:
            cloud = cloud | nodata
        else:
            cloud = unknown | grown if sat == "S2" else unknown
        if not pan_off and sat in ("L7", "L8", "L9") and row["pan"] is not None:
            of = [1, 2, 3] if sat == "L7" else [0, 1, 2]
            try:
                flat = kernels.pansharpened(cube[..., of].reshape(-1, 3), _plane(row, "pan", float).ravel(), cloud.ravel())
                cube[..., of] = flat.reshape(*cloud.shape, 3)
            except (np.linalg.LinAlgError, ValueError):
                pass  # bands that can't be sharpened stay as they are
        return {"bands": _planes(cube), "cloud": cloud.ravel(), "nodata": grown.ravel()}

    return _each(tiles, prepare, "bands array<array<double>>, cloud array<boolean>, nodata array<boolean>")


def with_cover(tiles: DataFrame) -> DataFrame:
    """tiles with combined (share of cloud or no-data pixels) and cover (pixels of either mask alone, by pixels with data)."""
    cloud, nodata = F.col("cloud"), F.col("nodata")
    alone = F.size(F.filter(F.zip_with(cloud, nodata, lambda a, b: a != b), lambda x: x))
    valid = F.size(F.filter(nodata, lambda x: ~x))
    return tiles.withColumn("combined", F.try_divide(F.size(F.filter(cloud, lambda x: x)), F.size(cloud))).withColumn("cover", F.try_divide(alone, valid))


def with_reason(tiles: DataFrame, cloud_thresh: float, most: float = 0.99) -> DataFrame:
    """tiles (with_cover) with `reason`: why a scene is left out, NULL where it isn't. Filter by it, or write it as the run's report."""
    percent = lambda c: F.format_string("%.2f%%", c * 100)
    reason = F.when(F.col("error").isNotNull(), F.concat(F.lit("unreadable: "), "error"))
    reason = reason.when(F.col("combined") > most, F.concat(F.lit("cloud and no data: "), percent(F.col("combined"))))
    return tiles.withColumn("reason", reason.when(F.coalesce("cover", F.lit(1.0)) > cloud_thresh, F.concat(F.lit("cloud: "), percent(F.coalesce("cover", F.lit(1.0))))))


def featured(tiles: DataFrame) -> DataFrame:
    """tiles with `features`: the 20 features of every pixel, NaN as NULL; masked pixels (`cloud`) are unknown to their neighbours too."""

    def make(row: pd.Series) -> dict:
        x = kernels.features(np.where(_plane(row, "cloud", bool)[..., None], np.nan, _cube(row))).reshape(-1, 20)
        return {"features": [[None if np.isnan(v) else v for v in own] for own in x.tolist()]}

    return _each(tiles, make, "features array<array<double>>")


def classified(tiles: DataFrame, predict: Callable[[np.ndarray], np.ndarray], least: dict[int, int]) -> DataFrame:
    """tiles with the labels of every pixel from its 20 features; `least` gives the smallest part (8-connected) of classes that are
    cleaned. Masked pixels are 0. A scene whose kernel fails has its error instead of labels."""

    def make(row: pd.Series) -> dict:
        cloud = _plane(row, "cloud", bool)
        x = kernels.features(np.where(cloud[..., None], np.nan, _cube(row))).reshape(-1, 20)
        good = ~cloud.ravel() & ~np.isinf(x).any(1)
        labels = np.zeros(cloud.size, int)
        if good.any():
            labels[good] = predict(np.nan_to_num(x[good], nan=1e-9))
        labels = labels.reshape(cloud.shape)
        for k, n in least.items():
            labels[(labels == k) & ~kernels.without_small(labels == k, n, True)] = 0
        return {"labels": labels.ravel()}

    return _each(tiles, make, "labels array<int>")


def sharpened(tiles: DataFrame) -> DataFrame:
    """tiles with three bands sharpened by `pan` where `cloud` is false."""

    def make(row: pd.Series) -> dict:
        x = kernels.pansharpened(np.stack([np.asarray(v, float) for v in row["bands"]], -1), np.asarray(row["pan"], float), np.asarray(row["cloud"], bool))
        return {"bands": [x[:, k] for k in range(3)]}

    return _each(tiles, make, "bands array<array<double>>")


def labelled_by_polygons(tiles: DataFrame, rings: DataFrame) -> DataFrame:
    """scene_id, class, features of the pixels inside drawn rings (scene_id, class, ring: array of (column, row)): training rows."""
    joined = tiles.join(rings, "scene_id")

    def make(row: pd.Series) -> dict:
        inside = kernels.in_polygon(int(row["height"]), int(row["width"]), np.array([[p["x"], p["y"]] for p in row["ring"]], float))
        x = kernels.features(_cube(row)).reshape(-1, 20)[inside.ravel()]
        return {"features": [[None if np.isnan(v) else v for v in own] for own in x.tolist()]}

    made = _each(joined, make, "features array<array<double>>")
    return made.where("error IS NULL").select("scene_id", "class", F.explode("features").alias("features"))


def flooded(tiles: DataFrame) -> DataFrame:
    """tiles (seed_r, seed_c, tolerance; `values` and `others`, two arrays) with `mask`: connected pixels like the seed in both."""

    def make(row: pd.Series) -> dict:
        seed = int(row["seed_r"]), int(row["seed_c"])
        near = [kernels.flooded(_plane(row, c, float), seed, float(row["tolerance"])) for c in ("values", "others")]
        return {"mask": (near[0] & near[1]).ravel()}

    return _each(tiles, make, "mask array<boolean>")


def pixels_of(tiles: DataFrame, planes: dict[str, Column], *keep: str) -> DataFrame:
    """keep, r, c and a column for each of `planes` (arrays of the scene's pixels)."""
    zipped = F.arrays_zip(*(v.alias(k) for k, v in planes.items()))
    out = tiles.select(*keep, "width", F.posexplode(zipped).alias("_at", "_p"))
    return out.select(*keep, F.floor(F.col("_at") / F.col("width")).cast("int").alias("r"), (F.col("_at") % F.col("width")).cast("int").alias("c"), *(F.col(f"_p.{k}").alias(k) for k in planes))


def masked(tiles: DataFrame, mask: str, nodata: float = 0.0) -> DataFrame:
    """tiles with every band set to `nodata` where `mask` is true; scenes are written anew, never changed in place."""
    return tiles.withColumn("bands", F.transform("bands", lambda b: F.zip_with(b, F.col(mask), lambda v, m: F.when(m, F.lit(nodata)).otherwise(v))))


def corners(tiles: DataFrame) -> DataFrame:
    """scene_id and the world coordinates of a scene's extent: x_min, x_max, y_min, y_max by its georeference."""
    g = [F.col("georef")[k] for k in range(6)]
    at = [(r, c) for r in (F.lit(0), F.col("height")) for c in (F.lit(0), F.col("width"))]
    x, y = [g[0] + c * g[1] + r * g[2] for r, c in at], [g[3] + c * g[4] + r * g[5] for r, c in at]
    return tiles.select("scene_id", F.least(*x).alias("x_min"), F.greatest(*x).alias("x_max"), F.least(*y).alias("y_min"), F.greatest(*y).alias("y_max"))
