"""From scenes to shorelines: preprocessing and classes once a scene, then thresholds, level lines and filters as one lazy plan.

`classified_scenes` runs the numpy kernels; write its result as a table, then `shorelines` reads it several times without running them
again. Scenes that are left out have their reason in the first table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import scalar
from strandline.functions.projections import known_system, reprojected
from strandline.operators import contours, distances, pixels, scenes
from strandline.tables import Rounds

#: Labels of classes; fewer sand pixels than LEAST_SAND near the reference take the threshold of all pixels.
SAND, WHITEWATER, WATER, LEAST_SAND = 1, 2, 3, 50
#: Metres from pixels without data, and the least length of Landsat 7 shorelines.
NODATA_DISTANCE, LENGTH_L7 = 30.0, 200.0


@dataclass(frozen=True)
class Detection:
    collection: str = "C02"
    cloud_mask_issue: bool = False
    apply_cloud_mask: bool = True
    pan_off: bool = False
    s2cloudless_prob: float = 60
    cloud_thresh: float = 0.1
    dist_clouds: float = 300
    min_beach_area: float = 1000
    min_length_sl: float = 500
    max_dist_ref: float = 100
    pixel: float = 15
    #: The system of shorelines, references, areas and transects; None: each scene's own.
    output_epsg: int | None = None


def classified_scenes(tiles: DataFrame, predict: Callable[[np.ndarray], np.ndarray], settings: Detection = Detection()) -> DataFrame:
    """tiles (scenes.TILES) with bands, cloud, nodata, combined, cover, labels, error and reason."""
    ready = scenes.preprocessed(tiles, settings.collection, settings.cloud_mask_issue, settings.apply_cloud_mask, settings.pan_off, settings.s2cloudless_prob)
    least = scalar.pixels_of_area(settings.min_beach_area, settings.pixel)
    made = scenes.classified(ready, predict, {SAND: least, WATER: least})
    out = scenes.with_reason(scenes.with_cover(made), settings.cloud_thresh)
    if settings.output_epsg is None:
        return out
    unknown = F.concat(F.lit("unknown reference system: "), F.coalesce(F.col("epsg").cast("string"), F.lit("none")))
    return out.withColumn("reason", F.coalesce("reason", F.when(~known_system(F.col("epsg")), unknown)))


def class_shares(classified: DataFrame) -> DataFrame:
    """scene_id and the shares of sand, whitewater and water pixels."""
    of = lambda k: F.try_divide(F.size(F.filter("labels", lambda x: x == k)), F.size("labels"))
    return classified.select("scene_id", of(SAND).alias("sand"), of(WHITEWATER).alias("whitewater"), of(WATER).alias("water"))


def _index(a: int, b: int) -> Column:
    """Normalised difference of two bands of each pixel; NULL where cloudy."""
    value = lambda x: F.try_divide(x["a"] - x["b"], x["a"] + x["b"])
    return F.transform(F.arrays_zip(F.col("bands")[a].alias("a"), F.col("bands")[b].alias("b"), F.col("cloud").alias("c")), lambda x: F.when(~x["c"], value(x)))


def thresholds(p: DataFrame) -> DataFrame:
    """scene_id, threshold from pixels (scene_id, r, c, mndwi, ndwi, cloud, label, near).

    With LEAST_SAND sand pixels near the reference: by as many sand as water pixels there, of the index of NIR and green, which then is
    applied to the one of SWIR and green. Else by all clear pixels there of the latter."""
    own = p.where("near")
    sand = own.groupBy("scene_id").agg(F.count_if(F.col("label") == SAND).alias("_sand"))
    own = own.join(sand, "scene_id")
    classes = own.where(F.col("_sand") >= LEAST_SAND).where(F.col("label").isin(SAND, WATER)).withColumn("r", F.col("r").cast("long")).withColumn("c", F.col("c").cast("long"))
    both = pixels.balanced(classes, ["scene_id"], "label", ["r", "c"]).select("scene_id", F.col("ndwi").alias("v"))
    every = own.where((F.col("_sand") < LEAST_SAND) & ~F.col("cloud")).select("scene_id", F.col("mndwi").alias("v"))
    return pixels.otsu(both.unionByName(every), ["scene_id"], "v").select("scene_id", "threshold")


def shorelines(classified: DataFrame, settings: Detection = Detection(), reference: DataFrame | None = None, area: list[list[tuple[float, float]]] = ()) -> DataFrame:
    """scene_id, site, satname, acq_ts, cover, threshold, pts of scenes without a reason against them.

    pts, reference (site, x, y) and area are in settings.output_epsg, whatever the scenes' own systems are, so shorelines of several zones
    are one table that meets one table of transects; without it all are in the scenes' own coordinates. Without a reference the whole scene is
    searched. A scene without a threshold goes; one whose points are all filtered out has an empty shoreline. A scene whose system isn't
    known raises here; classified_scenes gives it a reason. Distances to cloud are measured on the scene's grid."""
    rounds, good = Rounds(classified.sparkSession), classified.where("reason IS NULL")
    p = scenes.pixels_of(good, {"mndwi": _index(4, 1), "ndwi": _index(3, 1), "cloud": F.col("cloud"), "nodata": F.col("nodata"), "label": F.col("labels")}, "scene_id")
    geo = good.select("scene_id", "site", "satname", "georef", "epsg")
    if settings.output_epsg is not None:
        unknown = F.raise_error(F.concat(F.lit("unknown reference system of "), F.col("scene_id"))).cast("int")
        geo = geo.withColumn("epsg", F.when(known_system(F.col("epsg")), F.col("epsg")).otherwise(unknown))
    if reference is None:
        p = p.withColumn("near", F.lit(True))
    else:
        points = geo.join(reference.select("site", "x", "y"), "site")
        if settings.output_epsg is not None:
            points = reprojected(points, "x", "y", settings.output_epsg, F.col("epsg"))
        col, row = scalar.world_to_pix(F.col("x"), F.col("y"), tuple(F.col("georef")[k] for k in range(6)))
        points = rounds.table(points.select("scene_id", row.alias("row"), col.alias("col")), "reference")
        p = pixels.reference_buffer(p, ["scene_id"], points, scalar.pixels_of_distance(settings.max_dist_ref, settings.pixel))
    level = thresholds(p)
    traced = p.where("near").join(level, "scene_id")  # pixels that aren't there have no squares
    lines = contours.contour_lines(contours.contour_segments(traced, ["scene_id"], "mndwi", F.col("threshold")), ["scene_id"])
    placed = contours.in_world(lines, geo.select("scene_id", "georef"), ["scene_id"]).join(geo.select("scene_id", "satname", "epsg"), "scene_id")
    if settings.output_epsg is not None:
        placed = reprojected(placed, "x", "y", F.col("epsg"), settings.output_epsg)
    found = contours.long_lines(placed, ["scene_id"], F.when(F.col("satname") == "L7", LENGTH_L7).otherwise(settings.min_length_sl))
    found = rounds.table(found, "lines")
    masks = p.select("scene_id", "r", "c", (F.col("cloud") != F.col("nodata")).alias("alone"), "nodata")
    found = distances.to_masked(found, masks, ["scene_id"], {"_cloud": "alone", "_nodata": "nodata"})
    beyond = lambda c, d: F.coalesce(F.col(c) * F.col("_size") >= d, F.lit(True))
    size = geo.select("scene_id", F.hypot(F.col("georef")[1], F.col("georef")[4]).alias("_size"))  # pixels of these missions are square
    found = found.join(size, "scene_id").where(beyond("_cloud", settings.dist_clouds) & beyond("_nodata", NODATA_DISTANCE))
    found = pixels.within_area(found, ["scene_id"], list(area))
    whole = found.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("line", "pt_idx", "x", "y"))).alias("_p"))
    whole = whole.select("scene_id", F.transform("_p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("pts"))
    none = F.lit([]).cast("array<struct<x:double,y:double>>")
    out = good.select("scene_id", "site", "satname", "acq_ts", "cover").join(level, "scene_id").join(whole, "scene_id", "left")
    return out.withColumn("pts", F.coalesce("pts", none))
