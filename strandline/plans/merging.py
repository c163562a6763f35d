"""Scenes of one place and time made into one: plan of runs, footprints within others left out, pixels of a run as a mosaic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import catalog, pixels


def merged_scenes(scenes: DataFrame, raster: DataFrame, site: list[str], ts: str, key: str, value: str, nodata: float = 0.0, seconds: int = 300) -> tuple[DataFrame, DataFrame]:
    """Scenes (site, ts, key, x_min, x_max, y_min, y_max) that stay, with the rectangle of their run, and their pixels (key, r, c, value).

    Of scenes of one time, those that another's footprint holds go. What then follows within `seconds` is merged into the first of its
    run, up to three in all; later ones go. r and c number one grid of the site; the last scene with a value at a pixel gives it."""
    alone = catalog.without_contained(scenes, [*site, ts], [key])
    planned = catalog.merge_plan(alone, site, ts, [key], key, seconds).where("action <> 'drop'")
    extent = planned.groupBy("first").agg(*(f(c).alias(c) for c, f in (("x_min", F.min), ("x_max", F.max), ("y_min", F.min), ("y_max", F.max))))
    kept = planned.where(F.col("place") == 1).drop("x_min", "x_max", "y_min", "y_max", "place", "action").join(extent, "first").drop("first")
    own = raster.join(planned.select(key, F.col("first").alias("_first"), F.col("place").alias("_place")), key)
    return kept, pixels.mosaic(own, value, nodata, "_place", ["_first"]).withColumnRenamed("_first", key)
