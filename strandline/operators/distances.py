"""Exact distances to the masked pixels of rasters by the separable transform: first along columns (or rows), then across them.

Where points were compared with every masked pixel around them, work here follows the pixels and points, however far a distance reaches:
a window gives each pixel the nearest masked pixel above and below it, and across a line of pixels the squared distances are the lower
envelope of one parabola a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.kernels import envelopes, lowest


def _profiles(rasters: DataFrame, by: list[str], masks: dict[str, str], line: str, across: str) -> DataFrame:
    """by, line and a profile: for each pixel of a line its place on it and, by mask, the nearest masked lines before or at and behind."""
    column = Window.partitionBy(*by, across)
    onward, back = column.orderBy(F.col(line)).rowsBetween(Window.unboundedPreceding, 0), column.orderBy(F.col(line).desc()).rowsBetween(Window.unboundedPreceding, -1)
    hits = {name: F.when(F.coalesce(F.col(mask), F.lit(False)), F.col(line)) for name, mask in masks.items()}
    near = [c for name, hit in hits.items() for c in (F.last(hit, True).over(onward).alias(f"{name}_before"), F.last(hit, True).over(back).alias(f"{name}_behind"))]
    own = rasters.select(*by, F.col(line).alias("_line"), F.col(across).alias("at"), *near)
    return own.groupBy(*by, "_line").agg(F.sort_array(F.collect_list(F.struct("at", *(f"{n}_{c}" for n in masks for c in ("before", "behind"))))).alias("_profile"))


def to_masked(points: DataFrame, rasters: DataFrame, by: list[str], masks: dict[str, str]) -> DataFrame:
    """points (by, row, col, ...) with a column for each of `masks` (name: boolean column): the distance, in pixels, to the nearest such
    pixel of rasters (by, r, c, every pixel of them); NULL where a raster has none, and for points without coordinates or raster.

    Points of level lines lie on a row or a column of pixels: those on a row are met with the row's profile, those on a column with the
    column's, so that a line of pixels has one envelope for all of its points. Other points have one each. Every point is compared with
    whole rows and columns, so nothing depends on how far a distance reaches. points are read twice."""
    on_column = F.coalesce((F.col("row") != F.floor("row")) & (F.col("col") == F.floor("col")), F.lit(False))
    placed = points.select(*by, on_column.alias("_axis"), F.when(on_column, F.col("col")).otherwise(F.col("row")).cast("double").alias("_place"), F.when(on_column, F.col("row")).otherwise(F.col("col")).cast("double").alias("_along"), F.struct(*points.columns).alias("_point"))
    placed = placed.withColumn("_line", F.floor("_place").cast("int"))
    asked = placed.groupBy(*by, "_axis", "_line", "_place").agg(F.sort_array(F.collect_list(F.struct("_along", "_point"))).alias("_asked"))
    lines = placed.select(*by, "_axis", "_line").distinct()
    every = [_profiles(rasters, by, masks, *axes).withColumn("_axis", F.lit(columns)) for axes, columns in ((("r", "c"), False), (("c", "r"), True))]
    profiles = every[0].unionByName(every[1]).join(lines, [*by, "_axis", "_line"], "left_semi")
    met = asked.join(profiles, [*by, "_axis", "_line"], "left").select("_place", "_asked", "_profile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, profile = batch["_asked"], batch["_profile"]
            counts = np.diff(np.asarray(asked.offsets))
            sizes = np.nan_to_num(pc.list_value_length(profile).to_numpy(zero_copy_only=False), nan=0).astype(int)
            owner, inside = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.max(initial=0)) < sizes[:, None]
            field = lambda c: profile.flatten().field(c).to_numpy(zero_copy_only=False).astype(float)
            x, which = asked.flatten().field("_along").to_numpy(zero_copy_only=False).astype(float), np.repeat(np.arange(len(counts)), counts)
            at, place, found = np.zeros(inside.shape), batch["_place"].to_numpy(zero_copy_only=False).astype(float)[owner], []
            at[inside] = field("at")
            for name in masks:
                cost = np.full(inside.shape, np.inf)
                cost[inside] = np.nan_to_num(np.fmin((place - field(f"{name}_before")) ** 2, (field(f"{name}_behind") - place) ** 2), nan=np.inf)
                far = np.sqrt(lowest(envelopes(at, cost), at, cost, which, x))
                found.append(pa.array(far, mask=~np.isfinite(far)))
            made = pa.StructArray.from_arrays([asked.flatten().field("_point"), *found], ["_point", *masks])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), made)], ["_made"])

    kind = T.StructType([T.StructField("_point", asked.schema["_asked"].dataType.elementType["_point"].dataType), *(T.StructField(name, T.DoubleType()) for name in masks)])
    made = met.mapInArrow(run, T.StructType([T.StructField("_made", T.ArrayType(kind))])).select(F.explode("_made").alias("_m"))
    return made.select("_m._point.*", *(F.col(f"_m.{name}").alias(name) for name in masks))


def transformed(rasters: DataFrame, by: list[str], mask: str, name: str = "distance") -> DataFrame:
    """rasters (by, r, c, ...) with each pixel's distance to the nearest pixel where `mask` is true: the distance transform."""
    own = rasters.select(*by, F.struct(*rasters.columns).alias("_pixel"), F.col("r").cast("double").alias("row"), F.col("c").cast("double").alias("col"))
    return to_masked(own, rasters, by, {name: mask}).select("_pixel.*", name)
