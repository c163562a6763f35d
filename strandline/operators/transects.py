"""Shorelines against transects."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points farther from a transect's origin than this are never on it (metres).
REACH = 1000.0
#: Transects that are sent to every executor at most; more meet the points by a shuffle.
BROADCAST_TRANSECTS = 50_000


def create_transect(x: Column, y: Column, orientation: Column, length: int) -> Column:
    """Points every metre from the origin; orientation in degrees clockwise from North."""
    phi = F.radians(90 - orientation)
    return F.transform(F.sequence(F.lit(0), F.lit(length)), lambda k: F.struct((x + k * F.cos(phi)).alias("x"), (y + k * F.sin(phi)).alias("y")))


def directed(transects: DataFrame, keep: list[str] = ()) -> DataFrame:
    """keep, name, x0, y0 and the unit vector (ux, uy) of transects (name, x0, y0, x1, y1)."""
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return transects.select(*keep, "name", "x0", "y0", F.try_divide(F.col("x1") - F.col("x0"), length).alias("ux"), F.try_divide(F.col("y1") - F.col("y0"), length).alias("uy"))


def near_transects(points: DataFrame, transects: DataFrame, along: float, keep: list[str], site: list[str] = (), facing: bool = False) -> DataFrame:
    """site, keep, name, chainage for points (x, y) within `along` of a transect's line and REACH of its origin, of the same site.

    Points and transects meet by site and grid cells as large as REACH, so that a point is only compared with transects near it.
    `facing` keeps those whose direction from the origin differs from the transect's by less than 90 degrees, angles from -180 to 180
    not being wrapped: a transect that points west loses those on the other side of west."""
    cell = lambda c: F.floor(F.col(c) / REACH)
    around = F.explode(F.expr("sequence(-1, 1)"))
    lines = directed(transects, site).withColumn("_i", around).withColumn("_j", around).withColumn("_i", cell("x0") + F.col("_i")).withColumn("_j", cell("y0") + F.col("_j"))
    if transects.limit(BROADCAST_TRANSECTS + 1).count() <= BROADCAST_TRANSECTS:
        lines = F.broadcast(lines)
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    joined = points.withColumn("_i", cell("x")).withColumn("_j", cell("y")).join(lines, [*site, "_i", "_j"])
    near = joined.where((F.abs(dx * F.col("uy") - dy * F.col("ux")) <= along) & (F.hypot(dx, dy) <= REACH))
    if facing:
        near = near.where(F.abs(F.atan2("uy", "ux") - F.atan2(dy, dx)) < math.pi / 2)
    return near.select(*site, *keep, "name", (dx * F.col("ux") + dy * F.col("uy")).alias("chainage"))


def intersections(points: DataFrame, transects: DataFrame, along: float, scene: str, site: list[str] = ()) -> DataFrame:
    """site, scene, name, chainage: the median along each transect of the points that it faces."""
    return near_transects(points, transects, along, [scene], site, facing=True).groupBy(*site, scene, "name").agg(F.median("chainage").alias("chainage"))


def quality_checked(points: DataFrame, transects: DataFrame, scenes: DataFrame, scene: str, along: float = 25, min_points: int = 3, max_std: float = 15, max_range: float = 30, min_chainage: float = -100, mode: str = "auto", share: float = 0.1, site: list[str] = ()) -> DataFrame:
    """site, scene, name, chainage, n for every scene and transect of a site; without `site` all are of one.

    A good crossing has its median. Of others, mode `nan` has NULL, `max` the largest chainage if there are enough points; `auto` takes
    `max` for transects on which more than `share` of the site's scenes spread more than max_std. NULL chainages count as points.
    """
    if mode not in ("auto", "nan", "max"):
        raise ValueError(f"unknown mode {mode}")
    near = near_transects(points, transects, along, [scene], site).withColumn("c", F.when(F.col("chainage") >= min_chainage, F.col("chainage")))
    stats = near.groupBy(*site, scene, "name").agg(
        F.stddev_pop("c").alias("std"), F.median("c").alias("median"), F.max("c").alias("most"), F.min("c").alias("least"), F.when(F.count("c") > 0, F.count(F.lit(1))).otherwise(0).alias("n")
    )
    every, names = scenes.select(*site, scene).distinct(), transects.select(*site, "name").distinct()
    # a row for each scene and transect is what is asked for
    frame = every.join(names, list(site)) if site else every.crossJoin(names)
    own = frame.join(stats, [*site, scene, "name"], "left")
    wide = F.avg(F.coalesce(F.col("std") > max_std, F.lit(False)).cast("int")).over(Window.partitionBy(*site, "name"))
    good = (F.col("std") <= max_std) & (F.col("most") - F.col("least") <= max_range) & (F.col("n") >= min_points)
    largest = F.when(F.col("n") >= min_points, F.col("most"))
    other = {"nan": F.lit(None).cast("double"), "max": largest, "auto": F.when(wide > share, largest)}[mode]
    return own.select(*site, scene, "name", F.when(F.coalesce(good, F.lit(False)), F.col("median")).otherwise(other).alias("chainage"), F.coalesce("n", F.lit(0)).alias("n"))


def wide_series(df: DataFrame, ts: str, names: list[str]) -> DataFrame:
    """One row a time and one column a transect; names are given, so no job looks for them."""
    return df.groupBy(ts).pivot("name", names).agg(F.first("chainage", ignorenulls=True))
