"""The analysis chain in one lazy plan: duplicates, accuracy, transects, tides, outliers, seasons, trend."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import tidal_correction
from strandline.operators import catalog, series, transects


@dataclass(frozen=True)
class Settings:
    accuracy: float = 10
    along: float = 25
    min_points: int = 3
    max_std: float = 15
    max_range: float = 30
    min_chainage: float = -100
    mode: str = "auto"
    share: float = 0.1
    reference: float = 0.7
    slope: float = 0.1
    max_change: float = 40


def corrected_series(shorelines: DataFrame, lines: DataFrame, tides: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """site, name, scene_id, acq_ts, chainage (corrected by the nearest tide) from shorelines (site, scene_id, satname, acq_ts,
    geo_flag, geo_rmse, pts), lines (site, name, x0, y0, x1, y1) and tides (site, ts, tide)."""
    step = lambda k: F.hypot(F.col("pts")[k + 1]["x"] - F.col("pts")[k]["x"], F.col("pts")[k + 1]["y"] - F.col("pts")[k]["y"])
    length = F.when(F.size("pts") > 1, F.aggregate(F.sequence(F.lit(0), F.size("pts") - 2), F.lit(0.0), lambda a, k: a + step(k))).otherwise(0.0)
    s = shorelines.withColumn("n_points", F.size("pts")).withColumn("_length", length).withColumn("sat_ord", F.array_position(F.array(*(F.lit(x) for x in ("L5", "L7", "L8", "L9", "S2"))), F.col("satname")))
    s = series.without_duplicates(s, ["site"], "acq_ts", "_length", "n_points", "satname", ["sat_ord", "scene_id"])
    s = catalog.accurately_placed(s, settings.accuracy)
    points = s.select("site", "scene_id", F.inline("pts"))
    crossed = transects.quality_checked(points, lines, s, "scene_id", settings.along, settings.min_points, settings.max_std, settings.max_range, settings.min_chainage, settings.mode, settings.share, ["site"])
    dated = crossed.join(s.select("site", "scene_id", "acq_ts"), ["site", "scene_id"])
    level = series.as_of_nearest(dated, tides, ["site"], "acq_ts", "ts", "tide", "tide")
    return level.select("site", "name", "scene_id", "acq_ts", tidal_correction(F.col("chainage"), F.col("tide"), settings.reference, settings.slope).alias("chainage"))


def seasonal_trends(corrected: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Trends of seasonal means of despiked series."""
    clean = series.reject_outliers(corrected, ["site", "name"], "acq_ts", "chainage", settings.max_change, ["scene_id"])
    by = ["site", "name"]
    return series.trend(series.seasonal_average(clean.where("chainage is not null"), by, "acq_ts", "chainage"), by, "season", "mean")
