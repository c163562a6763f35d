"""Scene catalogues: snapshots in files, paged services and the ingest of scenes."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.scalar import epsg_of_crs, split_date_range
from strandline.operators import catalog
from strandline.operators.scenes import TILES, _each

#: A catalogue entry as services give it; satname is the mission that was asked for.
ENTRIES = "satname string, tier string, id string, properties map<string,string>, bands array<struct<id: string, crs: string>>"
#: Entries that a service gives in one answer at most.
PAGE = 4999


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue entries of JSON lines."""
    return spark.read.schema(ENTRIES).json(path)


def scenes_of(found: DataFrame) -> DataFrame:
    """scene_id, satname, tier, acq_ts, epsg, cloud_pct, tile, system_index, im_quality, geo_rmse, geo_flag of catalogue entries."""
    p = F.col("properties")
    quality, accuracy = catalog.quality_and_accuracy(p, F.col("satname"))
    return found.select(
        F.col("id").alias("scene_id"), "satname", "tier", F.timestamp_millis(p["system:time_start"].try_cast("long")).alias("acq_ts"), epsg_of_crs(F.col("bands")[0]["crs"]).alias("epsg"),
        F.coalesce(p["CLOUD_COVER"], p["CLOUDY_PIXEL_PERCENTAGE"]).try_cast("double").alias("cloud_pct"), p["MGRS_TILE"].alias("tile"), p["system:index"].alias("system_index"),
        quality.alias("im_quality"), accuracy.try_cast("double").alias("geo_rmse"), F.when(accuracy.isin("PASSED", "FAILED"), accuracy).alias("geo_flag"),
    )


def bands_of(found: DataFrame, names: list[str]) -> DataFrame:
    """Entries with the bands of these names alone; masks of scene classes go in any case."""
    keep = lambda b: b["id"].isin(*names) & ~b["id"].startswith("MSK_CLASSI")
    return found.withColumn("bands", F.filter("bands", keep))


def searched(scenes: DataFrame, missions: list[str], start: str, end: str, tier: str, cloud: float = 0.95, months: list[int] = (), tile: str | None = None) -> DataFrame:
    """Scenes of one tier; the second tier has neither L9 nor S2."""
    own = catalog.in_dates(scenes.where(F.col("satname").isin(*missions) & (F.col("tier") == tier)), "acq_ts", start, end)
    if tier == "T2":
        own = own.where(~F.col("satname").isin("L9", "S2"))
    return catalog.of_tile(catalog.in_months(catalog.not_cloudy(own, "cloud_pct", cloud), "acq_ts", list(months)), "tile", tile)


def retried(call: Callable, attempts: int = 3, wait: float = 1.0):
    """What `call` gives, tried so many times, so many seconds apart."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(wait)


def date_pages(start: datetime, end: datetime, count: Callable[[datetime, datetime], int], limit: int = PAGE) -> list[tuple[datetime, datetime]]:
    """The range in as few equal parts as give no more than `limit` entries each."""
    parts = 1
    while True:
        ranges = split_date_range(start, end, parts)
        if all(count(a, b) <= limit for a, b in ranges):
            return ranges
        parts += 1


def paged(spark: SparkSession, start: datetime, end: datetime, count: Callable[[datetime, datetime], int], fetch: Callable[[datetime, datetime], list[dict]], limit: int = PAGE) -> DataFrame:
    """Entries of a service, a task for each page; ranges share their ends, so entries are told apart by id."""
    ranges = date_pages(start, end, count, limit)
    pages = spark.createDataFrame(ranges, "start timestamp, end timestamp").repartition(len(ranges))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in ("satname", "tier", "id", "properties", "bands")]
        for f in frames:
            for a, b in zip(f["start"], f["end"], strict=True):
                yield pd.DataFrame([[e.get(n) for n in names] for e in retried(lambda a=a, b=b: fetch(a.to_pydatetime(), b.to_pydatetime()))], columns=names)

    return pages.mapInPandas(run, ENTRIES).dropDuplicates(["satname", "id"])


def ingested(scenes: DataFrame, fetch: Callable[[pd.Series], dict], attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """scenes with height, width, bands, pan, qa, cloud_prob and georef as `fetch` gives them, or with the `error` that it ended in."""
    pixels = "height int, width int, bands array<array<double>>, pan array<double>, qa array<int>, cloud_prob array<double>, georef array<double>"
    return _each(scenes, lambda row: retried(lambda: fetch(row), attempts, wait), pixels)


def tiles(spark: SparkSession, path: str) -> DataFrame:
    """Ingested scenes from Parquet; written with partitions by satname, other missions aren't read."""
    return spark.read.schema(TILES).parquet(path)
