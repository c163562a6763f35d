"""Scenes as a stream: repeated acquisitions, tidal correction against a table, activity by window and session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_repeats(stream: DataFrame, keys: list[str], ts: str, minutes: int = 5) -> DataFrame:
    """The first row of each key within the watermark: an approximation of the batch rule for near-simultaneous scenes."""
    return stream.withWatermark(ts, f"{minutes} minutes").dropDuplicatesWithinWatermark(keys)


def corrected(stream: DataFrame, tides: DataFrame, ts: str, value: str, reference: float, slope: float, minutes: int = 60) -> DataFrame:
    """Rows with the mean tide of their interval (a stream-static equi-join) and the corrected value."""
    slot = lambda c: F.date_trunc("hour", c) if minutes == 60 else F.timestamp_seconds(F.floor(F.unix_timestamp(c) / (60 * minutes)) * 60 * minutes)
    table = tides.groupBy(slot(F.col("ts")).alias("_slot")).agg(F.avg("tide").alias("tide"))
    return stream.withColumn("_slot", slot(F.col(ts))).join(table, "_slot", "left").withColumn("corrected", F.col(value) + (F.col("tide") - reference) / slope).drop("_slot")


def activity(stream: DataFrame, ts: str, by: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count(F.lit(1)).alias("n"))
