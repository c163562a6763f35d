"""Catalogue algebra: filters, anti-joins, unions, suffixes and orderings of scenes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_dates(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    return df.where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))


def overlapping(df: DataFrame, box: tuple[float, float, float, float], names: tuple[str, str, str, str] = ("x_min", "y_min", "x_max", "y_max")) -> DataFrame:
    """Rows whose envelope meets the box; a plain range predicate, which Parquet statistics prune by."""
    x0, y0, x1, y1 = (F.col(c) for c in names)
    return df.where((x0 <= box[2]) & (x1 >= box[0]) & (y0 <= box[3]) & (y1 >= box[1]))


def not_cloudy(df: DataFrame, percent: str, threshold: float = 0.95) -> DataFrame:
    return df.where(F.col(percent) <= threshold * 100)


def of_tile(df: DataFrame, tile: str, name: str | None) -> DataFrame:
    """Scenes of one tile; without a name all."""
    return df if name is None else df.where(F.col(tile) == name)


def in_months(df: DataFrame, ts: str, months: list[int]) -> DataFrame:
    return df.where(F.month(ts).isin(*months)) if months else df


def within_dates(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows from the midnight of `start` to that of `end`, both included."""
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def quality_and_accuracy(properties: Column, satname: Column) -> tuple[Column, Column]:
    """Image quality and geometric accuracy of a scene's properties (a map) by the names that missions and eras use; without one
    Landsat has quality NA and 12 metres, Sentinel-2 PASSED for both."""
    s2, old = satname == "S2", satname.isin("L5", "L7")
    quality = F.when(s2, first_property(properties, ["RADIOMETRIC_QUALITY", "RADIOMETRIC_QUALITY_FLAG"], F.lit("PASSED"))).when(old, first_property(properties, ["IMAGE_QUALITY"], F.lit("NA")))
    flags = ["GEOMETRIC_QUALITY_FLAG", "GEOMETRIC_QUALITY", "quality_check", "GENERAL_QUALITY_FLAG"]
    accuracy = F.when(s2, first_property(properties, flags, F.lit("PASSED"))).otherwise(first_property(properties, ["GEOMETRIC_RMSE_MODEL"], F.lit("12")))
    return quality.otherwise(first_property(properties, ["IMAGE_QUALITY_OLI"], F.lit("NA"))), accuracy


def accurately_placed(df: DataFrame, accuracy: float, flag: str = "geo_flag", rmse: str = "geo_rmse", failed_is_minus_one: bool = True) -> DataFrame:
    """PASSED is kept, FAILED goes, a number is kept up to `accuracy`; -1 stands for failed unless told otherwise."""
    number = F.col(rmse) <= accuracy
    if failed_is_minus_one:
        number = number & (F.col(rmse) != -1)
    return df.where(F.coalesce(F.when(F.col(flag) == "PASSED", True).when(F.col(flag) == "FAILED", False), number))


def first_property(properties: Column, names: list[str], default: Column) -> Column:
    """The first property that is there, by order of names."""
    return F.coalesce(*(properties[n] for n in names), default)


def not_downloaded(catalogue: DataFrame, present: DataFrame, keys: list[str], ts: str | None = None) -> DataFrame:
    """Rows without a match by keys and, if given, by the second of `ts`."""
    if ts is None:
        return catalogue.join(present.select(*keys), keys, "left_anti")
    second = F.date_trunc("second", F.col(ts)).alias("_second")
    right = present.select(*keys, second)
    return catalogue.withColumn("_second", second).join(right, [*keys, "_second"], "left_anti").drop("_second")


def first_match(left: DataFrame, right: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Left rows with the first right row of their key; the right side is reduced to one row a key before it moves."""
    first = right.groupBy(key).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_first"))
    return left.join(first, key, "left").select(*left.columns, *(F.col(f"_first.{v}").alias(v) for v in values))


def merged_missions(tables: dict[str, DataFrame]) -> DataFrame:
    """One table with satname and its position among missions."""
    out = None
    for k, (name, df) in enumerate(tables.items()):
        own = df.withColumn("satname", F.lit(name)).withColumn("sat_ord", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out


def merged_tiers(first: DataFrame, second: DataFrame, include_second: bool, without: tuple[str, ...] = ("S2", "L9")) -> DataFrame:
    return first.unionByName(second.where(~F.col("satname").isin(*without))) if include_second else first


def chronological(df: DataFrame, site: list[str], ts: str, ties: list[str], name: str = "idx") -> DataFrame:
    """Numbers scenes of a site by time; ties keep the order of missions."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*site).orderBy(ts, *ties)) - 1)


def with_suffixes(df: DataFrame, base: list[str], order: list[str], name: Column, out: str = "name") -> DataFrame:
    """The first of equal names stays, later ones get _dup1, _dup2, ..."""
    n = F.row_number().over(Window.partitionBy(*base).orderBy(*order)) - 1
    return df.withColumn(out, F.when(n == 0, name).otherwise(F.concat(name, F.lit("_dup"), n.cast("string"))))


def availability(df: DataFrame) -> DataFrame:
    return df.groupBy("satname", "tier").agg(F.count(F.lit(1)).alias("n_images"))


def first_cloud_free(df: DataFrame, site: list[str], satname: str, cloud: str, limit: float, order: list[str], preference: tuple[str, ...] = ("S2", "L8", "L9", "L5")) -> DataFrame:
    """One scene a site: the first below the limit of the most preferred mission; others are never taken."""
    rank = F.array_position(F.array(*(F.lit(p) for p in preference)), F.col(satname))
    good = df.where((F.col(cloud) <= limit) & (rank > 0)).withColumn("_rank", rank)
    return good.groupBy(*site).agg(F.min_by(F.struct(*df.columns), F.struct("_rank", *order)).alias("_row")).select("_row.*")


def dominant(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """by, name, n_values: the most frequent value (ties: the smallest) and how many there are."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), value)).alias(name), F.count(F.lit(1)).alias("n_values"))


def first_per_group(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def repeated(df: DataFrame, value: str, key: str) -> DataFrame:
    """value, keys of rows that share a value with others, in ascending order."""
    return df.groupBy(value).agg(F.array_sort(F.collect_list(key)).alias("keys")).where(F.size("keys") > 1)


def one_projection(df: DataFrame, site: str, zone: str, ts: str, order: str) -> DataFrame:
    """Scenes of the dominant zone (ties: the smallest); of sites with several zones, a scene also goes if within 24 hours of any scene
    of its site there are two earlier ones in `order`. Anchors may be covered scenes themselves, so that the part by site runs in a
    Python group: a site's scenes within 24 hours of each other are few."""
    kept = df.join(dominant(df, [site], zone, "_zone").withColumnRenamed("n_values", "_zones"), site).where(F.col(zone) == F.col("_zone"))
    columns = df.columns

    def thinned(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        if pdf["_zones"].iloc[0] > 1:
            t = pdf[ts].astype("int64" if pdf[ts].dtype.kind == "M" else float).to_numpy()
            unit = {"s": 1, "ms": 10**3, "us": 10**6, "ns": 10**9}[np.datetime_data(pdf[ts].dtype)[0]] if pdf[ts].dtype.kind == "M" else 1
            by_time = np.argsort(t, kind="stable")
            low = np.searchsorted(t[by_time], t - 86400 * unit, "right")
            high = np.searchsorted(t[by_time], t + 86400 * unit, "left")
            gone = np.zeros(len(pdf), bool)
            for a, b in {(a, b) for a, b in zip(low, high, strict=True) if b - a > 2}:
                gone[np.sort(by_time[a:b])[2:]] = True
            pdf = pdf[~gone]
        return pdf[columns]

    return kept.select(*columns, "_zones", F.col(site).alias("_site")).groupBy("_site").applyInPandas(thinned, df.schema)


def without_contained(df: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """Of scenes with equal `same`, the first whose footprint (x_min, x_max, y_min, y_max) holds all others' stays alone; where none
    does, all stay. A footprint holds all others when it is the envelope of them."""
    group = Window.partitionBy(*same)
    holds = (F.col("x_min") <= F.min("x_min").over(group)) & (F.col("x_max") >= F.max("x_max").over(group)) & (F.col("y_min") <= F.min("y_min").over(group)) & (F.col("y_max") >= F.max("y_max").over(group))
    own = df.withColumn("_holds", F.coalesce(holds, F.lit(False)))
    own = own.withColumn("_place", F.row_number().over(Window.partitionBy(*same).orderBy(F.col("_holds").desc(), *order))).withColumn("_any", F.max("_holds").over(group))
    return own.where(~F.col("_any") | (F.col("_place") == 1)).drop("_holds", "_place", "_any")


def merge_plan(df: DataFrame, site: list[str], ts: str, order: list[str], key: str, seconds: int = 300, most: int = 3) -> DataFrame:
    """df with first (the key of the scene that opens its run), place in the run and action.

    A run is a chain of scenes of which each follows the last within `seconds`. The first is the base, the next up to `most` scenes in
    all are merged into it and later ones dropped; a scene with no follower is single."""
    w = Window.partitionBy(*site).orderBy(ts, *order)
    opens = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w) > seconds * 1_000_000, F.lit(True))
    own = df.withColumn("_opens", opens).withColumn("_run", F.sum(F.col("_opens").cast("int")).over(w))
    run = Window.partitionBy(*site, "_run").orderBy(ts, *order)
    own = own.withColumn("first", F.first(key).over(run)).withColumn("place", F.row_number().over(run)).withColumn("_follower", F.lead(key).over(run))
    action = F.when((F.col("place") == 1) & F.col("_follower").isNull(), "single").when(F.col("place") == 1, "base").when(F.col("place") <= most, "merge").otherwise("drop")
    return own.withColumn("action", action).drop("_opens", "_run", "_follower")
