"""Scalar functions of the pipeline as Column expressions; all stay inside code generation."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.projections import converted, lonlat_to_mercator, lonlat_to_utm, utm_to_lonlat  # noqa: F401


def null_if_nan(c: Column) -> Column:
    """NaN as NULL: aggregates then skip it, and comparisons with it keep nothing."""
    return F.when(~F.isnan(c), c)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def nd_index(a: Column, b: Column, masked: Column | None = None) -> Column:
    """(a - b) / (a + b); NULL where masked or where the sum is zero."""
    value = F.try_divide(a - b, a + b)
    return value if masked is None else F.when(~masked, value)


def cloud_by_bits(qa: Column) -> Column:
    """Collection 2 quality band: dilated cloud, cirrus or cloud (bits 1, 2 and 3)."""
    return qa.bitwiseAND(0b1110) != 0


def cloud_by_values(qa: Column) -> Column:
    """Sentinel-2 quality band: exactly opaque cloud or exactly cirrus."""
    return qa.isin(1024, 2048)


def cloud_by_probability(probability: Column, limit: float = 60) -> Column:
    return probability > limit


def is_nodata(*bands: Column) -> Column:
    """No data in any band: NULL, NaN or minus infinity."""
    out = F.lit(False)
    for b in bands:
        out = out | b.isNull() | F.isnan(b) | (b == float("-inf"))
    return out


def is_zero(*bands: Column) -> Column:
    """Zero in all bands."""
    out = F.lit(True)
    for b in bands:
        out = out & F.coalesce(b == 0, F.lit(False))
    return out


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th, ..."""
    tens, ones = F.abs(n) % 100, F.abs(n) % 10
    suffix = F.when(tens.between(11, 13), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def date_of_filename(name: Column) -> Column:
    """The UTC time in the first 19 characters, yyyy-MM-dd-HH-mm-ss."""
    return F.try_to_timestamp(F.substring(name, 1, 19), F.lit("yyyy-MM-dd-HH-mm-ss"))


def flexible_timestamp(text: Column) -> Column:
    """A timestamp with or without fractions of a second; NULL for anything else."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def filename(ts: Column, satname: Column, site: Column, band: Column) -> Column:
    return F.concat(F.concat_ws("_", F.date_format(ts, "yyyy-MM-dd-HH-mm-ss"), satname, site, band), F.lit(".tif"))


def epsg_of_crs(crs: Column) -> Column:
    return F.try_cast(F.substring(crs, 6, 20), "int") if hasattr(F, "try_cast") else F.substring(crs, 6, 20).try_cast("int")


def landsat_collection(name: Column, collection: Column) -> Column:
    """C01 counts as C02 from 2022 on, by the first number in the name."""
    year = F.regexp_extract(name, r"(\d+)", 1).try_cast("int")
    return F.when((collection == "C01") & (year >= 2022), "C02").otherwise(collection)


def pix_to_world(row: Column, col: Column, georef: list[float] | tuple[Column, ...]) -> tuple[Column, Column]:
    g = [x if isinstance(x, Column) else F.lit(float(x)) for x in georef]
    return g[0] + col * g[1] + row * g[2], g[3] + col * g[4] + row * g[5]


def world_to_pix(x: Column, y: Column, georef: list[float] | tuple[Column, ...]) -> tuple[Column, Column]:
    """(column, row) of world coordinates."""
    g = [v if isinstance(v, Column) else F.lit(float(v)) for v in georef]
    det = g[1] * g[5] - g[2] * g[4]
    dx, dy = x - g[0], y - g[3]
    return F.try_divide(g[5] * dx - g[2] * dy, det), F.try_divide(g[1] * dy - g[4] * dx, det)


def tidal_correction(chainage: Column, tide: Column, reference: float, slope: float | Column) -> Column:
    return chainage + (tide - reference) / slope


def pixels_of_area(area: float, pixel: float) -> int:
    return -int(-area // (pixel * pixel))


def pixels_of_distance(distance: float, pixel: float) -> int:
    return -int(-distance // pixel)


def clipped(row: Column, col: Column, height: Column, width: Column) -> tuple[Column, Column]:
    """Pixel coordinates moved into the image."""
    within = lambda v, n: F.least(F.greatest(v, F.lit(0)), n - 1)
    return within(row, height), within(col, width)


def scene_files(filename: Column, satname: Column, root: str) -> Column:
    """The paths of a scene's files by mission, from the name of the first (..._ms.tif): root/mission/kind/name."""
    kinds = F.when(satname == "S2", F.array(*map(F.lit, ("ms", "swir", "mask")))).when(satname == "L5", F.array(*map(F.lit, ("ms", "mask")))).otherwise(F.array(*map(F.lit, ("ms", "pan", "mask"))))
    return F.transform(kinds, lambda k: F.concat_ws("/", F.lit(root), satname, k, F.replace(filename, F.lit("_ms"), F.concat(F.lit("_"), k))))


def split_date_range(start: datetime | date, end: datetime | date, parts: int) -> list[tuple]:
    """Consecutive ranges that share their end points; the last takes the remainder."""
    if end <= start:
        raise ValueError("the end must be after the start")
    days = (end - start).days
    if days < parts - 1:
        raise ValueError("more parts than days")
    each = (end - start) // parts
    return [(start + k * each, start + (k + 1) * each if k < parts - 1 else end) for k in range(parts)]


def landsat_tier(collection: str) -> str:
    if collection == "C01":
        return "C02"
    if collection != "C02":
        raise ValueError(f"unknown Landsat collection {collection}")
    return collection
