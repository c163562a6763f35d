"""Coordinate reference systems as data: the system of a point is a column, so that scenes of many systems go through one expression.

A UTM system is a central meridian, a false northing and an ellipsoid, all of them columns made from its EPSG code. The transverse
Mercator projection goes by Krüger's series in the third flattening to its fourth power, which is good to a thousandth of a millimetre
some 40 degrees from the meridian, so points of neighbouring zones can be brought into one. Datums whose difference is below two metres
(WGS84, GDA, NAD83, ETRS89) are taken as one. Longitude is always first. Null coordinates and unknown or null systems give nulls.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The semi-major axis of both ellipsoids, the inverse flattenings of WGS84 and GRS80, scale at the meridian, false easting
#: and southern false northing.
AXIS, WGS84, GRS80, SCALE, EASTING, SOUTHERN = 6378137.0, 298.257223563, 298.257222101, 0.9996, 500_000.0, 10_000_000.0
#: UTM groups by the hundreds of their codes (zone: the rest), with their ellipsoid and whether they are southern.
UTM_GROUPS = {326: (WGS84, False), 327: (WGS84, True), 283: (GRS80, True), 78: (GRS80, True), 269: (GRS80, False), 258: (GRS80, False)}
#: Geographic systems and web Mercator.
GEOGRAPHIC, MERCATOR = (4326, 4283, 7844, 4269, 4258), 3857


Values = dict[str, Column]


def column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _series(inverse: float) -> dict[str, list[float]]:
    """What Krüger's series needs of an ellipsoid: the length of a radian on the rectifying sphere, the eccentricity, and coefficients to
    rectified coordinates, back, and from conformal to geodetic latitudes (fixed values)."""
    n = 1 / (2 * inverse - 1)
    return {
        "radian": [SCALE * AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)],
        "eccentricity": [2 * math.sqrt(n) / (1 + n)],
        "forth": [n / 2 - n**2 * 2 / 3 + n**3 * 5 / 16 + n**4 * 41 / 180, n**2 * 13 / 48 - n**3 * 3 / 5 + n**4 * 557 / 1440, n**3 * 61 / 240 - n**4 * 103 / 140, n**4 * 49561 / 161280],
        "back": [n / 2 - n**2 * 2 / 3 + n**3 * 37 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - n**4 * 437 / 1440, n**3 * 17 / 480 - n**4 * 37 / 840, n**4 * 4397 / 161280],
        "geodetic": [2 * n - n**2 * 2 / 3 - 2 * n**3 + n**4 * 116 / 45, n**2 * 7 / 3 - n**3 * 8 / 5 - n**4 * 227 / 45, n**3 * 56 / 15 - n**4 * 136 / 35, n**4 * 4279 / 630],
    }


#: Both ellipsoids' numbers in one order; a system's are the literals at its place.
_ORDER = ["radian", "eccentricity", "forth", "back", "geodetic"]
_NUMBERS = {inverse: [x for name in _ORDER for x in _series(inverse)[name]] for inverse in (WGS84, GRS80)}
_PLACES = {"radian": 0, "eccentricity": 1, "forth": 2, "back": 6, "geodetic": 10}


def _number(v: Values, tag: str, name: str, k: int = 0) -> Column:
    return v[f"numbers_{tag}"][_PLACES[name] + k]


def _sum(v: Values, tag: str, name: str, term) -> Column:
    total = _number(v, tag, name) * term(2.0)
    for k in range(1, 4):
        total = total + _number(v, tag, name, k) * term(2.0 * k + 2)
    return total


def _ellipsoid(epsg: str, tag: str):
    """The meridian, false northing and ellipsoid's numbers of the UTM system in a column; nulls for other systems."""

    def stage(v: Values) -> Values:
        group, zone = F.floor(v[epsg] / 100), v[epsg] % 100
        known = zone.between(1, 60) & group.isin(*UTM_GROUPS)
        southern, grs80 = ([g for g, x in UTM_GROUPS.items() if x[k] == value] for k, value in ((1, True), (0, GRS80)))
        numbers = {i: F.array(*map(F.lit, x)) for i, x in _NUMBERS.items()}
        return {
            f"meridian_{tag}": F.when(known, zone * 6.0 - 183), f"northing_{tag}": F.when(group.isin(*southern), SOUTHERN).otherwise(0.0),
            f"numbers_{tag}": F.when(group.isin(*grs80), numbers[GRS80]).otherwise(numbers[WGS84]),
        }

    return stage


def _unrectified(v: Values) -> Values:
    return {"xi": (v["y"] - v["northing_s"]) / _number(v, "s", "radian"), "eta": (v["x"] - EASTING) / _number(v, "s", "radian")}


def _sphere(v: Values) -> Values:
    xi, eta = v["xi"], v["eta"]
    return {"north": xi - _sum(v, "s", "back", lambda k: F.sin(k * xi) * F.cosh(k * eta)), "east": eta - _sum(v, "s", "back", lambda k: F.cos(k * xi) * F.sinh(k * eta))}


def _latitudes(v: Values) -> Values:
    return {"chi": F.asin(F.sin(v["north"]) / F.cosh(v["east"]))}


def _lonlat(v: Values) -> Values:
    lon = v["meridian_s"] + F.degrees(F.atan2(F.sinh(v["east"]), F.cos(v["north"])))
    lat = F.degrees(v["chi"] + _sum(v, "s", "geodetic", lambda k: F.sin(k * v["chi"])))
    mercator = F.degrees(v["x"] / AXIS), F.degrees(F.atan(F.sinh(v["y"] / AXIS)))
    return {c: F.when(v["s"].isin(*GEOGRAPHIC), own).when(v["s"] == MERCATOR, m).otherwise(u) for c, own, m, u in zip(("lon", "lat"), (v["x"], v["y"]), mercator, (lon, lat), strict=True)}


def _tangent(v: Values) -> Values:
    """The tangent of the conformal latitude, and the angle from the meridian."""
    e, sin = _number(v, "t", "eccentricity"), F.sin(F.radians(v["lat"]))
    return {"tan": F.sinh(F.atanh(sin) - e * F.atanh(e * sin)), "lam": F.radians(v["lon"] - v["meridian_t"])}


def _conformal(v: Values) -> Values:
    cos = F.cos(v["lam"])
    return {"xi": F.atan2(v["tan"], cos), "eta": F.asinh(F.sin(v["lam"]) / F.sqrt(v["tan"] * v["tan"] + cos * cos))}


def _projected(v: Values) -> Values:
    own = _number(v, "t", "radian")
    north = v["xi"] + _sum(v, "t", "forth", lambda k: F.sin(k * v["xi"]) * F.cosh(k * v["eta"]))
    east = v["eta"] + _sum(v, "t", "forth", lambda k: F.cos(k * v["xi"]) * F.sinh(k * v["eta"]))
    utm, mercator = (EASTING + own * east, v["northing_t"] + own * north), (F.radians(v["lon"]) * AXIS, F.asinh(F.tan(F.radians(v["lat"]))) * AXIS)
    made = [F.when(v["t"].isin(*GEOGRAPHIC), own).when(v["t"] == MERCATOR, m).otherwise(u) for own, m, u in zip((v["lon"], v["lat"]), mercator, utm, strict=True)]
    known = known_system(v["s"]) & known_system(v["t"])
    return {f"{c}_t": F.when(known, F.when(v["s"] == v["t"], v[c]).otherwise(to)) for c, to in zip(("x", "y"), made, strict=True)}


def _converged(v: Values) -> Values:
    along = 1 + _sum(v, "t", "forth", lambda k: k * F.cos(k * v["xi"]) * F.cosh(k * v["eta"]))
    across = _sum(v, "t", "forth", lambda k: k * F.sin(k * v["xi"]) * F.sinh(k * v["eta"]))
    root, turned = F.sqrt(1 + v["tan"] * v["tan"]), v["tan"] * F.tan(v["lam"])
    return {"convergence": F.degrees(F.atan2(across * root + along * turned, along * root - across * turned))}


#: Steps that each use the values of the ones before, so that none is written out more than once.
BACK, FORTH = [_ellipsoid("s", "s"), _unrectified, _sphere, _latitudes, _lonlat], [_ellipsoid("t", "t"), _tangent, _conformal]


def _bound(values: Values, steps: list, result) -> Column:
    """The result of steps on values as one expression, in which a lambda binds the values of each step. As columns of projections of
    their own, the optimizer would write them out anew in every predicate that it pushes down."""
    if not steps:
        return result(values)
    every = {**values, **steps[0](values)}
    row = F.array(F.struct(*(c.alias(name) for name, c in every.items())))
    return F.get(F.transform(row, lambda v: _bound({name: v[name] for name in every}, steps[1:], result)), F.lit(0))


def _projection(x: Column, y: Column, source: Column | int, target: Column | int) -> Column:
    values = {"x": x.cast("double"), "y": y.cast("double"), "s": _checked(source), "t": _checked(target)}
    return _bound(values, [*BACK, *FORTH], lambda v: F.struct(*(c.alias(name) for name, c in _projected(v).items())))


def reprojected(df: DataFrame, x: str, y: str, source: Column | int, target: Column | int, to: tuple[str, str] = ("x", "y")) -> DataFrame:
    """df with the columns `to` of (x, y), brought from one system to another; both are projected at once."""
    made = df.withColumn("_proj", _projection(F.col(x), F.col(y), source, target))
    return made.select(*(c for c in df.columns if c not in to), F.col("_proj.x_t").alias(to[0]), F.col("_proj.y_t").alias(to[1]))


def grid_convergence(lon: Column, lat: Column, epsg: Column | int) -> Column:
    """Degrees from true to grid north of a UTM system, clockwise: an azimuth less this is the bearing on the grid."""
    return _bound({"lon": lon, "lat": lat, "t": _checked(epsg)}, FORTH, lambda v: _converged(v)["convergence"])


def known_system(epsg: Column | int) -> Column:
    epsg = column(epsg)
    return F.coalesce(epsg.isin(*GEOGRAPHIC, MERCATOR) | (F.floor(epsg / 100).isin(*UTM_GROUPS) & (epsg % 100).between(1, 60)), F.lit(False))


def _checked(epsg: Column | int) -> Column:
    if isinstance(epsg, int) and epsg not in (*GEOGRAPHIC, MERCATOR) and not (epsg // 100 in UTM_GROUPS and 1 <= epsg % 100 <= 60):
        raise ValueError(f"unknown reference system {epsg}")
    return column(epsg)


def converted(x: Column, y: Column, source: Column | int, target: Column | int) -> tuple[Column, Column]:
    """(x, y) from one system to another, both codes or columns of codes; equal systems change nothing. A code that isn't known raises."""
    if isinstance(source, int) and isinstance(target, int) and source == target:
        return x, y
    made = _projection(x, y, source, target)
    return made["x_t"], made["y_t"]


def lonlat_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical web Mercator."""
    return F.radians(lon) * AXIS, F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * AXIS


def _utm(zone: Column | int, south: Column | bool) -> Column:
    return F.when(column(south), 32700).otherwise(32600) + column(zone)


def lonlat_to_utm(lon: Column, lat: Column, zone: Column | int, south: Column | bool) -> tuple[Column, Column]:
    return converted(lon, lat, F.lit(4326), _utm(zone, south))


def utm_to_lonlat(x: Column, y: Column, zone: Column | int, south: Column | bool) -> tuple[Column, Column]:
    return converted(x, y, _utm(zone, south), F.lit(4326))
