"""Pansharpening of pixels as rows: moments of a scene are merged from parts of it, so no scene is one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.pixels import histogram_matched


def principal(a: list[Column]) -> Column:
    """The direction of the largest eigenvalue of a symmetric 3 x 3 matrix (xx, xy, xz, yy, yz, zz), as an array of length one whose
    largest entry, the first of equals, is positive. NULL where the matrix is NULL or all directions are alike."""

    def made(m: Column) -> Column:
        xx, xy, xz, yy, yz, zz = (m[f"_{k}"] for k in range(6))
        mean = (xx + yy + zz) / 3
        spread = F.sqrt(((xx - mean) ** 2 + (yy - mean) ** 2 + (zz - mean) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
        return F.struct(*(c.alias(n) for n, c in zip(("xx", "xy", "xz", "yy", "yz", "zz", "mean", "spread"), (xx, xy, xz, yy, yz, zz, mean, spread), strict=True)))

    def direction(m: Column) -> Column:
        # the largest root of the characteristic polynomial by the cosine of a third of an angle
        p, x, y, z = m["spread"], m["xx"] - m["mean"], m["yy"] - m["mean"], m["zz"] - m["mean"]
        xy, xz, yz = m["xy"], m["xz"], m["yz"]
        det = x * (y * z - yz * yz) - xy * (xy * z - yz * xz) + xz * (xy * yz - y * xz)
        half = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(det, 2 * p * p * p)))
        top = 2 * p * F.cos(F.acos(half) / 3)
        # any two rows of what is left stand square on the direction; the two that differ most give it best
        rows = [(x - top, xy, xz), (xy, y - top, yz), (xz, yz, z - top)]
        cross = [F.array(r[1] * s[2] - r[2] * s[1], r[2] * s[0] - r[0] * s[2], r[0] * s[1] - r[1] * s[0]) for r, s in ((rows[0], rows[1]), (rows[0], rows[2]), (rows[1], rows[2]))]
        size = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        best = F.reduce(F.array(*cross), F.array(*[F.lit(0.0)] * 3), lambda a, b: F.when(size(b) > size(a), b).otherwise(a))
        return F.transform(F.array(best), lambda v: F.transform(v, lambda e: F.try_divide(e, size(v) * F.signum(v[F.array_position(F.transform(v, lambda q: F.abs(q)), F.array_max(F.transform(v, lambda q: F.abs(q)))).cast("int") - 1]))))[0]

    packed = F.array(F.struct(*(c.alias(f"_{k}") for k, c in enumerate(a))))
    return F.when(F.least(*a).isNotNull(), F.transform(F.transform(packed, made), lambda m: F.when(m["spread"] > 0, direction(m)))[0])


def pansharpened(df: DataFrame, by: list[str], bands: list[str], pan: str, masked: Column, most: float = 0.95) -> DataFrame:
    """df (by, r, c) with its three bands sharpened: the first principal component of the pixels that aren't masked gives way to the pan
    band matched to its distribution. With one direction d, its scores s and matched ones m, that is a band's value + (m - s) d.

    Pixels with a NULL or NaN in a band or the pan count as masked. Masked pixels, scenes with more than `most` of them and scenes whose
    bands have no direction of their own stay as they are. (by, r, c) tells pixels apart; of repeated ones each is sharpened alike."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    good = ~F.coalesce(masked, F.lit(True)) & fine(pan)
    for b in bands:
        good = good & fine(b)
    own = df.withColumn("_good", good)
    known = [F.when(F.col("_good"), F.col(b).cast("double")) for b in bands]
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    moments = own.groupBy(*by).agg(F.avg((~F.col("_good")).cast("int")).alias("_share"), F.array(*(F.avg(k) for k in known)).alias("_mean"), *(F.covar_samp(known[i], known[j]).alias(f"_c{i}{j}") for i, j in pairs))
    axis = moments.where(F.col("_share") <= most).select(*by, "_mean", principal([F.col(f"_c{i}{j}") for i, j in pairs]).alias("_axis")).where("_axis IS NOT NULL")
    score = sum(((F.col(b) - F.col("_mean")[k]) * F.col("_axis")[k] for k, b in enumerate(bands)), F.lit(0.0))
    scored = own.where("_good").select(*by, "r", "c", pan, *bands).join(axis, by).select(*by, "r", "c", F.col(pan).cast("double").alias("_pan"), "_axis", score.alias("_score"))
    matched = histogram_matched(scored, scored.select(*by, F.col("_score").alias("_pan")), ["r", "c", "_axis", "_score"], "_pan", by)
    change = matched.groupBy(*by, "r", "c").agg(F.first(F.transform("_axis", lambda a: a * (F.col("matched") - F.col("_score")))).alias("_change"))
    joined = own.join(change, [*by, "r", "c"], "left")
    return joined.select(*(F.when(F.col("_good") & F.col("_change").isNotNull(), F.col(c) + F.col("_change")[bands.index(c)]).otherwise(F.col(c)).alias(c) if c in bands else F.col(c) for c in df.columns))
