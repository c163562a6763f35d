"""Pixels of scenes as rows (scene, r, c, bands): covers, thresholds, neighbourhoods, contours and mosaics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.series import surrounded


def cover(df: DataFrame, by: list[str], cloud: Column, nodata: Column) -> DataFrame:
    """combined: share of pixels in either mask; cover: pixels in exactly one, by pixels with data."""
    own = df.withColumn("_c", cloud).withColumn("_n", nodata)
    return own.groupBy(*by).agg(F.avg((F.col("_c") | F.col("_n")).cast("int")).alias("combined"), F.try_divide(F.count_if(F.col("_c") != F.col("_n")), F.count_if(~F.col("_n"))).alias("cover"))


def clear_scenes(df: DataFrame, by: list[str], cloud: Column, nodata: Column, threshold: float, most: float = 0.99) -> DataFrame:
    return cover(df, by, cloud, nodata).where((F.col("combined") <= most) & (F.coalesce("cover", F.lit(1.0)) <= threshold))


def edge_padding(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """All-zero rows and columns at the edges of a band."""
    live = F.col(value) != 0
    ends = df.groupBy(*by).agg(*(f(F.when(live, F.col(c))).alias(f"{n}_{c}") for c in ("r", "c") for n, f in (("lo", F.min), ("hi", F.max))), F.max("r").alias("rows"), F.max("c").alias("cols"))
    return ends.select(*by, F.col("lo_r").alias("top"), (F.col("rows") - F.col("hi_r")).alias("bottom"), F.col("lo_c").alias("left"), (F.col("cols") - F.col("hi_c")).alias("right"))


def stretched(df: DataFrame, by: list[str], value: str, quantile: float = 0.999, name: str = "stretched") -> DataFrame:
    """value cut to 0..its quantile and scaled to 0..1."""
    top = df.groupBy(*by).agg(F.percentile(value, quantile).alias("_top"))
    return df.join(top, by).withColumn(name, F.try_divide(F.least(F.greatest(F.col(value), F.lit(0.0)), F.col("_top")), F.col("_top"))).drop("_top")


def otsu(df: DataFrame, by: list[str], value: str, bins: int = 256) -> DataFrame:
    """The threshold with the largest variance between classes over `bins` equal bins: the centre of the first such bin."""
    own = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    ends = own.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = own.join(ends, by) if by else own.crossJoin(F.broadcast(ends))  # one row
    bin_ = F.least(F.floor(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    h = joined.groupBy(*by, F.coalesce(bin_, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("h"), F.first("_lo").alias("lo"), F.first("_hi").alias("hi"))
    centre = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    h = h.withColumn("centre", centre)
    up = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    h = h.withColumn("w1", F.sum("h").over(up)).withColumn("w2", F.sum("h").over(down))
    h = h.withColumn("m1", F.sum(F.col("h") * F.col("centre")).over(up) / F.col("w1")).withColumn("m2", F.try_divide(F.sum(F.col("h") * F.col("centre")).over(down), F.col("w2")))
    between = F.coalesce(F.col("w1") * F.col("w2") * (F.col("m1") - F.col("m2")) ** 2, F.lit(-1.0))
    return h.groupBy(*by).agg(F.min_by("centre", F.struct(-F.round(between, 9), "bin")).alias("threshold"), F.sum("h").alias("n"))


def balanced(df: DataFrame, by: list[str], label: str, key: list[str], salt: int = 7919) -> DataFrame:
    """As many rows of each class as the smallest has, by an arithmetic hash of the key that any engine can repeat."""
    order = F.pmod(sum((F.col(k) * (salt + 2 * i) for i, k in enumerate(key)), F.lit(13)), F.lit(1_000_003))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by, label).orderBy(order, *key)))
    least = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.min("_n").alias("_least"))
    joined = ranked.join(least, by) if by else ranked.crossJoin(F.broadcast(least))  # one row
    return joined.where(F.col("_r") <= F.col("_least")).drop("_r", "_least")


def local_std(df: DataFrame, by: list[str], value: str, rows: str, cols: str, name: str = "std") -> DataFrame:
    """Deviation over 3 x 3 pixels, reflected at the edges without repeating them; NULLs are skipped, a NULL centre stays NULL.

    df has every pixel of a scene and the scene's numbers of rows and columns. Counts, sums and squares are added up along rows and then
    along columns, each with the neighbours that a window gives; at an edge the only inner neighbour stands for the missing one as well."""

    def added(own: DataFrame, across: str, along: str, size: str, sums: dict[str, Column]) -> DataFrame:
        w = Window.partitionBy(*by, across).orderBy(along)
        own = own.withColumns(sums)
        pack = F.struct(F.col(along).alias("at"), *sums)
        own = own.withColumn("_before", F.lag(pack).over(w)).withColumn("_behind", F.lead(pack).over(w))
        twice = lambda edge: F.when(edge, 2).otherwise(1)
        before = F.when(F.col("_before.at") == F.col(along) - 1, twice(F.col(along) == F.col(size) - 1)).otherwise(0)
        behind = F.when(F.col("_behind.at") == F.col(along) + 1, twice(F.col(along) == 0)).otherwise(0)
        other = lambda side, times, c: F.coalesce(times * F.col(f"{side}.{c}"), F.lit(0))
        return own.withColumns({c: F.col(c) + other("_before", before, c) + other("_behind", behind, c) for c in sums}).drop("_before", "_behind")

    v, known = F.col(value), F.col(value).isNotNull()
    zero = F.lit(0.0)
    own = added(df, "r", "c", cols, {"_n": known.cast("int"), "_s": F.when(known, v).otherwise(zero), "_q": F.when(known, v * v).otherwise(zero)})
    own = added(own, "c", "r", rows, {c: F.col(c) for c in ("_n", "_s", "_q")})
    mean = F.try_divide(F.col("_s"), F.col("_n"))
    std = F.sqrt(F.greatest(zero, F.try_divide(F.col("_q"), F.col("_n")) - mean * mean))
    return own.withColumn(name, F.when(known, std)).select(*(c for c in df.columns if c != name), name)


def contour_points(df: DataFrame, by: list[str], value: str, level: Column) -> DataFrame:
    """Points (row, col) at which the level crosses the edges between pixels, by linear interpolation; NULLs give none."""
    own = df.withColumn("_l", level)
    out = None
    for along, across in (("c", "r"), ("r", "c")):
        w = Window.partitionBy(*by, across).orderBy(along)
        nxt = own.withColumn("_v", F.lead(value).over(w)).withColumn("_a", F.lead(along).over(w)).where(F.col("_a") == F.col(along) + 1)
        cross = ((F.col(value) > F.col("_l")) != (F.col("_v") > F.col("_l")))
        at = F.col(along) + (F.col("_l") - F.col(value)) / (F.col("_v") - F.col(value))
        row, col = (F.col("r").cast("double"), at) if along == "c" else (at, F.col("c").cast("double"))
        part = nxt.where(cross).select(*by, row.alias("row"), col.alias("col"))
        out = part if out is None else out.union(part)
    return out


def away_from(points: DataFrame, others: DataFrame, distance: float, by: list[str] = ()) -> DataFrame:
    """Points (by, x, y) without any of `others` (by, x, y) closer than `distance`, by grid cells of that size and their neighbours."""
    cell = lambda df: df.withColumn("_i", F.floor(F.col("x") / distance)).withColumn("_j", F.floor(F.col("y") / distance))
    around = F.expr("sequence(-1, 1)")
    spread = cell(others.select(*by, "x", "y").distinct()).withColumn("_di", F.explode(around)).withColumn("_dj", F.explode(around))
    spread = spread.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("x").alias("_x"), F.col("y").alias("_y"), (F.col("_i") + F.col("_di")).alias("_i"), (F.col("_j") + F.col("_dj")).alias("_j"))
    own = cell(points)
    same = (own["_i"] == spread["_i"]) & (own["_j"] == spread["_j"])
    for c in by:
        same = same & (own[c] == spread[f"_{c}"])
    near = F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")) < distance
    return own.join(spread, same & near, "left_anti").drop("_i", "_j")


def mosaic(df: DataFrame, value: str, nodata: float, order: str, by: list[str] = ()) -> DataFrame:
    """by, r, c, value: of each pixel the last file's value that isn't nodata."""
    return df.where(F.col(value) != nodata).groupBy(*by, "r", "c").agg(F.max_by(value, order).alias(value))


def coarser(df: DataFrame, value: str, factor: int) -> DataFrame:
    """Of each factor x factor pixels the one next to their middle (the later one of even factors), as one pixel."""
    middle = factor // 2
    return df.where((F.col("r") % factor == middle) & (F.col("c") % factor == middle)).withColumns({"r": F.floor(F.col("r") / factor).cast("int"), "c": F.floor(F.col("c") / factor).cast("int")})


def _shares(df: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """by, v, q: each distinct value and the share of the scene's values up to it. Sums run within each of `bins` equal ranges of the
    scene's values, and then over the ranges."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("_n"))
    ends = counts.groupBy(*by).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.sum("_n").alias("_all"))
    counts = counts.join(ends, by) if by else counts.crossJoin(F.broadcast(ends))  # one row
    counts = counts.withColumn("_bin", F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins), F.lit(0)))
    totals = counts.groupBy(*by, "_bin").agg(F.sum("_n").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*by, "_bin", F.coalesce(before, F.lit(0)).alias("_base"))
    within = F.sum("_n").over(Window.partitionBy(*by, "_bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_up", within).join(totals, [*by, "_bin"]).select(*by, "v", ((F.col("_base") + F.col("_up")) / F.col("_all")).alias("q"))


def histogram_matched(source: DataFrame, template: DataFrame, keep: list[str], value: str, by: list[str] = (), bins: int = 1024) -> DataFrame:
    """by, keep, matched of source: the template's value at the same share of its scene's distribution, linear in between, ends held.

    Shares are taken on distinct values with their counts, so pixels of one value travel once. Scenes (`by`) are matched apart."""
    by = list(by)
    s, t = _shares(source, by, value, bins), _shares(template, by, value, bins).select(*by, F.col("q").alias("_t"), F.col("v").alias("_v"))
    m = surrounded(s, t, by, F.col("q"), F.floor(F.col("_t") * bins))
    lo, hi, q = F.col("_before"), F.col("_after"), F.col("_row.q")
    lerp = lo["_v"] + F.try_divide((q - lo["_t"]) * (hi["_v"] - lo["_v"]), hi["_t"] - lo["_t"])
    m = m.select(*(F.col(f"_row.{c}").alias(c) for c in by), F.col("_row.v").alias("_value"), F.when(lo.isNull(), hi["_v"]).when(hi.isNull(), lo["_v"]).otherwise(lerp).alias("matched"))
    own = source.withColumn("_value", F.col(value).cast("double"))
    return own.join(m, [*by, "_value"], "left").select(*by, *keep, "matched")


def polyline_length(df: DataFrame, by: list[str], order: str, least: float = 0.0) -> DataFrame:
    """Lengths of lines of points (x, y) in order; shorter ones than `least` go."""
    w = Window.partitionBy(*by).orderBy(order)
    step = F.hypot(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y"))
    return df.withColumn("_s", step).groupBy(*by).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("length"), F.count(F.lit(1)).alias("n_points")).where(F.col("length") >= least)


def inside(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies within a closed ring and not on it, by crossings of a ray; the ring is part of the expression."""
    crossings, on = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        on = on | (((bx - ax) * (y - ay) == (by - ay) * (x - ax)) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
        if ay != by:
            hit = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            crossings = crossings + hit.cast("int")
    return (crossings % 2 == 1) & ~on


def within_area(df: DataFrame, by: list[str], rings: list[list[tuple[float, float]]], least: int = 3) -> DataFrame:
    """Points in any of the rings, of lines that keep `least` points at least; without rings everything stays."""
    if not rings:
        return df
    hit = F.lit(False)
    for ring in rings:
        hit = hit | inside(F.col("x"), F.col("y"), ring)
    return df.where(hit).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("_n") >= least).drop("_n")


def nearest_resampled(df: DataFrame, by: list[str], factor: int) -> DataFrame:
    """Each pixel as factor x factor pixels."""
    k = F.explode(F.sequence(F.lit(0), F.lit(factor * factor - 1)))
    own = df.withColumn("_k", k)
    return own.withColumn("r", F.col("r") * factor + F.floor(F.col("_k") / factor).cast("int")).withColumn("c", F.col("c") * factor + F.col("_k") % factor).drop("_k")


def reference_buffer(df: DataFrame, by: list[str], points: DataFrame, radius: int, name: str = "near") -> DataFrame:
    """Whether a pixel lies within `radius` pixels of a reference point (row, col); without a reference every pixel does.

    Points beyond the first row and column or the scene count for nothing. Each pixel hit is spread over a disk once, so the work
    follows the reference's pixels and not their pairs with the scene's."""
    hit = points.select(*by, F.floor("row").cast("int").alias("_r"), F.floor("col").cast("int").alias("_c")).where("_r > 0 and _c > 0").distinct()
    hit = hit.join(df.select(*by, F.col("r").alias("_r"), F.col("c").alias("_c")), [*by, "_r", "_c"], "left_semi")
    disk = [(dr, dc) for dr in range(-radius, radius + 1) for dc in range(-radius, radius + 1) if dr * dr + dc * dc <= radius * radius]
    offsets = F.explode(F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in disk))).alias("_o")
    spread = hit.select(*by, "_r", "_c", offsets).select(*by, (F.col("_r") + F.col("_o.dr")).alias("r"), (F.col("_c") + F.col("_o.dc")).alias("c"), F.lit(True).alias("_hit")).distinct()
    if points.isEmpty():
        return df.withColumn(name, F.lit(True))
    return df.join(spread, [*by, "r", "c"], "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit")


def bilinear_resampled(df: DataFrame, by: list[str], value: str, rows: str, cols: str, factor: int) -> DataFrame:
    """by, r, c, value of each pixel as factor x factor pixels, linear between the centres of pixels and held at the edges.

    Each pixel sends its share to the pixels that see it, and shares are summed before the shuffle; NULLs are left out of the mean."""
    k = F.explode(F.sequence(F.lit(0), F.lit(4 * factor * factor - 1)))
    at = lambda c, step: F.col(c) * factor - F.lit(factor // 2) + step
    sent = df.where(F.col(value).isNotNull()).withColumn("_k", k)
    sent = sent.withColumn("_y", at("r", F.floor(F.col("_k") / (2 * factor)).cast("int"))).withColumn("_x", at("c", F.col("_k") % (2 * factor)))
    sent = sent.where(F.col("_y").between(0, F.col(rows) * factor - 1) & F.col("_x").between(0, F.col(cols) * factor - 1))

    def share(own: str, out: str, size: str) -> Column:
        centre = F.least(F.greatest((F.col(out) + 0.5) / factor - 0.5, F.lit(0.0)), F.col(size) - 1)
        return F.greatest(F.lit(0.0), 1 - F.abs(centre - F.col(own)))

    sent = sent.withColumn("_w", share("r", "_y", rows) * share("c", "_x", cols)).where("_w > 0")
    mean = F.sum(F.col("_w") * F.col(value)) / F.sum("_w")
    return sent.groupBy(*by, F.col("_y").alias("r"), F.col("_x").alias("c")).agg(mean.alias(value))


def edge_artefacts(df: DataFrame, by: list[str], value: str, rows: str, cols: str, least: float = 1e-6, name: str = "artefact") -> DataFrame:
    """Pixels of a flat or unknown neighbourhood, and the pixels next to them. Only flagged pixels are spread."""
    flat = local_std(df, by, value, rows, cols, "_std").where(F.col("_std").isNull() | (F.col("_std") < least))
    offsets = F.explode(F.expr("transform(sequence(0, 8), k -> struct(cast(k div 3 - 1 as int) as dr, cast(k % 3 - 1 as int) as dc))")).alias("_o")
    spread = flat.select(*by, "r", "c", offsets).select(*by, (F.col("r") + F.col("_o.dr")).alias("r"), (F.col("c") + F.col("_o.dc")).alias("c")).distinct()
    return df.join(spread.withColumn("_hit", F.lit(True)), [*by, "r", "c"], "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit")


def rectangle(df: DataFrame, by: list[str], x: Column, y: Column, whole: bool = False) -> DataFrame:
    """The smallest upright rectangle around points; `whole` rounds it outwards to whole units, as for pixels to be read."""
    low, high = (F.floor, F.ceil) if whole else (lambda c: c, lambda c: c)
    return df.groupBy(*by).agg(low(F.min(x)).alias("x_min"), high(F.max(x)).alias("x_max"), low(F.min(y)).alias("y_min"), high(F.max(y)).alias("y_max"))


def densified(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, x, y: a point every unit along each segment of lines of points (x, y) in order, the segment's end left out."""
    w = Window.partitionBy(*by).orderBy(order)
    dx, dy = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    own = df.withColumn("_dx", dx).withColumn("_dy", dy).withColumn("_d", F.hypot("_dx", "_dy")).where("_d > 0")
    own = own.withColumn("_k", F.explode(F.sequence(F.lit(0), F.ceil("_d").cast("int") - 1)))
    return own.select(*by, (F.col("x") + F.col("_k") * F.col("_dx") / F.col("_d")).alias("x"), (F.col("y") + F.col("_k") * F.col("_dy") / F.col("_d")).alias("y"))
