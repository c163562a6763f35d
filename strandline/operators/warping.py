"""Rasters brought onto other grids: any origin, pixel size and reference system.

Each target pixel's centre is looked up in the source by its place there, so what travels is target pixels to the source tiles that they
fall into. Tiles carry the first pixels of the ones after them, so a tile answers for its pixels by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.projections import _projection


def target_grids(rasters: DataFrame, double_res: bool = False) -> DataFrame:
    """rasters (height, width, georef) with the grid that scenes are brought onto. With double_res pixels have half the size, cut to whole
    units; where that doesn't give twice as many each way, `error` says so and the grid is NULL, as it is without a georeference."""
    g, h, w = F.col("georef"), F.col("height"), F.col("width")
    if not double_res:
        return rasters.withColumn("error", F.when(g.isNull(), "no georeference"))
    half = lambda k: (g[k] / 2).cast("long").cast("double")
    count = lambda n, k: F.floor(F.try_divide(n * g[k], half(k)) + 0.5)
    fits = F.coalesce((count(w, 1) == 2 * w) & (count(h, 5) == 2 * h), F.lit(False))
    made = rasters.withColumn("error", F.when(g.isNull(), "no georeference").when(~fits, F.concat(F.lit("half the pixels don't fit: "), g[1].cast("string"), F.lit(", "), g[5].cast("string"))))
    doubled = F.array(g[0], half(1), F.lit(0.0), g[3], F.lit(0.0), half(5))
    good = F.col("error").isNull()
    return made.withColumns({"georef": F.when(good, doubled), "height": F.when(good, 2 * h), "width": F.when(good, 2 * w)})


def haloed(tiles: DataFrame, by: list[str], tile: int) -> DataFrame:
    """by, r0, c0, cols, rows, values with the first pixels of the tiles to the right (`right`), below (`below`) and across (`corner`)."""
    rows, cols, v = F.col("rows"), F.col("cols"), F.col("values")
    column = F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.get(v, r * cols))
    none = F.lit(None).cast("array<double>")
    piece = lambda dr, dc, **own: F.struct((F.col("r0") - dr * tile).alias("r0"), (F.col("c0") - dc * tile).alias("c0"), *((own.get(n, none)).alias(n) for n in ("values", "right", "below", "corner")), *((c if "values" in own else F.lit(None).cast("int")).alias(n) for n, c in (("rows", rows), ("cols", cols))))
    sent = tiles.where("rows > 0 AND cols > 0").select(*by, F.inline(F.array(piece(0, 0, values=v), piece(0, 1, right=column), piece(1, 0, below=F.slice(v, 1, cols)), piece(1, 1, corner=F.slice(v, 1, 1)))))
    made = sent.groupBy(*by, "r0", "c0").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("rows", "cols", "values", "right", "below", "corner")))
    return made.where("values IS NOT NULL")


def warped(tiles: DataFrame, grids: DataFrame, by: list[str], tile: int, nearest: bool = False, block: int = 256) -> DataFrame:
    """by, r, c, value: the pixels of grids (by, height, width, georef, epsg) from source tiles (by, height, width, georef, epsg, r0, c0,
    rows, cols, values), which lie on a grid of `tile` from the source's first pixel. A key (by) has one source and one grid.

    Linear between the centres of the four source pixels around, or the source pixel that holds the centre (`nearest`). Unknown pixels
    (NULL, NaN, tiles that aren't there) are left out of the mean; pixels outside the source, or without any known one, are NULL. So are
    all pixels if one of two different systems isn't known. Grids coarser than the source are sampled at their pixels' centres. Sources
    without a grid and grids without a source give no rows; neither do grids that are NULL."""
    return warped_both(tiles, grids, by, tile, block).select(*by, "r", "c", F.col("nearest" if nearest else "linear").alias("value"))


def warped_both(tiles: DataFrame, grids: DataFrame, by: list[str], tile: int, block: int = 256) -> DataFrame:
    """by, r, c, linear, nearest: both values of `warped` in one pass. The nearest pixel is one of the four around, so both are of one tile.
    Values are plain expressions of the joined rows, which Spark compiles; functions over lists of pixels took longer than all else."""
    facts = ["height", "width", "georef", "epsg"]
    sources = tiles.select(*by, F.struct(*facts).alias("_s")).groupBy(*by).agg(F.max("_s").alias("_s"))
    planned = grids.where("height > 0 AND width > 0 AND georef IS NOT NULL").select(*by, F.struct(*facts).alias("_t")).join(sources, by)
    # blocks first, so that a raster's pixels are made by many tasks
    steps = lambda n: F.sequence(F.lit(0), F.col(n) - 1, F.lit(block))
    blocks = planned.withColumn("_r0", F.explode(steps("_t.height"))).withColumn("_c0", F.explode(steps("_t.width"))).repartition(*by, "_r0", "_c0")
    inner = lambda n, at: F.sequence(F.col(at), F.least(F.col(n), F.col(at) + block) - 1)
    pixels = blocks.withColumn("r", F.explode(inner("_t.height", "_r0"))).withColumn("c", F.explode(inner("_t.width", "_c0")))
    t, s = F.col("_t.georef"), F.col("_s.georef")
    x, y = t[0] + (F.col("c") + 0.5) * t[1] + (F.col("r") + 0.5) * t[2], t[3] + (F.col("c") + 0.5) * t[4] + (F.col("r") + 0.5) * t[5]
    same = F.col("_s.epsg").eqNullSafe(F.col("_t.epsg"))
    moved = _projection(x, y, F.col("_t.epsg"), F.col("_s.epsg"))
    at = F.when(same, F.struct(x.alias("x"), y.alias("y"))).otherwise(F.struct(moved["x_t"].alias("x"), moved["y_t"].alias("y")))
    pixels = pixels.select(*by, "r", "c", "_s", at.alias("_at"))
    turn = s[1] * s[5] - s[2] * s[4]
    dx, dy = F.col("_at.x") - s[0], F.col("_at.y") - s[3]
    pixels = pixels.withColumns({"_u": F.try_divide(s[5] * dx - s[2] * dy, turn), "_v": F.try_divide(s[1] * dy - s[4] * dx, turn)})
    known = F.coalesce((F.col("_u") >= 0) & (F.col("_u") < F.col("_s.width")) & (F.col("_v") >= 0) & (F.col("_v") < F.col("_s.height")), F.lit(False))

    def base(p: str) -> tuple[Column, Column]:
        """The first of the two pixels along one side, and the share of the second."""
        low = F.floor(F.col(p) - 0.5)
        return F.greatest(low, F.lit(0)).cast("int"), F.when(low < 0, 0.0).otherwise(F.col(p) - 0.5 - low)

    (i, f), (j, g) = base("_v"), base("_u")
    pixels = pixels.select(*by, "r", "c", known.alias("_known"), i.alias("_i"), j.alias("_j"), f.alias("_f"), g.alias("_g"))
    start = lambda c: F.when(F.col("_known"), (F.floor(F.col(c) / tile) * tile).cast("int")).otherwise(-1)
    pixels = pixels.withColumns({"r0": start("_i"), "c0": start("_j")}).drop("_known")
    joined = pixels.join(haloed(tiles, by, tile).hint("merge"), [*by, "r0", "c0"], "left")
    rows, cols, f, g = (F.col(c) for c in ("rows", "cols", "_f", "_g"))

    def read(a: int, b: int) -> Column:
        i, j = F.col("_i") - F.col("r0") + a, F.col("_j") - F.col("c0") + b
        v = F.when((i < rows) & (j < cols), F.get("values", i * cols + j)).when((i < rows) & (j == tile), F.get("right", i)).when((i == tile) & (j < cols), F.get("below", j)).when((i == tile) & (j == tile), F.get("corner", F.lit(0)))
        return F.nanvl(v, F.lit(None).cast("double"))

    four = [(a, b) for a in (0, 1) for b in (0, 1)]
    read_ = joined.select(*by, "r", "c", "_f", "_g", *(read(a, b).alias(f"_v{a}{b}") for a, b in four))
    weight = lambda a, b: (f if a else 1 - f) * (g if b else 1 - g)
    none = F.lit(0.0)

    def total(term) -> Column:
        out = none
        for a, b in four:
            out = out + F.when(F.col(f"_v{a}{b}").isNotNull() & (weight(a, b) > 0), term(a, b)).otherwise(none)
        return out

    linear = F.try_divide(total(lambda a, b: F.col(f"_v{a}{b}") * weight(a, b)), total(weight))
    below, right = f >= 0.5, g >= 0.5
    nearest = F.when(below & right, F.col("_v11")).when(below, F.col("_v10")).when(right, F.col("_v01")).otherwise(F.col("_v00"))
    return read_.select(*by, "r", "c", linear.alias("linear"), nearest.alias("nearest"))
