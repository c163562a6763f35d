"""Level lines of rasters of pixels (scene, r, c, value): segments by windows, lines by a kernel in tiles and list ranking across them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.kernels import chained
from strandline.tables import Rounds

#: Rows and columns of squares whose segments meet in one task.
TILE = 64


def contour_segments(df: DataFrame, by: list[str], value: str, level: Column) -> DataFrame:
    """by, the ends (row0, col0) and (row1, col1) of the level's segments in each square of four pixels, by linear interpolation along
    its sides, and `segment`, a number that ascends by row, column and segment of the square. What is over the level lies to the right of
    the way from the first end to the second. Squares with an unknown corner have none; where opposite corners are over the level, each is
    cut off by itself."""
    right = Window.partitionBy(*by, "r").orderBy("c")
    down = Window.partitionBy(*by, "c").orderBy("r")
    pair = df.select(*by, "r", "c", F.col(value).cast("double").alias("_a"), level.cast("double").alias("_l"), F.lead(F.struct("c", F.col(value).cast("double").alias("v"))).over(right).alias("_n"))
    pair = pair.withColumn("_b", F.when(F.col("_n.c") == F.col("c") + 1, F.col("_n.v")))
    square = pair.withColumn("_m", F.lead(F.struct("r", "_a", "_b")).over(down)).where(F.col("_m.r") == F.col("r") + 1)
    a, b, c, d, lv = F.col("_a"), F.col("_b"), F.col("_m._a"), F.col("_m._b"), F.col("_l")
    square = square.where(a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull() & ~F.isnan(a) & ~F.isnan(b) & ~F.isnan(c) & ~F.isnan(d))
    case = (a > lv).cast("int") + (b > lv).cast("int") * 2 + (c > lv).cast("int") * 4 + (d > lv).cast("int") * 8
    share = lambda p, q: F.when(p == q, 0.0).otherwise((lv - p) / F.nullif(q - p, F.lit(0.0)))
    r, k = F.col("r").cast("double"), F.col("c").cast("double")
    point = lambda row, col: F.struct(row.alias("row"), col.alias("col"))
    top, bottom, left, right_ = point(r, k + share(a, b)), point(r + 1, k + share(c, d)), point(r + share(a, c), k), point(r + share(b, d), k + 1)
    sides = {1: [(top, left)], 2: [(right_, top)], 3: [(right_, left)], 4: [(left, bottom)], 5: [(top, bottom)], 6: [(right_, top), (left, bottom)], 7: [(right_, bottom)]}
    # what is over the level in one case is under it in the other
    sides |= {8: [(bottom, right_)], 9: [(top, left), (bottom, right_)], 10: [(bottom, top)], 11: [(bottom, left)], 12: [(left, right_)], 13: [(top, right_)], 14: [(left, top)]}
    made = F.lit(None)
    for which, pairs in sides.items():
        made = F.when(F.col("_case") == which, F.array(*(F.struct(x.alias("p"), y.alias("q")) for x, y in pairs))).otherwise(made)
    out = square.withColumn("_case", case).where("_case between 1 and 14").select(*by, "r", "c", F.posexplode(made).alias("_k", "_s"))
    number = F.col("r").cast("long") * (1 << 32) + F.col("c").cast("long") * 2 + F.col("_k")
    return out.select(*by, number.alias("segment"), F.col("_s.p.row").alias("row0"), F.col("_s.p.col").alias("col0"), F.col("_s.q.row").alias("row1"), F.col("_s.q.col").alias("col1")).where("row0 <> row1 or col0 <> col1")


def _chains(segments: DataFrame, by: list[str], tile: int) -> DataFrame:
    """segments with their `chain` (the first segment of a stretch of a line inside a tile), `place` in it, and of the chain: `n` segments, its
    lowest number `low` at place `at`, and whether it is a `whole` line. A chain's first segment may `enter` and its last one `leave` the tile."""
    schema = segments.select("*", *(F.lit(0).cast("long").alias(c) for c in ("chain", "place", "n", "low", "at")), *(F.lit(True).alias(c) for c in ("whole", "enter", "leave"))).schema
    row, col = F.shiftright("segment", 32), F.shiftright(F.col("segment").bitwiseAND((1 << 32) - 1), 1)
    dealt = segments.withColumns({"_tr": F.floor(row / tile), "_tc": F.floor(col / tile)})

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("segment").select(segments_names)
        made = chained(*(table[c].to_numpy() for c in ("segment", "row0", "col0", "row1", "col1")), tile)
        for c, values in made.items():
            table = table.append_column(c, pa.array(values))
        return table

    segments_names = segments.columns
    return dealt.groupBy(*by, "_tr", "_tc").applyInArrow(run, schema)


def _linked(pieces: DataFrame, by: list[str]) -> DataFrame:
    """by, chain, n, low, at of the chains that aren't whole lines, with the chain before (`next`, NULL: a loose end) and `steps`, its number of
    segments.

    Where several segments end and begin in one point (the level runs through a pixel), the first to end goes on as the first to begin."""
    place = lambda row, col: F.row_number().over(Window.partitionBy(*by, row, col).orderBy("segment")).alias("_k")
    begins = pieces.where("enter").select(*by, F.col("row0").alias("row"), F.col("col0").alias("col"), place("row0", "col0"), "chain")
    ends = pieces.where("leave").select(*by, F.col("row1").alias("row"), F.col("col1").alias("col"), place("row1", "col1"), F.col("chain").alias("next"), F.col("n").alias("steps"))
    links = begins.join(ends.hint("merge"), [*by, "row", "col", "_k"]).select(*by, "chain", "next", "steps")
    own = pieces.where("NOT whole AND place = 0").select(*by, "chain", "n", "low", "at")
    return own.join(links.hint("merge"), [*by, "chain"], "left").withColumn("steps", F.coalesce("steps", F.lit(0).cast("long")))


def _ranked(linked: DataFrame, by: list[str], rounds: Rounds) -> DataFrame:
    """by, chain, line, start, total, closed: the first segment of a chain's line, its own first segment's place there and the line's segments,
    by pointer doubling.

    Each chain knows the stretch behind it: how many `steps` it reaches to the next unknown chain, its lowest number and the steps `back` to
    that. A round joins each stretch to the one before it, so stretches double. A stretch that ends at a loose end is settled: the line begins
    there. When a round settles no more and finds no lower number, what is left are closed lines; these begin at their lowest segment."""
    state = linked.select(*by, "chain", "n", "next", "steps", F.col("chain").alias("last"), "low", (-F.col("at")).alias("back"))
    state = rounds.table(state, "ranks")
    open_, lows = None, None
    while True:
        left = state.where("next IS NOT NULL").agg(F.count(F.lit(1)), F.sum(F.col("low").cast("decimal(38,0)"))).first()
        if not left[0] or (open_, lows) == tuple(left):
            break
        open_, lows = left
        behind = state.select(*by, F.col("chain").alias("next"), *(F.col(c).alias(f"_{c}") for c in ("next", "steps", "last", "low", "back")))
        lower = F.col("_low") < F.col("low")
        met = state.join(behind.hint("merge"), [*by, "next"], "left").select(
            *by, "chain", "n", F.col("_next").alias("next"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("_last", "last").alias("last"),
            F.when(lower, F.col("_low")).otherwise(F.col("low")).alias("low"), F.when(lower, F.col("steps") + F.col("_back")).otherwise(F.col("back")).alias("back"),
        )
        state = rounds.table(met, "ranks")
    closed = F.col("next").isNotNull()
    own = state.select(*by, "chain", "n", F.when(closed, F.col("low")).otherwise(F.col("last")).alias("line"), F.when(closed, F.col("back")).otherwise(F.col("steps")).alias("start"))
    totals = own.groupBy(*by, "line").agg(F.sum("n").alias("total"))
    return own.drop("n").join(totals.hint("merge"), [*by, "line"])


def contour_lines(segments: DataFrame, by: list[str], tile: int = TILE) -> DataFrame:
    """by, line (the number of its first segment), pt_idx, row, col: segments that share ends put together, a line's points in order; a
    closed line begins at its lowest segment and ends where it begins.

    A kernel puts together what lies in a tile of `tile` rows and columns of squares; only the chains that cross tiles' borders are joined
    further, over any number of tasks, a round for each doubling of a line's chains. Each round is a table in the shared folder, so this
    runs jobs when it is called."""
    rounds = Rounds(segments.sparkSession)
    pieces = rounds.table(_chains(segments, by, tile), "pieces")
    ranked = rounds.table(_ranked(rounds.table(_linked(pieces, by), "linked"), by, rounds), "ranked")
    cols = [*by, "line", "_place", "total", "row0", "col0", "row1", "col1"]
    whole = pieces.where("whole").withColumns({"line": F.col("chain"), "_place": F.col("place"), "total": F.col("n")}).select(*cols)
    # of a closed line's chain that holds its beginning, what lies before that is the line's end
    across = pieces.where("NOT whole").join(ranked.hint("merge"), [*by, "chain"]).withColumn("_place", F.pmod(F.col("start") + F.col("place"), F.col("total"))).select(*cols)
    first = F.struct(F.col("_place").alias("pt_idx"), F.col("row0").alias("row"), F.col("col0").alias("col"))
    second = F.struct((F.col("_place") + 1).alias("pt_idx"), F.col("row1").alias("row"), F.col("col1").alias("col"))
    points = whole.union(across).select(*by, "line", F.inline(F.when(F.col("_place") == F.col("total") - 1, F.array(first, second)).otherwise(F.array(first))))
    return points.withColumn("pt_idx", F.col("pt_idx").cast("int"))


def in_world(lines: DataFrame, scenes: DataFrame, by: list[str]) -> DataFrame:
    """lines with x, y by the georeference of their scene (by, georef)."""
    g = [F.col("georef")[k] for k in range(6)]
    own = lines.join(scenes.select(*by, "georef"), by)
    return own.withColumn("x", g[0] + F.col("col") * g[1] + F.col("row") * g[2]).withColumn("y", g[3] + F.col("col") * g[4] + F.col("row") * g[5]).drop("georef")


def long_lines(lines: DataFrame, by: list[str], least: Column) -> DataFrame:
    """Lines (x, y, pt_idx) at least as long as `least` (a column of theirs)."""
    w = Window.partitionBy(*by, "line")
    step = F.hypot(F.lead("x").over(w.orderBy("pt_idx")) - F.col("x"), F.lead("y").over(w.orderBy("pt_idx")) - F.col("y"))
    own = lines.withColumn("_step", step)
    return own.withColumn("_length", F.coalesce(F.sum("_step").over(w), F.lit(0.0))).where(F.col("_length") >= least).drop("_step", "_length")
