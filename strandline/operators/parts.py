"""Connected parts of masks that are larger than a task's memory: tiles are labelled by themselves, then labels are joined along borders.

A mask is a table of tiles (by, r0, c0, height, width, mask: the tile's pixels row by row), however the raster was cut. A kernel labels each
tile; only its border pixels, with their labels, meet those of its neighbours. These links are a graph of labels, a small share of the
pixels, whose components are found by hooking to the smallest neighbour and jumping to its label. Results are those of the whole raster
for any cut. Rasters without pixels have no tiles; a NULL mask or pixel counts as false. Joins are by sort: files of labels are far smaller than
the labels in memory, and Spark would send them to the driver by the files' size in every round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.kernels import labelled
from strandline.tables import Rounds

def tiled(scenes: DataFrame, by: list[str], mask: str, size: int) -> DataFrame:
    """by, r0, c0, height, width, mask: whole scenes (by, height, width, mask) cut into squares of `size` pixels and what is left over."""
    corner = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1, F.lit(size)))
    own = scenes.where("height > 0 AND width > 0").select(*by, "height", "width", F.col(mask).alias("_m"), corner("height").alias("r0")).withColumn("c0", corner("width"))
    rows, cols = F.least(F.lit(size), F.col("height") - F.col("r0")), F.least(F.lit(size), F.col("width") - F.col("c0"))
    cut = F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), lambda k: F.slice("_m", (F.col("r0") + k) * F.col("width") + F.col("c0") + 1, cols)))
    # in one select, the lambda would take `width` for the new column of that name
    return own.select(*by, "r0", "c0", rows.alias("_rows"), cols.alias("_cols"), cut.alias("mask")).withColumnsRenamed({"_rows": "height", "_cols": "width"})


def _labels(tiles: DataFrame, by: list[str], diagonal: bool) -> DataFrame:
    """tiles with `parts`: each pixel's part in its tile, 0 outside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for mask, h, w in zip(batch["mask"], batch["height"].to_pylist(), batch["width"].to_pylist(), strict=True):
                own = mask.values.fill_null(False).to_numpy(zero_copy_only=False) if mask.is_valid else np.zeros(h * w, bool)
                made.append(labelled(own.reshape(h, w), diagonal).ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.int32()))], [*batch.schema.names, "parts"])

    own = tiles.select(*by, "r0", "c0", "height", "width", "mask")
    return own.mapInArrow(run, own.select("*", F.lit(None).cast("array<int>").alias("parts")).schema)


def _border(labels: DataFrame, by: list[str]) -> DataFrame:
    """by, r, c and node of the border pixels of tiles that are in a part."""
    k = F.col("_k")
    edge = lambda at, n: (at == 0) | (at == n - 1)
    r, c = F.floor(k / F.col("width")).cast("int"), (k % F.col("width")).cast("int")
    flat = labels.select(*by, "r0", "c0", "height", "width", F.posexplode("parts").alias("_k", "_part")).where("_part > 0")
    flat = flat.where(edge(r, F.col("height")) | edge(c, F.col("width")))
    return flat.select(*by, (F.col("r0") + r).alias("r"), (F.col("c0") + c).alias("c"), F.struct("r0", "c0", F.col("_part").alias("part")).alias("node"))


def _components(links: DataFrame, by: list[str], rounds: Rounds) -> DataFrame:
    """by, node, root (the smallest node reachable) of the nodes in links (by, a, b)."""
    both = rounds.table(links.unionByName(links.select(*by, F.col("a").alias("b"), F.col("b").alias("a"))).distinct(), "links")
    roots = rounds.table(both.groupBy(*by, F.col("a").alias("node")).agg(F.min("b").alias("_low")).select(*by, "node", F.least("node", "_low").alias("root")), "roots")
    while True:
        near = both.join(roots.select(*by, F.col("node").alias("b"), "root").hint("merge"), [*by, "b"]).groupBy(*by, F.col("a").alias("node")).agg(F.min("root").alias("_near"))
        hooked = roots.join(near.hint("merge"), [*by, "node"]).select(*by, "node", F.col("root").alias("_old"), F.least("root", "_near").alias("root"))
        jump = roots.select(*by, F.col("node").alias("root"), F.col("root").alias("_further"))
        jumped = hooked.join(jump.hint("merge"), [*by, "root"], "left").select(*by, "node", "_old", F.coalesce(F.least("root", "_further"), "root").alias("root"))
        made = rounds.table(jumped, "roots")
        roots = made.select(*by, "node", "root")
        if not made.where("_old <> root").limit(1).count():
            return roots


def connected(tiles: DataFrame, by: list[str], diagonal: bool = False) -> DataFrame:
    """tiles with `parts` (numbers of the tile's own parts by pixel, 0 outside) and `roots`: for each of these numbers, in order, the part of the
    whole raster that it belongs to and that part's number of pixels. Jobs run when this is called; each round is a table in the shared folder."""
    rounds = Rounds(tiles.sparkSession)
    labels = rounds.table(_labels(tiles, by, diagonal), "labels")
    border = rounds.table(_border(labels, by), "border")
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    moved = border.select(*by, "r", "c", F.col("node").alias("a"), F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps))).alias("_d"))
    moved = moved.select(*by, (F.col("r") + F.col("_d.r")).alias("r"), (F.col("c") + F.col("_d.c")).alias("c"), "a")
    links = moved.join(border.select(*by, "r", "c", F.col("node").alias("b")).hint("merge"), [*by, "r", "c"]).where("a <> b").select(*by, "a", "b").distinct()
    roots = _components(links, by, rounds)
    sizes = labels.select(*by, "r0", "c0", F.explode("parts").alias("part")).where("part > 0").groupBy(*by, "r0", "c0", "part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*by, F.struct("r0", "c0", "part").alias("node"), "_n").join(roots.hint("merge"), [*by, "node"], "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rounds.table(sizes, "sizes")
    whole = sizes.groupBy(*by, "root").agg(F.sum("_n").alias("pixels"))
    of = sizes.join(whole.hint("merge"), [*by, "root"]).select(*by, F.col("node.r0").alias("r0"), F.col("node.c0").alias("c0"), F.struct(F.col("node.part").alias("part"), "root", "pixels").alias("_x"))
    of = of.groupBy(*by, "r0", "c0").agg(F.sort_array(F.collect_list("_x")).alias("roots"))  # a row for each part of a tile
    return labels.join(of.hint("merge"), [*by, "r0", "c0"], "left").withColumn("roots", F.coalesce("roots", F.array().cast(of.schema["roots"].dataType)))


def _where(parts: DataFrame, keep) -> DataFrame:
    """parts with `mask` true on the pixels of roots that `keep`."""
    good = F.transform("roots", keep)
    return parts.withColumn("_good", good).withColumn("mask", F.transform("parts", lambda p: F.coalesce((p > 0) & F.get("_good", p - 1), F.lit(False)))).drop("_good", "parts", "roots")


def without_small(tiles: DataFrame, by: list[str], least: int, diagonal: bool = False) -> DataFrame:
    """tiles whose mask has no parts of fewer than `least` pixels of the whole raster any more."""
    return _where(connected(tiles, by, diagonal), lambda x: x["pixels"] >= least)


def flooded(tiles: DataFrame, seeds: DataFrame, by: list[str]) -> DataFrame:
    """tiles whose mask is the part (diagonals count) around the seed (by, r, c) of each raster; nothing where the seed is outside of the mask
    or there is none. `mask` says which pixels are like the seed."""
    parts = connected(tiles, by, True)
    inside = seeds.select(*by, F.col("r").alias("_r"), F.col("c").alias("_c"))
    at = (F.col("_r") - F.col("r0")) * F.col("width") + F.col("_c") - F.col("c0")
    here = F.col("_r").between(F.col("r0"), F.col("r0") + F.col("height") - 1) & F.col("_c").between(F.col("c0"), F.col("c0") + F.col("width") - 1)
    own = parts.join(inside, by).where(here).withColumn("_part", F.get("parts", at.cast("int"))).where("_part > 0")
    root = own.select(*by, F.get("roots", F.col("_part") - 1)["root"].alias("_root")).dropDuplicates(by)
    return _where(parts.join(root, by, "left"), lambda x: x["root"] == F.col("_root")).drop("_root")
