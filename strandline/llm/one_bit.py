"""Operator 11: approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are filed in lists by their nearest centroid. What is left of a vector after its centroid is turned by a random rotation and
kept as the signs of its components, a bit each, with three scalars: its length, how much of it lies along its signs, and the signs'
product with the centroid. Signs and scalars give an unbiased estimate of its inner product with a query, and so of their distance,
with an error whose bound is BOUND standard deviations. Codes are BITS long at least (shorter vectors are filled up with zeros before
they are turned), as the bound narrows with the root of the length.

A first search goes through the FIRST lists nearest to a query and takes the exact distances of the best estimates; the (k + 1)-th is a
radius. The second goes to every list that the radius doesn't rule out by the triangle inequality, and chooses those vectors
whose least distance within the error bound isn't beyond the radius. Their exact distances decide. So a neighbour is missed only where
an estimate is off by more than BOUND deviations: the recall of tests and of the tables here is 1.

Equal vectors are one entry of the index with their k + 1 smallest ids, which is all that any query can ask of them; queries with equal
vectors are searched once. Centroids are fitted on a bounded sample (SAMPLE rows), every row is indexed. Entries and queries are dealt in blocks
(about BLOCK and GROUP of them, by hash), and a task searches pairs of these, so codes are shipped once for each group of queries.

Results: vectors that are null, zero or hold null or non-finite components, and rows without an id, take no part; shorter vectors count
as filled up with zeros; of rows that share an id the smallest vector counts; fewer than k others give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.shared import removed, shared_folder, written
from strandline.llm.top_k import _distances, fit_pivots

SAMPLE, FIRST, BLOCK, GROUP = 4096, 8, 8192, 512
BITS, BOUND = 512, 4.0
CODE = "list int, code binary, length double, along double, shift double"


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal length, in doubles; shorter ones are filled up with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten()).astype(np.float64)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(dim: int) -> np.ndarray:
    """A random rotation's first columns, one for each component; the same for every run."""
    bits = -(-max(BITS, dim) // 8) * 8
    return np.linalg.qr(np.random.default_rng(11).standard_normal((bits, dim)))[0]


def encoded(x: np.ndarray, centroids: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """The list of each row, its packed signs, length, share along its signs and the signs' product with the centroid."""
    own = _distances(x, centroids).argmin(1)
    rest = x - centroids[own]
    length = np.sqrt((rest * rest).sum(1))
    turned = rest @ turn.T
    up, root = turned > 0, np.sqrt(len(turn))
    along = np.divide(np.abs(turned).sum(1) / root, length, out=np.ones(len(x)), where=length > 0)
    signs = np.where(up, 1 / root, -1 / root)
    return own, np.packbits(up, axis=1), length, along, (signs * (centroids @ turn.T)[own]).sum(1)


def signs_of(codes: np.ndarray) -> np.ndarray:
    bits = codes.shape[1] * 8
    return (np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(bits))


def estimates(q: np.ndarray, centroid: np.ndarray, turn: np.ndarray, signs: np.ndarray, length: np.ndarray, along: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of queries to coded vectors of a list, and the least that they can be within the error bound."""
    away = np.sqrt(((q - centroid) ** 2).sum(1))[:, None]
    inner = (q @ turn.T).astype(np.float32) @ signs.T - shift
    squared = length**2 + away**2 - 2 * length / along * inner
    spread = np.sqrt(np.maximum(1 - along**2, 0)) / along / np.sqrt(len(turn) - 1)
    least = squared - 2 * length * away * BOUND * spread - 1e-5 * (length + away + np.abs(shift)) ** 2
    return squared, np.maximum(least, (away - length) ** 2 * (1 - 1e-9))


def distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double"), F.lit(0.0)) - F.coalesce(y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, d: s + d * d))


class Index:
    """The entries (row, v, ids) of a table of vectors and their codes in blocks, all in the shared folder."""

    def __init__(self, vectors: DataFrame, key: str, vector: str, keep: int):
        spark, self.keep = vectors.sparkSession, keep
        self.folder = shared_folder(spark)
        good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
        rows = vectors.where(F.col(key).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
        self.rows = written(rows.groupBy("vec_id").agg(F.min("v").alias("v")), self.folder, "rows")
        first = self.rows.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= keep)
        entries = first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("row", F.monotonically_increasing_id())
        self.entries = written(entries, self.folder, "entries")
        self.n, self.dim = self.entries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
        if not self.n:
            return
        share = min(1.0, SAMPLE / self.n)
        sample = self.entries.where(F.pmod(F.xxhash64(F.lit("centroid"), "row"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * SAMPLE).collect() or self.entries.select("v").limit(1).collect()
        x = np.zeros((len(sample), self.dim))
        for i, r in enumerate(sample):
            x[i, : len(r["v"])] = r["v"]
        self.centroids = fit_pivots(x, int(min(len(x), max(1, min(256, round(self.n**0.5 / 4))))))
        centroids, dim = self.centroids, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn = rotation(dim)
            for batch in batches:
                own, codes, *scalars = encoded(matrix(batch["v"], dim), centroids, turn)
                yield pa.RecordBatch.from_arrays([batch["row"], pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, scalars)], ["row", *(x.split()[0] for x in CODE.split(", "))])

        codes = written(self.entries.select("row", "v").mapInArrow(run, f"row long, {CODE}"), self.folder, "codes")
        lists = codes.groupBy("list").agg(F.count(F.lit(1)).alias("rows"), F.max("length").alias("radius")).collect()  # a row for each of at most 256
        self.parts = {r["list"]: -(-r["rows"] // BLOCK) for r in lists}
        self.radius = {r["list"]: r["radius"] for r in lists}
        part = F.pmod(F.xxhash64("row"), F.element_at(F.create_map(*(F.lit(y) for x in self.parts.items() for y in x)), F.col("list")))
        blocks = codes.withColumn("block", F.col("list").cast("long") * (1 << 32) + part).groupBy("block").agg(F.collect_list(F.struct("row", "code", "length", "along", "shift")).alias("codes"))
        self.blocks = written(blocks, self.folder, "blocks")
        removed(spark, self.folder, "codes")

    def groups(self, asked: DataFrame) -> DataFrame:
        """grp, queries: asked (query, v, radius) by nearest centroid, about GROUP at once."""
        centroids, dim = self.centroids, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_distances(matrix(batch["v"], dim), centroids).argmin(1), pa.int64())], [*batch.schema.names, "list"])

        near = asked.mapInArrow(run, asked.select("*", F.lit(0).cast("long").alias("list")).schema)
        salts = asked.count() // GROUP + 1
        return near.groupBy("list", F.pmod(F.xxhash64("query"), F.lit(salts)).alias("salt")).agg(F.collect_list(F.struct("query", "v", "radius")).alias("queries")).select((F.col("list") * salts + F.col("salt")).alias("grp"), "queries")

    def visits(self, groups: DataFrame, first: bool) -> DataFrame:
        """grp, block: where a group's queries have to look."""
        centroids, dim, parts, reach = self.centroids, self.dim, self.parts, self.radius

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            radii = np.array([reach.get(c, -np.inf) for c in range(len(centroids))])
            for batch in batches:
                for g, asked in zip(batch["grp"].to_pylist(), batch["queries"], strict=True):
                    away = _distances(matrix(asked.values.field("v"), dim), centroids)
                    if first:
                        lists = np.argsort(np.where(np.isfinite(radii), away, np.inf), axis=1, kind="stable")[:, :FIRST]
                    else:
                        radius = asked.values.field("radius").to_numpy(zero_copy_only=False)[:, None]
                        lists = np.nonzero(((away - radii) * (1 - 1e-9) <= radius) & np.isfinite(radii))[1]
                    blocks = [(c << 32) + p for c in np.unique(lists).tolist() if c in parts for p in range(parts[c])]
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(blocks), pa.int64()), pa.array(blocks, pa.int64())], ["grp", "block"])

        return groups.mapInArrow(run, "grp long, block long")

    def candidates(self, groups: DataFrame, first: bool) -> DataFrame:
        """query, row: of each block the keep best estimates, or those that may lie within the query's radius."""
        centroids, dim, keep = self.centroids, self.dim, self.keep

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn = rotation(dim)
            for batch in batches:
                for block, asked, coded in zip(batch["block"].to_pylist(), batch["queries"], batch["codes"], strict=True):
                    queries, codes = asked.values, coded.values
                    q, ids, rows = matrix(queries.field("v"), dim), np.asarray(queries.field("query")), np.asarray(codes.field("row"))
                    radius = queries.field("radius").to_numpy(zero_copy_only=False)
                    signs = signs_of(np.frombuffer(b"".join(codes.field("code").to_pylist()), np.uint8).reshape(len(rows), -1))
                    scalars = [np.asarray(codes.field(c)) for c in ("length", "along", "shift")]
                    for a in range(0, len(q), 64):
                        squared, least = estimates(q[a : a + 64], centroids[block >> 32], turn, signs, *scalars)
                        if first:
                            at = np.argpartition(squared, min(keep, len(rows)) - 1, axis=1)[:, :keep]
                            i, j = np.repeat(np.arange(len(at)), at.shape[1]), at.ravel()
                        else:
                            i, j = np.nonzero(least <= radius[a : a + 64, None] ** 2 * (1 + 1e-9))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a + i]), pa.array(rows[j]), pa.array(squared[i, j].astype(np.float64))], ["query", "row", "squared"])

        met = self.visits(groups, first).join(groups, "grp").join(self.blocks, "block").select("block", "queries", "codes")
        return met.mapInArrow(run, "query long, row long, squared double")

    def exact(self, pairs: DataFrame) -> DataFrame:
        """query, row, ids, score of pairs (query, row)."""
        other = self.entries.select(F.col("row").alias("query"), F.col("v").alias("q"))
        return pairs.join(self.entries, "row").join(other, "query").select("query", "row", "ids", distance("v", "q").alias("score"))

    def nearest(self, asked: DataFrame) -> DataFrame:
        """query, found: the keep nearest (score, vec_id) of entries asked (query, v), in order."""
        wide = asked.select("query", "v", F.lit(float("inf")).alias("radius"))
        guess = self.candidates(self.groups(wide), True)
        guess = guess.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("squared", "row"))).where(F.col("place") <= 2 * self.keep)
        near = self.exact(guess.select("query", "row")).withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("score", "row")))
        radius = written(near.where(F.col("place") == self.keep).select("query", F.col("score").alias("radius")), self.folder, "radius")
        known = asked.join(radius, "query", "left").select("query", "v", F.coalesce("radius", F.lit(float("inf"))).alias("radius"))
        chosen = self.exact(self.candidates(written(self.groups(known), self.folder, "groups"), False).select("query", "row"))
        best = chosen.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("score", F.col("ids")[0]))).where(F.col("place") <= self.keep)
        each = best.select("query", F.explode(F.transform("ids", lambda i: F.struct(F.col("score").alias("score"), i.alias("vec_id")))).alias("x"))
        return each.groupBy("query").agg(F.slice(F.array_sort(F.collect_list("x")), 1, self.keep).alias("found"))  # keep entries of keep ids at most


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of all other rows for each row with is_query (a column over vec_id)."""
    index = Index(vectors, key, vector, k + 1)
    if not index.n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = index.rows.where(is_query).join(index.entries.select("v", "row"), "v").select(F.col("vec_id").alias("query_id"), F.col("row").alias("query"))
    queries = written(queries, index.folder, "queries")
    asked = index.entries.join(queries.select(F.col("query").alias("row")).distinct(), "row").select(F.col("row").alias("query"), "v")
    found = queries.join(index.nearest(asked), "query").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return found.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
