"""Operator 10: exact top-k search by inner product with a pivot-distance index.

Vectors are lifted by one component, sqrt(M^2 - |x|^2) with M the largest norm, so that the largest inner product is the smallest
Euclidean distance. The index keys each vector by its nearest pivot and its distance to it; the distances of a pivot are cut into
sorted annuli, of which a table of (pivot, nearest, farthest) is kept. A query at distance d from a pivot can't be nearer to an
annulus than max(d - farthest, nearest - d, 0). It first visits the FIRST annuli of the smallest such bounds; its k-th score there
gives a radius, and then it goes to those others whose bound isn't beyond it: the rest can't hold a better vector.

Pivots are fitted on a bounded sample (SAMPLE rows); every vector is indexed and every bound is exact up to a slack for rounding.
Blocks are parts of annuli of about BLOCK rows, 2 * BLOCK at most on average (parted by a hash), and the visits to a block are dealt in
salts of about VISITS, so no task gets more at once. The table of annuli has at most 64 rows for each of at most 256 pivots, whatever
the data's size; queries are never collected.
Results: vectors that are null or hold null or non-finite components, and rows without an id, take no part; shorter vectors count
as filled up with zeros; ties go to the smaller id; fewer than k others give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.shared import removed, shared_folder, written

SAMPLE, BLOCK, FIRST = 4096, 2048, 3
#: Visits to a block that are searched together, about.
VISITS = 65_536


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def taking_part(df: DataFrame, key: str, vector: str, scale: bool) -> DataFrame:
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    made = integers(F.col(vector)) if scale else F.col(vector).cast("array<long>")
    return df.where(F.col(key).isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), made.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal length; shorter ones are filled up with zeros."""
    offsets = np.asarray(column.offsets)
    flat, sizes = np.asarray(column.values)[offsets[0] : offsets[-1]], np.diff(offsets)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where these can't round."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def lifted(v: np.ndarray, norm: float) -> np.ndarray:
    x = v.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(norm - (x * x).sum(1), 0))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))


def fit_pivots(sample: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    pivots = sample[np.linspace(0, len(sample) - 1, count).astype(int)]
    for _ in range(rounds):
        nearest = _distances(sample, pivots).argmin(1)
        sums, sizes = np.zeros_like(pivots), np.bincount(nearest, minlength=count)
        np.add.at(sums, nearest, sample)
        pivots = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], pivots)
    return pivots


def _visits(queries: DataFrame, annuli: list, pivots: np.ndarray, norm: float, dim: int, again: bool) -> DataFrame:
    """query_id, v, least, block: the blocks that each query goes to (first, or again with its k-th score in `least`)."""
    pivot, low, high = (np.array([r[c] for r in annuli]) for c in ("pivot", "low", "high"))
    names = [r["annulus"] for r in annuli]
    parts = [r["parts"] for r in annuli]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch["v"], dim)
            x = np.column_stack([v.astype(np.float64), np.zeros(len(v))])
            rows, blocks = [], []
            for start in range(0, len(v), 64):
                d = _distances(x[start : start + 64], pivots)[:, pivot]
                bound = np.maximum(np.maximum(d - high, low - d), 0)
                order = np.argsort(bound, axis=1, kind="stable")
                for i, ranked in enumerate(order):
                    at = start + i
                    if again:
                        least = batch["least"][at].as_py()
                        reach = np.inf if least is None else np.sqrt(max(0.0, float((x[at] ** 2).sum()) + norm - 2.0 * least))
                        rest = ranked[FIRST:]
                        chosen = rest[bound[i, rest] <= reach * (1 + 1e-9) + 1e-4 * (1 + np.sqrt(norm))]
                    else:
                        chosen = ranked[:FIRST]
                    for c in chosen.tolist():
                        for part in range(parts[c]):
                            rows.append(at)
                            blocks.append((names[c] << 20) + part)
            out = batch.select(["query_id", "v", "least"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(blocks, pa.int64())], ["query_id", "v", "least", "block"])

    return queries.mapInArrow(run, "query_id long, v array<long>, least long, block long")


def _searched(visits: DataFrame, index: DataFrame, k: int, dim: int, salts: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each visited block, those of `least` and more only."""
    group = (F.col("block") * salts + F.pmod(F.xxhash64("query_id"), F.lit(salts))).alias("group")
    visits = visits.select(group, "block", F.lit(1).alias("kind"), F.col("query_id").alias("vec_id"), "v", "least")
    rows = index.join(visits.select("block", "group").distinct(), "block")
    rows = rows.select("group", F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("long").alias("least"))
    both = rows.union(visits.drop("block")).withColumnRenamed("group", "block")
    both = both.repartition("block").sortWithinPartitions("block", "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vectors = None, [], []
        for batch in batches:
            own, kinds, all_ids = batch["block"].to_numpy(), batch["kind"].to_numpy(), batch["vec_id"].to_numpy()
            if not len(own):
                continue
            v = _matrix(batch["v"], dim)
            least = batch["least"].to_pylist()
            cuts = [0, *(np.flatnonzero((np.diff(own) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if block != own[a]:
                    block, ids, vectors = own[a], [], []
                if kinds[a] == 0:
                    ids.append(all_ids[a:b])
                    vectors.append(v[a:b])
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                out: list[tuple[int, int, int]] = []
                for start in range(a, b, 64):
                    scores = _products(v[start : min(b, start + 64)], vectors[0])
                    for i, row in enumerate(scores):
                        query = all_ids[start + i]
                        floor = least[start + i]
                        good = ids[0] != query
                        if floor is not None:
                            good &= row >= floor
                        at = np.flatnonzero(good)
                        if len(at) > k:
                            at = at[row[at] >= np.partition(row[at], len(at) - k)[len(at) - k]]
                        at = at[np.argsort(-row[at], kind="stable")][:k]  # ids ascend, so ties go to the smaller
                        out += [(query, ids[0][j], row[j]) for j in at]
                if out:
                    q, c, s = (np.array(x, np.int64) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(s)], ["query_id", "vec_id", "score"])

    return both.mapInArrow(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row with is_query (a column over vec_id)."""
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    rows = written(taking_part(vectors, key, vector, scale), folder, "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, norm, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(squares), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    share = min(1.0, SAMPLE / n)
    sample = rows.where(F.pmod(F.xxhash64(F.lit("pivot"), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("vec_id").limit(2 * SAMPLE).collect() or rows.limit(1).collect()
    x = np.zeros((len(sample), dim), np.int64)
    for i, r in enumerate(sample):
        x[i, : len(r["v"])] = r["v"]
    x = lifted(x, norm)
    pivots = fit_pivots(x, int(min(len(x), max(4, min(256, round(n**0.5 / 4))))))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(lifted(_matrix(batch["v"], dim), norm), pivots)
                nearest = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32()), pa.array(d[np.arange(len(d)), nearest])], ["vec_id", "v", "pivot", "distance"])

    placed = written(rows.mapInArrow(keyed, "vec_id long, v array<long>, pivot int, distance double"), folder, "keyed")
    cuts = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx("distance", [i / 64 for i in range(1, 64)], 1000).alias("cuts"))
    edges = cuts.select("pivot", F.least(F.lit(64), F.ceil(F.col("rows") / BLOCK)).cast("int").alias("wanted"), "cuts")
    edges = edges.select("pivot", F.array_distinct(F.filter("cuts", lambda c, i: F.floor((i + 1) * F.col("wanted") / 64) > F.floor(i * F.col("wanted") / 64))).alias("cuts"))
    ring = F.size(F.filter("cuts", lambda c: c <= F.col("distance")))
    ringed = placed.join(F.broadcast(edges), "pivot").withColumn("annulus", (F.col("pivot") * 64 + ring).cast("long")).drop("cuts")  # a row for each pivot, 256 at most
    table = ringed.groupBy("annulus", "pivot").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count(F.lit(1)).alias("rows"))
    table = table.withColumn("parts", F.ceil(F.col("rows") / (2 * BLOCK)).cast("int"))
    annuli = table.orderBy("annulus").collect()  # at most 64 for each of at most 256 pivots
    parts = spark.createDataFrame([(r["annulus"], r["parts"]) for r in annuli], "annulus long, parts int")
    index = ringed.join(F.broadcast(parts), "annulus").select("vec_id", "v", (F.col("annulus") * (1 << 20) + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("block"))
    index = written(index, folder, "index")
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v", F.lit(None).cast("long").alias("least")).dropDuplicates(["query_id"])
    salts = queries.count() // VISITS + 1
    first = written(_best(_searched(_visits(queries, annuli, pivots, norm, dim, False), index, k, dim, salts), k), folder, "first")
    least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    known = queries.drop("least").join(least, "query_id", "left").select("query_id", "v", F.col("kth").alias("least"))
    removed(spark, folder, "keyed")
    more = _searched(_visits(known, annuli, pivots, norm, dim, True), index, k, dim, salts)
    return _best(first.select("query_id", "vec_id", "score").union(more), k).select("query_id", "rank", "vec_id", "score")
