"""The next row in ascending order of an id over a whole table, without sorting it in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one bucket, about; quantile buckets at most, which are then cut evenly.
BUCKET_ROWS, QUANTILES = 2000, 500
#: Rows of three numbers that are sent to all executors at most.
BROADCAST_BUCKETS = 200_000


def bucket_of(ids: DataFrame, key: str) -> Column:
    """An ascending bucket number of a long key: quantiles of the table, each cut into equal ranges; nulls come before all."""
    rows = ids.agg(F.count(key)).first()[0]
    wanted = rows // BUCKET_ROWS
    if wanted < 1:
        return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long")
    parts = min(QUANTILES, wanted)
    found = ids.agg(F.percentile_approx(key, [k / parts for k in range(parts + 1)], 10_000).alias("q"), F.min(key), F.max(key)).first()
    cuts = sorted({found[1], *found[0][1:-1]})
    ends = [*cuts[1:], found[2] + 1]
    within = -(-wanted // parts)
    place = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= F.col(key)))
    low = F.element_at(F.array(*(F.lit(c) for c in cuts)), place).cast("double")
    high = F.element_at(F.array(*(F.lit(c) for c in ends)), place).cast("double")
    inner = F.floor((F.col(key).cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * within) if within > 1 else F.lit(0)
    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(place * within + F.least(F.lit(within - 1), inner)).cast("long")


def with_next(df: DataFrame, key: str, tie: str, values: list[str], derive: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """derive(df) with next_<value> of the row that follows in order of (key, tie); the first row follows the last.

    Rows are dealt once by bucket. The first row of the next bucket joins each bucket as its end, so no bucket looks beyond itself.
    """
    bucketed = df.withColumn("_bucket", bucket_of(df.select(key), key))
    first = bucketed.groupBy("_bucket").agg(F.min(key).alias("_first"))
    ordered = Window.orderBy("_bucket")  # a row for each bucket
    start = first.agg(F.min("_bucket")).first()[0]
    if start is None:
        made = derive(df)
        return made.select("*", *(F.col(v).alias(f"next_{v}") for v in values))
    follows = first.select("_bucket", "_first", F.lag("_bucket").over(ordered).alias("_before"))
    last, buckets = first.agg(F.max("_bucket"), F.count(F.lit(1))).first()
    follows = follows.select(F.col("_bucket").alias("_own"), "_first", F.coalesce("_before", F.lit(last)).alias("_before"))
    follows = F.broadcast(follows) if buckets <= BROADCAST_BUCKETS else follows
    # heads are picked before anything is derived from texts
    heads = bucketed.join(follows, (F.col("_bucket") == F.col("_own")) & bucketed[key].eqNullSafe(F.col("_first")))
    heads = heads.groupBy(F.col("_before").alias("_bucket")).agg(F.min_by(F.struct(*df.columns), F.struct(F.col(tie).isNotNull(), tie)).alias("_head"))
    heads = heads.select("_bucket", F.lit(1).alias("_end"), "_head.*")
    rows = derive(bucketed.withColumn("_end", F.lit(0)).unionByName(heads))
    order = Window.partitionBy("_bucket").orderBy("_end", F.col(key).asc_nulls_first(), F.col(tie).asc_nulls_first())
    led = rows.withColumn("_next", F.lead(F.struct(*values)).over(order)).where("_end = 0")
    return led.select(*(c for c in rows.columns if c not in ("_bucket", "_end")), *(F.col(f"_next.{v}").alias(f"next_{v}") for v in values))
