"""Operator 6: sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards. At every level each child with weight w, the sum of the weights below it, draws -ln(u) / w from a
hash u of the key and the child's path of names; a key descends to the child with the smallest draw and only there draws again, so its
cost follows the fan-outs of the levels and not the number of shards. A child is taken with a chance in proportion to its weight. Where a
weight changes, draws change on the path to it alone: keys move into or out of the subtrees on that path, and no key moves between
two shards that both lie outside of them. `topology` builds a base tree, filled in order; each shard beyond it is a region of its own, so one
more shard changes no weight of the others and takes rows into itself only.

Results: the key and the number of shards decide alone. A null key is a key like any other; equal keys share a shard and have different
slots; a null text counts as empty, its size is 8 and its crc32 0; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.shared import uniform

#: Rows of one shard that are numbered together.
SLOT_ROWS = 20_000


@dataclass(frozen=True)
class Node:
    """A subtree. Leaves carry a shard's number and weight; the weight of others is the sum below."""

    name: str
    leaf_weight: float = 1.0
    children: tuple[Node, ...] = field(default=())
    shard: int | None = None

    @property
    def weight(self) -> float:
        return self.leaf_weight if self.shard is not None else sum(c.weight for c in self.children)


def topology(shards: int, base: int = 24, racks_a_region: int = 3, shards_a_rack: int = 4) -> Node:
    """`base` equal shards, filled into racks and regions in order, and a region for each further shard."""
    if shards < base:
        raise ValueError(f"the base tree has {base} shards")
    regions: list[Node] = []
    span = racks_a_region * shards_a_rack
    for first in range(0, base, span):
        racks = []
        for start in range(first, min(base, first + span), shards_a_rack):
            leaves = tuple(Node(f"shard{k}", 1.0, (), k) for k in range(start, min(base, first + span, start + shards_a_rack)))
            racks.append(Node(f"rack{start // shards_a_rack}", children=leaves))
        regions.append(Node(f"region{first // span}", children=tuple(racks)))
    regions += [Node(f"region-of-shard{k}", 1.0, (), k) for k in range(base, shards)]
    return Node("root", children=tuple(regions))


def reweighted(tree: Node, shard: int, weight: float) -> Node:
    """The tree with another weight of one shard."""
    if tree.shard is not None:
        return Node(tree.name, weight, (), shard) if tree.shard == shard else tree
    return Node(tree.name, children=tuple(reweighted(c, shard, weight) for c in tree.children))


def descend(key: Column, tree: Node, path: str = "") -> Column:
    """The shard of a key, as one expression without joins: a level's draws are bound by a lambda, and of the level below only those of
    the child that won are computed."""
    if tree.weight <= 0:
        raise ValueError(f"{tree.name} has no weight")
    if tree.shard is not None:
        return F.lit(tree.shard)
    children = [c for c in tree.children if c.weight > 0]
    draw = lambda c: -F.log(uniform(key, f"{path}{tree.name}/{c.name}")) / c.weight
    winner = F.array_min(F.array(*(F.struct(draw(c).alias("draw"), F.lit(k).alias("child")) for k, c in enumerate(children))))["child"]

    def below(chosen: Column) -> Column:
        out = F.lit(None).cast("int")
        for k, c in enumerate(children):
            out = F.when(chosen == k, descend(key, c, f"{path}{tree.name}/")).otherwise(out)
        return out

    return F.get(F.transform(F.array(winner), below), F.lit(0))


def slots(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps.

    A group is parted into bins by a hash of `order`; the bins' sizes, summed up, give each bin its first number. No task gets
    more than about SLOT_ROWS rows of a group (more only if that many share one value of `order`).
    """
    rows = df.count()
    bins = max(1, rows // SLOT_ROWS + 1)
    binned = df.withColumn("_bin", F.pmod(F.xxhash64(F.lit("slot"), F.col(order)), F.lit(bins)).cast("int"))
    sizes = binned.groupBy(group, "_bin").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(group, "_bin", F.coalesce(F.sum("_rows").over(before), F.lit(0)).cast("long").alias("_first"))
    place = F.row_number().over(Window.partitionBy(group, "_bin").orderBy(order, "size", "text_crc32"))
    return binned.withColumn("_place", place - 1).join(firsts, [group, "_bin"]).withColumn(name, (F.col("_first") + F.col("_place")).cast("long")).drop("_bin", "_place", "_first")


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (`key`), shard, slot, grown_shard of every row of docs."""
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(F.encode(raw, "utf-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    shard = lambda n: descend(F.col("doc_id"), topology(n)).cast("int")
    rows = rows.withColumn("shard", shard(shards)).withColumn("grown_shard", shard(shards + 1))
    return slots(rows, "shard", "doc_id", "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
