"""Operator 13: the trie of conversations' prefixes, built as a Patricia trie.

A turn is a fixed-width key: the MD5 of its role and text, and the text's number of code points. A conversation is the string of its
turns' keys, so prefixes of turns are prefixes of strings. Equal conversations are put together first; the distinct ones are sorted
by ranges. A task goes through its sorted part with a stack, on which the longest common prefix of neighbours makes points only: where
paths branch, where a conversation ends, and leaves. What a point gathers is additive over the conversations below it (members, leaves,
children, code points of members and of distinct nodes), so points that lie across parts are summed up by key. For that all parts must
cut their edges at the same depths: a first pass gives the points on the paths of a part's first and last conversation, and a sweep
over these (a row for each part) the depths at which other parts cut them. At last each edge is expanded into its unary nodes: these
have the members, leaves and saved code points of the point below, and the edge's suffix sums on top.

The ids of the conversations that end at a node are sorted by ranges and joined into pieces of PIECE ids before a node's pieces meet, in
order and one by one, in the digest. A conversation's keys (48 bytes a turn) are one row; that is the only thing whose size isn't bounded here.

Results: rows without conv_id take no part. Turns are ordered by turn (null first), then by the key, so that ties have an order;
equal rows are turns each. c - c % 100 is by truncating division, so negative ids go up. An empty table has no nodes, not even a root.
Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import removed, shared_folder, written

#: Hexadecimal digits of a turn's key: MD5 and code points.
DIGEST, KEY = 32, 48
#: Distinct conversations of a sorted part, about; ids of a piece at most.
PART, PIECE = 20_000, 8192
#: Turns that may come from the first conversation of the hundred: h is below this.
SHARED = 6

POINT = "key string, depth long, parent string, edge array<long>, n_convs long, low long, n_leaves long, n_children long, below long, nodes long"


def turn_key(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.concat(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")), F.lower(F.lpad(F.hex(F.char_length(text).cast("long")), KEY - DIGEST, "0")))


def rebuilt(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, path: the keys of the first h turns of the hundred's first conversation and of the own turns after the first h."""
    rows = conversations.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), turn_key(F.col(role), F.col(text)).alias("key")).alias("t"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t"))["key"].alias("turns"))  # nulls come first
    own = own.select("conv_id", "turns", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED)).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    first = rows.where(F.col("conv_id") % 100 == 0).groupBy(F.col("conv_id").alias("base")).agg(F.slice(F.sort_array(F.collect_list("t")), 1, SHARED - 1)["key"].alias("first"))
    both = F.concat(F.slice(F.coalesce("first", F.array().cast("array<string>")), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return own.join(first, "base", "left").select("conv_id", F.array_join(both, "").alias("path"))


@dataclass
class Point:
    """A point on the stack and what the conversations below it, as far as they are in this part, add up to."""

    depth: int
    path: str
    sums: list[int]
    first: int
    last: int
    shared: int  # turns that the first conversation below shares with the one before it
    n: int = 0
    low: int | None = None
    leaves: int = 0
    children: int = 0
    members: int = 0
    distinct: int = 0

    def add(self, other: Point) -> None:
        self.n += other.n
        self.low = other.low if self.low is None else min(self.low, other.low)
        self.leaves += other.leaves
        self.members += other.members
        self.distinct += other.distinct
        self.last = other.last

    def row(self, above: int) -> tuple:
        """`below`: code points of members' turns below the point; `nodes`: those of distinct nodes below. `edge`: suffix sums of the code
        points of the edge's turns, the point's own first; one part only has it."""
        begins = self.shared < self.depth
        own = self.sums[self.depth]
        nodes = self.distinct - (own - self.sums[self.shared] if begins else 0)
        edge = [own - self.sums[d] for d in range(self.depth - 1, above - 1, -1)] if begins else None
        return (key_of(self.path, self.depth), self.depth, key_of(self.path, above) if self.depth else None, edge, self.n, self.low, self.leaves, self.children, self.members - self.n * own, nodes)


def key_of(path: str, depth: int) -> str:
    return hashlib.md5(path[: KEY * depth].encode()).hexdigest()


def common(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b])) // KEY


def points(rows: list[tuple[str, int, int]], before: str | None, after: str | None, left: list[int], right: list[int]) -> list[tuple[Point, int]]:
    """The points of sorted (path, members, smallest id), each with its parent's depth, deepest first.

    `before` and `after` are the neighbours' paths; `left` and `right` the depths at which other parts cut the first and the last path.
    """
    stack: list[Point] = []
    done: list[tuple[Point, int]] = []

    def close(depth: int) -> None:
        while stack[-1].depth > depth:
            p = stack.pop()
            if stack[-1].depth < depth:
                stack.append(Point(depth, p.path, p.sums, p.first, p.last, p.shared))
            stack[-1].add(p)
            stack[-1].children += p.shared <= stack[-1].depth
            done.append((p, stack[-1].depth))

    for i, (path, n, low) in enumerate(rows):
        length = len(path) // KEY
        sums = [0]
        for d in range(length):
            sums.append(sums[-1] + int(path[KEY * d + DIGEST : KEY * (d + 1)], 16))
        previous, following = rows[i - 1][0] if i else before, rows[i + 1][0] if i + 1 < len(rows) else after
        shared = common(previous, path) if previous is not None else 0
        if i:
            close(shared)
        for depth in [length] if i else sorted({0, length, *left}):
            if not stack or stack[-1].depth < depth:
                stack.append(Point(depth, path, sums, i, i, shared))
        leaf = following is None or common(path, following) < length
        stack[-1].add(Point(length, path, sums, i, i, shared, n, low, int(leaf), 0, n * sums[-1], sums[-1] - sums[shared]))
    for depth in sorted({0, *right}, reverse=True):
        close(depth)
    return [*done, (stack[0], 0)]


def _of_part(table: pa.Table) -> list[tuple[str, int, int]]:
    return sorted(zip(*(table[c].to_pylist() for c in ("path", "members", "low")), strict=True))


def cuts(spines: list[tuple[int, str, str, list[int], list[int]]]) -> dict[int, tuple[str | None, str | None, list[int], list[int]]]:
    """For each of the sorted parts (number, first path, last path, depths of the points on either): the paths before and after it and
    the depths at which the parts to its left and right cut its first and last path."""
    out: dict[int, list] = {p: [None, None, [], []] for p, *_ in spines}
    for side, order in ((0, spines), (1, spines[::-1])):
        depths: set[int] = set()
        for (_, *near), (part, *far) in zip(order, order[1:], strict=False):
            left, right = near[1 - side], far[side]
            within = common(near[0], near[1])
            depths = {d for d in depths if d <= within} | set(near[3 - side])
            shared = common(left, right)
            depths = {d for d in depths if d <= shared} | {shared}
            out[part][side], out[part][2 + side] = left, sorted(depths)
    return {p: tuple(x) for p, x in out.items()}


def compressed(paths: DataFrame, folder: str) -> DataFrame:
    """The points of the trie of paths (path, members, low), by POINT's columns."""
    spark = paths.sparkSession
    wanted = paths.count() // PART + 1
    placed = paths.repartitionByRange(wanted, "path").withColumn("part", F.spark_partition_id()) if wanted > 1 else paths.withColumn("part", F.lit(0))
    placed = written(placed, folder, "sorted")

    def spine(table: pa.Table) -> pa.Table:
        rows = _of_part(table)
        found = points(rows, None, None, [], [])
        at = [sorted(p.depth for p, _ in found if (p.first == 0, p.last == len(rows) - 1)[side]) for side in (0, 1)]
        return pa.table({"part": table["part"][:1], "a": [rows[0][0]], "z": [rows[-1][0]], "left": pa.array([at[0]], pa.list_(pa.int64())), "right": pa.array([at[1]], pa.list_(pa.int64()))})

    if wanted > 1:
        spines = [tuple(r) for r in placed.groupBy("part").applyInArrow(spine, "part int, a string, z string, left array<long>, right array<long>").orderBy("a").collect()]  # a row for each part
        cut = cuts(spines)
    else:
        cut = {0: (None, None, [], [])}

    def build(table: pa.Table) -> pa.Table:
        made = [p.row(above) for p, above in points(_of_part(table), *cut[table["part"][0].as_py()])]
        names = [x.split()[0] for x in POINT.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), *[pa.int64()] * 6]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

    found = placed.groupBy("part").applyInArrow(build, POINT)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "n_children", "below", "nodes")]
    return found.groupBy("key", "depth", "parent").agg(*sums, F.min("low").alias("conv_id"), F.max("edge").alias("edge"))


def digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of ends (key, conv_id): the ids of a key in order, joined by commas. Ids are joined into pieces first, where they lie."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["key", "first", "ids"])

        for batch in batches:
            for k, i in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
                if ids and (k != key or len(ids) == PIECE):
                    yield piece()
                    ids = []
                key = k
                ids.append(i)
        if ids:
            yield piece()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        out: list[tuple[str, str]] = []
        for batch in batches:
            for k, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if k != key:
                    if sha:
                        out.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["key", "ends_sha256"])
                out = []
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])

    # a key's pieces of two tasks don't overlap, as ids are dealt by ranges
    cut = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pieces, "key string, first long, ids string")
    return cut.repartition("key").sortWithinPartitions("key", "first").mapInArrow(joined, "key string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    folder = shared_folder(conversations.sparkSession)
    ends = written(rebuilt(conversations, key, turn, role, text), folder, "rebuilt")
    paths = ends.groupBy("path").agg(F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("low"))
    tree = written(compressed(paths, folder), folder, "points")
    removed(conversations.sparkSession, folder, "sorted")
    above = tree.select(F.col("key").alias("parent"), F.col("conv_id").alias("above_conv_id"), F.col("depth").alias("above_depth"))
    tree = tree.join(above, "parent", "left").join(digests(ends.select(F.md5(F.col("path").cast("binary")).alias("key"), "conv_id")), "key", "left")
    # place 0 is the point itself, place k the node k turns above it
    nodes = tree.select("*", F.posexplode(F.coalesce("edge", F.array(F.lit(0).cast("long")))).alias("up", "own"))  # the root has no edge
    point, top = F.col("up") == 0, F.col("depth") - F.col("up") - 1 == F.col("above_depth")
    return nodes.select(
        "conv_id",
        (F.col("depth") - F.col("up")).alias("depth"),
        F.when(top, F.col("above_conv_id")).when(F.col("depth") > 0, F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(point, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("below") - F.col("nodes") + (F.col("n_convs") - 1) * F.col("own")).alias("saved_tokens"),
        F.when(point, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
