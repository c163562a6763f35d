"""Operator 4: near-duplicates by SetSketch registers.

Each document's set of word shingles gets m registers: register i is floor(1 - log_b x_i), where x_i is the smallest of
exponentially distributed hashes of its shingles, cut to 0..q+1. Registers of a union are the larger of both (mergeable), and they
agree more often the more alike two sets are. Documents are then found in these steps, each a table or a shuffle by key:

1. documents with the same set are one class, so copies meet in one aggregation only; a class has a number of its own;
2. each class goes into BANDS buckets by ROWS registers each;
3. STAR_ROUNDS times at most, and no further than a round closes a tenth of what is open: every bucket that still has members of several components has one centre, and each class becomes a candidate
   with one centre of another component among its buckets. Candidates whose likeness, estimated from all registers jointly by
   maximum likelihood with the known set sizes, lies far below the threshold go; the rest are confirmed on the full sets of words of
   their texts; components are formed anew. Large groups of copies fall together here with one comparison a member;
4. a bucket whose members have several components even then is searched fully: in blocks of BLOCK members of its largest component and
   BLOCK others, each pair of different components by estimate, then by whole sets of hashes, and those few by their words. A pair that
   is alike beyond doubt joins its components inside the block at once, so a block sends on links that join, not all pairs of a group;
   pairs in doubt are all sent on. A pair is compared in the first bucket it shares alone: were that one closed, both would be of one
   component. Blocks bound memory; nothing is capped.

Buckets and classes of more than a share of 1/HOT of all places or rows (there are HOT of them at most) are salted before joins.

A pair at the threshold of 0.8 shares no bucket with a chance of (1 - 0.8^6)^48 < 5e-7, and less above.
Results: documents without words have an empty set and are linked with nothing; null texts count as empty; each row is found by its own
set, also where rows share an id or have none. component_id is the smallest id of any row of the component, null where none has one;
kept is whether a row's id is that one (both null: true). Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.components import grown_components
from strandline.llm.shared import mixed, removed, shared_folder, shingle_sets, text_batches, written

#: Bands and registers a band; base and largest value of registers (two bytes each), rate of the exponential hashes.
BANDS, ROWS, BASE, LARGEST, RATE = 48, 6, 1.001, 65_534, 20.0
REGISTERS = BANDS * ROWS
BLOCK = 512
#: Pairs of a block whose likelihood is maximised at once, at least.
PAIRS = 8192
STAR_ROUNDS = 3
#: Rounds end when one leaves more than this share of the open places open: what is left then are pairs that aren't alike.
WORTHWHILE = 0.9
#: Rows of three numbers that are sent to all executors at most; more are joined by a shuffle.
BROADCAST_IDS = 250_000
#: Salted buckets or classes at most, and the rows that one has before it is salted at least.
HOT, HOT_ROWS = 65_536, 2048
#: Ids up to here leave room for numbers beyond them.
ROOM = 1 << 62
#: Standard deviations of the estimate below the threshold at which a candidate goes.
MARGIN = 6.0

_SEEDS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_FACTORS = (_SEEDS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def registers(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint16 registers, a row for each non-empty set. `shingles` are hashes; sets lie between consecutive offsets."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    least = np.empty((REGISTERS, len(starts)), np.uint32)
    if not len(starts):
        return np.zeros((0, REGISTERS), np.uint16)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    y = shingles.astype(np.uint32)
    buffer = np.empty_like(x)
    for i in range(REGISTERS):
        # a multiplicative permutation of one half of the hash, shifted by the other half
        np.multiply(x, _FACTORS[i], out=buffer)
        np.bitwise_xor(buffer, y, out=buffer)
        np.minimum.reduceat(buffer, starts, out=least[i])
    x = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LARGEST + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the unions of the sets of a and b."""
    return np.maximum(a, b)


def likeness(greater: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity most likely to give so many registers in which a is greater and less than b, for known sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    equal = REGISTERS - greater - less
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    share = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def chance(j: np.ndarray) -> np.ndarray:
        p, q = share(u - v * j), share(v - u * j)
        return greater * np.log(np.maximum(p, 1e-12)) + less * np.log(np.maximum(q, 1e-12)) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    golden = (np.sqrt(5) - 1) / 2
    for _ in range(30):
        a, b = high - golden * (high - low), low + golden * (high - low)
        left = chance(a) > chance(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def _least_equal(threshold: float) -> float:
    """Registers that agree in every pair that may reach the threshold."""
    return REGISTERS * (threshold - (MARGIN + 1) * np.sqrt(threshold * (1 - threshold) / REGISTERS))


def _alive(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of register rows may reach the threshold."""
    fits = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9
    alive = np.zeros(len(n_a), bool)
    at = np.flatnonzero(fits)
    if len(at):
        spread = np.sqrt(threshold * (1 - threshold) / REGISTERS)
        # registers agree with a chance of the likeness at least: most pairs go by that alone, before the likelihood is maximised
        at = at[np.count_nonzero(a[at] == b[at], axis=1) >= _least_equal(threshold)]
        greater, less = (a[at] > b[at]).sum(1), (a[at] < b[at]).sum(1)
        alive[at] = len(at) and likeness(greater, less, n_a[at].astype(float), n_b[at].astype(float)) >= threshold - MARGIN * spread
    return alive


def sketches(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, of (hash of the text), n (size of the set), set_a and set_b (its hash), regs (registers, null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            shingles, offsets = shingle_sets(batch["text"].to_pylist(), width)
            n = np.diff(offsets)
            sums = [np.zeros(len(n), np.uint64) for _ in range(2)]
            rows: list[bytes | None] = [None] * len(n)
            full = np.flatnonzero(n)
            if len(full):
                starts = offsets[:-1][full]
                for k in range(2):
                    sums[k][full] = np.add.reduceat(mixed(shingles + np.uint64(0xA24BAED4963EE407 * (k + 1) % (1 << 64))), starts)
                regs = registers(shingles, offsets)
                for i, at in enumerate(full.tolist()):
                    rows[at] = regs[i].tobytes()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["of"], pa.array(n, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(rows, pa.binary())], ["doc_id", "of", "n", "set_a", "set_b", "regs"])

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("of"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, of long, n long, set_a long, set_b long, regs binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """rep, band, key: a row for each class and band."""
    bytes_a_band = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(F.col("regs"), k * bytes_a_band + 1, F.lit(bytes_a_band))))
    return classes.select("rep", F.posexplode(keys).alias("band", "key"))


def estimated(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose estimated likeness doesn't rule them out."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
                alive = _alive(a, b, batch["n_a"].to_numpy(), batch["n_b"].to_numpy(), threshold)
                yield batch.select(["a", "b"]).filter(pa.array(alive))

    return both.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |A and B| >= percent * |A or B| on the words of their texts (texts: rep, text)."""
    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[str, frozenset] = {}
            keep, held = [], 0
            for a, b in zip(batch["text_a"], batch["text_b"], strict=True):
                own = []
                for t in (a.as_py(), b.as_py()):
                    if t not in sets:
                        if held > 1 << 19:
                            sets, held = {}, 0
                        sets[t] = word_shingles(t, width)
                        held += len(t)
                    own.append(sets[t])
                common = len(own[0] & own[1])
                keep.append(100 * common >= percent * (len(own[0]) + len(own[1]) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


_LOWER = {k: k + 32 for k in range(65, 91)}
_SPACED = {k: " " for k in range(9, 14)}


def word_shingles(text: str, width: int) -> frozenset:
    """The words themselves: what hashes have found is confirmed on these."""
    words = [w for w in text.translate(_LOWER | _SPACED).split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else frozenset([tuple(words)])


def folded_sets(texts: DataFrame, width: int) -> DataFrame:
    """rep, folded: the sorted shingle hashes of each text (rep, text), cut to 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            shingles, offsets = shingle_sets(batch["text"].to_pylist(), width)
            high = (shingles >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch["rep"], pa.array([np.unique(high[a:b]).tobytes() for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())], ["rep", "folded"])

    return texts.mapInArrow(run, "rep long, folded binary")


def blocks(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a bucket and whose folded sets may reach the threshold, but none whose components have
    been joined by others of the block, from members (key, band, rep, component, n, regs, folded, largest, most, others): whether a member is of its bucket's
    largest component, how many are and how many aren't. A bucket of up to BLOCK members is one block, to which each goes once. Of a larger
    one, the largest component isn't compared within itself, and goes out once for each BLOCK of the others. No pair leaves a block that its whole sets rule out, and each leaves the block of the first band it
    shares, once."""
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    part = F.pmod(F.xxhash64("rep", F.lit("part")), F.when(F.col("largest"), parts("most")).otherwise(parts("others"))).cast("int")
    place = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    each = lambda c, make: F.transform(F.sequence(F.lit(0), parts(c) - 1), make)
    across = F.when(F.col("largest"), each("others", lambda k: place(0, F.col("part"), k)))
    among = F.concat(each("most", lambda k: place(0, k, F.col("part"))), each("others", lambda k: place(1, F.least(F.col("part"), k), F.greatest(F.col("part"), k))))
    alone = F.when(F.col("most") + F.col("others") <= BLOCK, F.array(place(1, F.lit(0), F.lit(0))))
    dealt = members.withColumn("part", part).withColumn("place", F.explode(F.coalesce(alone, across, among)))
    # the side of a member in its block: members of one side aren't compared, unless the block has one side only
    side = F.when(F.col("place.kind") == 0, F.col("largest").cast("int")).otherwise(F.col("part"))
    dealt = dealt.select(F.xxhash64("key", "place.kind", "place.x", "place.y").alias("block"), "band", side.alias("part"), (F.col("place.kind") == 0).alias("across"), "rep", "component", "n", "regs", "folded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            ids = batch["block"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if end == start:
                    continue
                if held and held[0]["block"][0].as_py() != ids[start]:
                    yield from pairs_within(held)
                    held = []
                held.append(batch.slice(start, end - start))
        if held:
            yield from pairs_within(held)

    threshold = percent / 100
    least_equal = _least_equal(threshold)

    def pairs_within(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        band, rep, part, n = (table[c].to_numpy() for c in ("band", "rep", "part", "n"))
        component = table["component"].to_numpy().copy()
        within = not table["across"][0].as_py() and part.min() == part.max()
        regs = np.frombuffer(b"".join(table["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        sets = [np.frombuffer(x, np.uint32) for x in table["folded"].to_pylist()]

        def reaches(i: int, j: int) -> tuple[bool, bool]:
            """Whether a pair may reach the threshold, and whether it does so beyond what folding can change."""
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            doubt = int(n[i] - len(sets[i]) + n[j] - len(sets[j])) + 1 + int(n[i] * n[j]) // (1 << 30)
            alike = lambda c: 100 * c >= percent * (n[i] + n[j] - c)
            return alike(common + doubt), alike(common - doubt)

        def joining(x: np.ndarray, y: np.ndarray) -> list[int]:
            """Places of the pairs that are sent on: components that have met inside the block aren't joined again."""
            out = []
            for k, (i, j) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                if component[i] != component[j]:
                    may, does = reaches(i, j)
                    if may:
                        out.append(k)
                    if does:
                        component[component == component[j]] = component[i]
            return out

        chosen, waiting = [], 0
        for i in range(len(rep) - 1):
            rest = np.arange(i + 1, len(rep))
            rest = rest[(component[rest] != component[i]) & ((part[rest] != part[i]) | within)]
            rest = rest[np.minimum(n[i], n[rest]) >= threshold * np.maximum(n[i], n[rest]) - 1e-9]
            equal = regs[rest] == regs[i]
            near = np.count_nonzero(equal, axis=1) >= least_equal
            rest, equal = rest[near], equal[near]
            rest = rest[equal.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[0]]
            if len(rest):
                chosen.append((np.full(len(rest), i), rest))
                waiting += len(rest)
            if waiting >= PAIRS or waiting and i == len(rep) - 2:
                x, y = (np.concatenate(side) for side in zip(*chosen, strict=True))
                alive = np.flatnonzero(_alive(regs[x], regs[y], n[x], n[y], threshold))
                alive = alive[joining(x[alive], y[alive])] if len(alive) else alive
                if len(alive):
                    a, b = rep[x[alive]], rep[y[alive]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
                chosen, waiting = [], 0

    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long")


def _hot(total: int) -> int:
    """Rows above which a key is hot: fewer than HOT keys can have so many."""
    return max(HOT_ROWS, -(-total // HOT))


def _salted(sizes: DataFrame, size: str, hot: int) -> DataFrame:
    """A row for each salt of a key, by its size."""
    return sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.floor(F.col(size) / hot).cast("int"))))


def set_classes(sketched: DataFrame) -> DataFrame:
    """set_a, set_b, n, doc_id and `of` of its first row, regs, rows and rep of each set: the class's number is the id of its first
    row, where no other class has it, else one beyond all ids, or a hash where ids leave no room."""
    rows, of = sketched.where("n > 0"), ["set_a", "set_b", "n"]
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "of")).alias("first")
    clash = rows.groupBy(*of).agg(first).groupBy(F.col("first.doc_id").alias("clash")).agg(F.count(F.lit(1)).alias("classes")).where("classes > 1 OR clash IS NULL")
    beyond = rows.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0] + 1
    # rows of one set have equal registers, so any of them does; the text of its first row stands for a class
    classes = rows.groupBy(*of).agg(first, F.first("regs").alias("regs"), F.count(F.lit(1)).alias("rows")).withColumn("doc_id", F.col("first.doc_id"))
    found = classes.join(clash, F.col("doc_id").eqNullSafe(F.col("clash")), "left")
    own = F.monotonically_increasing_id() + F.lit(beyond) if beyond < ROOM else F.xxhash64(F.lit("class"), *of)
    rep = F.when(F.col("classes").isNotNull(), own).otherwise(F.col("doc_id"))
    return found.select(*of, "doc_id", F.col("first.of").alias("of"), "regs", "rows", rep.alias("rep"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs; see the module."""
    spark = docs.sparkSession
    folder, threshold = shared_folder(spark), percent / 100
    sketched = written(sketches(docs, width, key, text), folder, "sketches")
    classes = written(set_classes(sketched), folder, "classes")
    # registers are most of what is written here: they stay for classes that share a bucket alone, and no longer than they are read
    of_rows = written(sketched.drop("regs", "of"), folder, "sets-of-rows")
    removed(spark, folder, "sketches")
    total, rows = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    banded = band_keys(classes)
    shared = written(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), folder, "shared")
    hot = _hot(BANDS * total)
    salts = F.broadcast(shared.where(F.col("size") >= hot).select("key", F.floor(F.col("size") / hot).cast("int").alias("most")))  # fewer than HOT rows
    salt = F.when(F.col("most").isNull(), 0).otherwise(F.pmod(F.xxhash64("rep", F.lit("salt")), F.col("most") + 1)).cast("int")
    banded = banded.join(salts, "key", "left").withColumn("salt", salt).drop("most")
    members = written(banded.join(_salted(shared, "size", hot), ["key", "salt"]), folder, "members")
    in_buckets = members.select("rep").distinct().join(classes.select("rep", F.col("doc_id").alias("_id"), F.col("of").alias("_of"), "n", "regs"), "rep")
    in_buckets = written(in_buckets, folder, "in-buckets")
    class_ids = written(classes.drop("regs", "of"), folder, "class-ids")
    removed(spark, folder, "classes", "shared")
    some = in_buckets.select("rep", "_id", "_of")
    some = F.broadcast(some) if in_buckets.count() <= BROADCAST_IDS else some
    own = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("of"), F.col(text).alias("text"))
    # of classes that share a bucket with another one, one text each; the rest isn't read again
    texts = own.join(some, F.col("id").eqNullSafe(F.col("_id")) & (F.col("of") == F.col("_of"))).select("rep", "text")
    texts = written(texts.dropDuplicates(["rep"]), folder, "texts")

    def by_key(placed: DataFrame, groups: DataFrame) -> DataFrame:
        """placed with the columns of groups (key, size, ...), hot keys by their salts."""
        return placed.join(_salted(groups, "size", hot).drop("size"), ["key", "salt"])

    def still_open(placed: DataFrame, labels: DataFrame, name: str) -> DataFrame:
        """Members of buckets in which there are several components still; components only grow, so no bucket opens again."""
        placed = placed.drop("component").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("size").alias("size")).where("low < high").select("key", "size")
        return written(by_key(placed, several), folder, name)

    def confirmed_links(pairs: DataFrame, name: str) -> DataFrame:
        return written(confirmed(pairs, texts, width, percent), folder, f"{name}-links")

    placed, labels, places = members.withColumn("component", F.col("rep")), None, members.count()
    for turn in range(STAR_ROUNDS):
        order = F.struct(F.lit(0).cast("long") if turn == 0 else F.xxhash64("rep", F.lit(turn)), "rep", "component")
        centres = placed.groupBy("key").agg(F.min(order).alias("centre"), F.max("size").alias("size")).select("key", "size", F.col("centre.rep").alias("centre"), F.col("centre.component").alias("centre_component"))
        wanted = by_key(placed, centres).where("component <> centre_component")
        # one candidate for each member: texts move once a round, however many buckets a member is in
        chosen = wanted.groupBy("rep").agg(F.min(F.struct(F.lit(0).cast("long") if turn == 0 else F.xxhash64("rep", "centre", F.lit(turn)), "centre"))["centre"].alias("centre"))
        # dealt by rep already; two that chose each other make one link twice
        pairs = chosen.select(F.col("rep").alias("a"), F.col("centre").alias("b"))
        labels = grown_components(labels, confirmed_links(estimated(pairs, in_buckets, threshold), f"star-{turn}"), folder, f"round-{turn}")
        placed, before = still_open(placed, labels, f"open-{turn}"), places
        places = placed.count()
        if places > WORTHWHILE * before:
            break
    left = placed.select("rep").distinct()
    sets = written(folded_sets(texts.join(left, "rep", "left_semi"), width), folder, "folded")
    held = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("held"), F.max("size").alias("size"))
    held = held.groupBy("key").agg(F.max(F.struct("held", "component")).alias("top"), F.sum("held").alias("now"), F.max("size").alias("size"))
    held = held.select("key", "size", F.col("top.component").alias("main"), F.col("top.held").alias("most"), (F.col("now") - F.col("top.held")).alias("others"))
    searched = by_key(placed, held).withColumn("largest", F.col("component") == F.col("main")).join(in_buckets.select("rep", "n", "regs").join(sets, "rep"), "rep")
    final = grown_components(labels, confirmed_links(blocks(searched, percent), "rest"), folder, "final")
    # the smallest id of each component; classes without links are components of their own
    ids = class_ids.select("rep", "doc_id")
    smallest = final.join(ids, final["node"] == ids["rep"]).groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = final.select(F.col("node").alias("rep"), "component").join(smallest, "component").select("rep", "component_id", F.lit(True).alias("linked"))
    named = class_ids.join(joined, "rep", "left")
    named = written(named.select("set_a", "set_b", "n", "rows", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), folder, "named")
    removed(spark, folder, *(f"open-{k}" for k in range(STAR_ROUNDS)), *(f"star-{k}-links" for k in range(STAR_ROUNDS)), "class-ids", "members", "in-buckets", "texts", "folded", "rest-links")
    # sets of many rows are sent to all executors (fewer than HOT of them), so that copies of one text don't meet in a task
    crowd = _hot(rows)
    of, own = ["set_a", "set_b", "n"], of_rows
    many = F.broadcast(named.where(F.col("rows") >= crowd).select(*of, F.col("component_id").alias("_many"), F.lit(True).alias("_crowd")))
    own = own.join(many, of, "left")
    few = named.where(F.col("rows") < crowd).select(*of, F.col("component_id").alias("_few"))
    rest = own.where("_crowd IS NULL").join(few, of, "left").withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("_few")))
    out = rest.select("doc_id", "n", "component_id").union(own.where("_crowd").select("doc_id", "n", F.col("_many").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of which one stays for each component; rows without words stay all. Ids are unique
    in a corpus; where they aren't, the rows of one id share its fate and equal ones of them stay once. Rows without an id are
    documents of their own that come after all ids (before them where ids reach 2 ** 62): one of them stays where no row of its
    component has an id."""
    folder, own = shared_folder(docs.sparkSession), F.col(key).cast("long")
    unnamed, most, least = docs.agg(F.count_if(own.isNull()), F.coalesce(F.max(own), F.lit(0)), F.coalesce(F.min(own), F.lit(0))).first()
    # rows travel as a struct, so that no column's name can clash
    rows = docs.select(F.struct(*docs.columns).alias("_row"), own.alias("_id"), F.col(text).alias("_text"))
    if unnamed:
        # a table, as these numbers have to be the same wherever they are read
        beyond = F.lit(most + 1) + F.monotonically_increasing_id() if most < ROOM else F.lit(max(least, 1 - ROOM) - 1) - F.monotonically_increasing_id()
        numbered = rows.where("_id IS NULL").withColumn("_id", beyond)
        rows = rows.where("_id IS NOT NULL").unionByName(written(numbered, folder, "unnamed"))
    kept = near_duplicates(rows, width, percent, "_id", "_text").groupBy("doc_id").agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows"))
    kept = written(kept.where("_kept").select(F.col("doc_id").alias("_id"), "_rows"), folder, "kept")
    out = rows.join(kept.where("_rows = 1"), "_id", "left_semi").select("_row.*")
    repeated = kept.where("_rows > 1").select("_id")
    n = repeated.count()
    if n:
        some = F.broadcast(repeated) if n <= BROADCAST_IDS else repeated
        out = out.unionByName(rows.join(some, "_id", "left_semi").select("_row").dropDuplicates().select("_row.*"))
    return out
