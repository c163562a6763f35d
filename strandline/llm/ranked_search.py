"""Operator 12: ranked lexical search by windowed bucket scoring.

Each text becomes a row of the query terms that it holds and how often. The rows are dealt by fixed windows of WINDOW doc_ids; a task
turns a window's rows into postings by term, computes what each posting adds to a score once, and then goes through the postings of
every item's terms: it adds them into an array with a slot for each row of the window, small enough for a CPU's cache, and marks the
slots in a bitset. The marked slots are harvested into a heap of the item's best k, which goes on to the task's next window, and are
set back to 0. The heaps of all tasks meet in a top-k by item, in parts first.

The terms of all items are sent to every task, at most about TERMS at once: more items than that are dealt in batches, each with its
own pass. Rows of a window that one task can't take at once (a doc_id that a third of all rows share, rows without one) are scored in
pieces, as a score needs its own row only. N, L and df are counted over the whole table. Terms are told apart by 64 bits of hash.

Results: null and empty texts have no terms. Every row is a document of its own, also where rows share a doc_id or have none; at equal
scores those without one come last. The terms of items that share an item_id, or have none, are put together. Items without terms or
without a document that scores above 0 have no rows; empty tables give an empty one; other columns aren't read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.shared import hashed_words, removed, shared_folder, text_batches, word_table, written

WINDOW, TERMS = 4096, 500_000
#: Parts of an item's candidates that are ranked before they meet.
PARTS = 64
#: Bytes that part terms: all of ASCII but digits and letters.
BETWEEN = bytes(b for b in range(128) if not chr(b).isalnum())
TABLE = word_table(BETWEEN)


def terms_of(texts: list[str | None], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many terms each text has, and the offsets, places in `vocabulary` (sorted hashes) and frequencies of those that are there."""
    hashes, owner, _, _ = hashed_words(texts, TABLE)
    lengths = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
    known = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
    pairs, counts = np.unique(owner[known] * max(len(vocabulary), 1) + at[known], return_counts=True)
    own, places = np.divmod(pairs, max(len(vocabulary), 1))
    return lengths, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(texts)))]), places, counts


def forward_rows(docs: DataFrame, vocabulary: np.ndarray, key: str, text: str) -> DataFrame:
    """doc_id, n, places, counts of every row that has a term at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            lengths, offsets, places, counts = terms_of(batch["text"].to_pylist(), vocabulary)
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (places, counts)]
            made = pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lengths), *lists], ["doc_id", "n", "places", "counts"])
            yield made.filter(pa.array(lengths > 0))

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, places array<int>, counts array<int>")


class Buckets:
    """The rows of a window as postings by term, and the buckets that scores are added up in."""

    def __init__(self, weights: np.ndarray, documents: int, total: int, k: int):
        self.weights, self.documents, self.total, self.k = weights, documents, total, k
        self.scores, self.occupied = np.zeros(WINDOW, np.int64), np.zeros(WINDOW // 64, np.uint64)

    def fill(self, n: np.ndarray, sizes: np.ndarray, places: np.ndarray, counts: np.ndarray) -> None:
        slots = np.repeat(np.arange(len(n)), sizes)
        m = 10 + 90 * n * self.documents // self.total
        adds = self.weights[places] * (1_000_000_000 * counts // (1000 * counts + 8 * m[slots]))
        order = np.argsort(places, kind="stable")  # slots ascend within a term
        places, self.slots, self.adds = places[order], slots[order], adds[order]
        self.terms, first = np.unique(places, return_index=True)
        self.first = np.append(first, len(places))
        words = self.slots >> 6
        new = np.ones(len(places), bool)
        new[1:] = (places[1:] != places[:-1]) | (words[1:] != words[:-1])
        starts = np.flatnonzero(new)
        bits = np.uint64(1) << (self.slots & 63).astype(np.uint64)
        self.words, self.masks = words[starts], np.bitwise_or.reduceat(bits, starts) if len(starts) else bits
        self.first_word = np.searchsorted(starts, self.first)

    def scored(self, terms: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots and scores of the rows that hold one of an item's terms and reach `least`; of more than k the best k and their ties."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)  # a window has a term at least
        for t in at[self.terms[at] == terms].tolist():
            a, b = self.first[t], self.first[t + 1]
            self.scores[self.slots[a:b]] += self.adds[a:b]
            a, b = self.first_word[t], self.first_word[t + 1]
            self.occupied[self.words[a:b]] |= self.masks[a:b]
        touched = np.flatnonzero(np.unpackbits(self.occupied.view(np.uint8), bitorder="little"))
        scores = self.scores[touched]
        self.scores[touched] = 0
        self.occupied[:] = 0
        good = scores >= max(least, 1)
        touched, scores = touched[good], scores[good]
        if len(scores) > self.k:
            good = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            touched, scores = touched[good], scores[good]
        return touched, scores


def _scored(rows: DataFrame, items: list[tuple[int | None, np.ndarray]], weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """item_id, doc_id, score: the best k of each item among the rows of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(weights, documents, total, k)
        heaps: list[list[tuple[int, bool, int]]] = [[] for _ in items]
        held: list[pa.RecordBatch] = []

        def score() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            places, counts = (table[c].combine_chunks() for c in ("places", "counts"))
            ids, sizes = table["doc_id"].to_pylist(), np.diff(np.asarray(places.offsets))
            buckets.fill(table["n"].to_numpy(), sizes, np.asarray(places.flatten()), np.asarray(counts.flatten()).astype(np.int64))
            for heap, (_, terms) in zip(heaps, items, strict=True):
                slots, scores = buckets.scored(terms, -heap[-1][0] if len(heap) == k else 1)
                if len(slots):
                    heap[:] = heapq.nsmallest(k, heap + [(-s, ids[i] is None, ids[i] or 0) for i, s in zip(slots.tolist(), scores.tolist(), strict=True)])

        for batch in batches:
            own = batch["window"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    have = sum(x.num_rows for x in held)
                    if held and (held[-1]["window"][0].as_py() != own[a] or have == WINDOW):
                        score()
                        held, have = [], 0
                    held.append(batch.slice(a, min(b - a, WINDOW - have)))
                    a += held[-1].num_rows
        if held:
            score()
        out = [(items[i][0], None if null else doc, -s) for i, heap in enumerate(heaps) for s, null, doc in heap]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k rows of docs that score highest for each item."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    lower = F.translate(F.coalesce(F.col(item_text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))))
    asked = written(items.select(F.col(item).cast("long").alias("item_id"), words.alias("term")).distinct(), folder, "terms")
    batches = asked.count() // TERMS + 1
    found = None
    for b in range(batches):
        pairs = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == b).collect()  # about TERMS pairs of an item and a term
        terms = sorted({r["term"] for r in pairs})
        hashes, owner, _, _ = hashed_words(terms, TABLE)
        vocabulary = np.sort(hashes)
        place = {t: int(p) for t, p in zip(terms, np.searchsorted(vocabulary, hashes[np.argsort(owner)]), strict=True)}
        of: dict[int | None, list[int]] = {}
        for r in pairs:
            of.setdefault(r["item_id"], []).append(place[r["term"]])
        rows = written(forward_rows(docs, vocabulary, key, text), folder, f"rows-{b}")
        documents, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(terms), np.int64)
        for p, df in rows.select(F.explode("places").alias("p")).groupBy("p").count().collect():  # a row for each term asked for
            weights[p] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        window = F.coalesce(F.floor(F.col("doc_id") / WINDOW), F.lit(-(1 << 62))).alias("window")
        dealt = rows.where(F.size("places") > 0).select(window, "*").hint("rebalance", F.col("window")).sortWithinPartitions("window")
        one = _scored(dealt, [(i, np.array(p, np.int64)) for i, p in of.items()], weights, documents, total, k)
        found = one if found is None else found.union(one)
    removed(spark, folder, "terms")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")
