"""Operator 8: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts of the labels table, whatever their label says, are the unlabelled set. A numpy
logistic model minimises  pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])  with l the logistic loss: the second term is the risk
on negatives, corrected by the class prior pi, and is held non-negative (when it falls below zero its gradient is turned around).
pi is the share of toxic rows among all labelled training rows. Features are the presence of words and word beginnings (by 64-bit
hashes, so nothing collides): all that stand out among positives or unlabelled texts by a two-sample z value.

Bounds, documented parameters: MAX_POSITIVE and MAX_UNLABELLED labelled rows (expected numbers, taken by a hash of the id) are what
the model is fitted on, and what reaches the driver is bounded by them. Scoring reads whole texts and nothing but the text.
Results: null and empty texts get the score of a text without any known word; repeated rows get equal scores; without positives
(or without labels) every score is the prior, 0 where there is none. Labels that are null don't count; of several the largest does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import hashed_words, shared_folder, text_batches, word_table, written

MAX_POSITIVE, MAX_UNLABELLED = 8_000, 16_000
#: A word must be in so many positives and stand out by so many standard deviations.
LEAST_TEXTS, LEAST_Z = 3, 4.5
STEPS, RATE, DECAY = 800, 0.1, 1e-5
#: Bytes of word beginnings that are features beside whole words: languages that compound words show there.
PREFIXES = (6, 7, 8, 9)
FOLDS = 5

#: Everything but ASCII letters, digits and bytes of other scripts parts words.
_TABLE = word_table(bytes(b for b in range(128) if not chr(b).isalnum()))


@dataclass
class Model:
    words: np.ndarray  # sorted 64-bit hashes
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        g = np.full(len(texts), self.bias)
        owner, feature = present(texts, self.words)
        np.add.at(g, owner, self.weights[feature])
        return 1 / (1 + np.exp(-np.clip(g, -700, 700)))


def present(texts: list[str | None], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have which of the (sorted) words, each pair once."""
    hashes, owner, _, _ = hashed_words(texts, _TABLE, prefixes=PREFIXES)
    if not len(words) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    hit = words[at] == hashes
    pairs = np.unique(owner[hit].astype(np.int64) * len(words) + at[hit])
    return pairs // len(words), pairs % len(words)


class Presence:
    """A 0/1 matrix of texts by words as the words of each text."""

    def __init__(self, rows: list[np.ndarray], size: int):
        self.lengths, self.size = np.array([len(r) for r in rows], np.int64), size
        self.words = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        self.texts = np.repeat(np.arange(len(rows)), self.lengths)

    def __len__(self) -> int:
        return len(self.lengths)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.texts, weights[self.words], len(self))

    def summed(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.words, values[self.texts], self.size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def nnpu_risk(positive: Presence, unlabelled: Presence, prior: float, w: np.ndarray) -> tuple[float, float, np.ndarray]:
    """pi E_P[l(g)], E_U[l(-g)] - pi E_P[l(-g)] and the direction to descend against, for weights w (the bias last)."""
    gp, gu = positive.times(w[:-1]) + w[-1], unlabelled.times(w[:-1]) + w[-1]
    on_positives = prior * np.logaddexp(0, -gp).mean()
    on_negatives = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    down = prior * (_sigmoid(gp) - 1) / len(gp)  # of pi * E_P[l(g)]
    up_p, up_u = -prior * _sigmoid(gp) / len(gp), _sigmoid(gu) / len(gu)  # of the risk on negatives
    dp, du = (down + up_p, up_u) if on_negatives >= 0 else (-up_p, -up_u)
    return on_positives, on_negatives, np.append(positive.summed(dp) + unlabelled.summed(du), dp.sum() + du.sum())


def fit_nnpu(positive: Presence, unlabelled: Presence, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model by full-batch Adam on the non-negative PU risk."""
    w = np.zeros(positive.size + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, steps + 1):
        gradient = nnpu_risk(positive, unlabelled, prior, w)[2]
        gradient[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def held_out(key: Column, folds: int = FOLDS) -> Column:
    """Rows whose crc32 of the id as text is a multiple of `folds`; their labels are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _sampled(key: Column, share: float, salt: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the rows of `labels` that aren't held out."""
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    texts = docs.where(~held_out(F.col(key))).select(F.col(key).alias("key"), F.col(text).alias("text"))
    labelled, positives = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = positives / labelled if labelled else 0.0
    if not positives:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(prior, 1e-12) / max(1 - prior, 1e-12))))
    prior = min(prior, 0.95)
    known = own.where("toxic = 1").where(_sampled(F.col("key"), MAX_POSITIVE / positives, "positive")).select("key", F.lit(1).alias("group"))
    known = known.union(own.where(_sampled(F.col("key"), MAX_UNLABELLED / labelled, "unlabelled")).select("key", F.lit(0).alias("group")))
    picked = F.broadcast(known.limit(2 * (MAX_POSITIVE + MAX_UNLABELLED)))
    # a table, as the texts are read for their words and again for the features
    sample = written(texts.join(picked, "key").select("text", "group"), shared_folder(docs.sparkSession), "labelled-texts")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            hashes, owner, _, _ = hashed_words(batch["text"].to_pylist(), _TABLE, prefixes=PREFIXES)
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            first = np.ones(len(hashes), bool)
            first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            group = batch["group"].to_numpy()[owner[first]]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(group, pa.int32())], ["word", "group"])

    counts = sample.mapInArrow(words_of, "word long, group int").groupBy("word").agg(F.sum("group").alias("p"), F.sum(1 - F.col("group")).alias("u"))
    sizes = {r["group"]: r["n"] for r in sample.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    pooled = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(pooled * (1 - F.least(pooled, F.lit(0.999999))) * (1 / n_p + 1 / n_u))
    chosen = counts.where(F.col("p") + F.col("u") >= LEAST_TEXTS).where(F.abs(z) >= LEAST_Z).select("word")
    words = np.sort(np.array([r["word"] for r in chosen.collect()], np.int64).view(np.uint64))

    def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            owner, feature = present(batch["text"].to_pylist(), words)
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            rows = [feature[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch["group"], pa.array(rows, pa.binary())], ["group", "features"])

    x: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for r in sample.mapInArrow(features_of, "group int, features binary").collect():  # bounded by the parameters above
        x[r["group"]].append(np.frombuffer(r["features"], "<u4"))
    if not x[1] or not x[0]:
        return Model(words[:0], np.zeros(0), float(np.log(prior / (1 - prior))))
    weights, bias = fit_nnpu(Presence(x[1], len(words)), Presence(x[0], len(words)), prior)
    return Model(words, weights, bias)


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of every row of docs."""
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.scores(batch["text"].to_pylist()), pa.float64())], ["doc_id", "score"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns, in one pass over the texts."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            yield batch.filter(pa.array(model.scores(batch["text"].to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
