"""Operator 1: mixing sources to target weights by soft membership, in DataFrame functions alone.

A classifier fitted on a labelled table (id, domain) gives each document a posterior over domains: naive Bayes on word counts in
BUCKETS hash buckets, tempered by a factor that is chosen on the half of the labelled rows that wasn't counted. The expected tokens
of domain d are then sum_i n_i p_id r_i for document rates r_i >= 0, and the rates minimise the squared distance to the target
totals. Distances are weighted by the inverse of sum_i n_i p_i p_i' / sum_i n_i. A projected gradient step runs in the metric of the
token counts of those documents whose rate is above 0: while none more is held at 0 a single step arrives. Where that brings the totals
hardly closer, the step runs in the metric of all documents, in which no step of length 1 overshoots. The fit ends when every share is
within TOLERANCE, or when no step helps any more; targets that can't be met are approached for STEPS steps, with a warning. A step is
one aggregate over (n, p) rows: a few sums come to the driver, and a rate is folded from the steps' vectors where it is needed, so
nothing is kept for a document but its row.

Weights that are `Repeated` are reached by repeating alone: rates are at least 1, and the total grows as far as the shares ask for. Of
all such rates those are taken that differ least from 1: 1 + max(0, v (p - w)) for shares w and one vector v, found by Newton steps.

Results: null and empty texts have no tokens and the prior as posterior; repeated rows are documents of their own; an empty table
gives an empty one; a domain without labelled rows has no posterior and its target can't be met; targets needn't sum to one.
Bound: at most about MAX_LABELLED labelled rows are counted, taken by a hash of their ids. Weights have BUCKETS rows.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import shared_folder, uniform, written

BUCKETS, MAX_LABELLED, SMOOTHING = 1 << 14, 20_000, 0.5
TEMPERATURES = (0.0, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)
STEPS, TOLERANCE = 60, 1e-7
#: Shares that no repeating reaches (no text is likely enough to be of a domain) are left short instead of repeating a few texts endlessly.
RIDGE = 1e-6


class Repeated(dict):
    """Weights of domains that are reached by repeating documents: no rate is below 1."""


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _softmax(scores: list[Column]) -> Column:
    most = F.greatest(*scores) if len(scores) > 1 else scores[0]
    powers = [F.exp(s - most) for s in scores]
    total = sum(powers[1:], powers[0])
    return F.array(*(p / total for p in powers))


class Classifier:
    def __init__(self, domains: Sequence[str], weights: DataFrame, priors: list[float], temperature: float):
        self.domains, self.weights, self.priors, self.temperature = list(domains), weights, priors, temperature

    def sums(self, docs: DataFrame, *more: str) -> DataFrame:
        """_row, doc_id, more, n_tokens and the log-likelihood sums s0, s1, ... of every row of docs (doc_id, text, more)."""
        rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", *more, "text")
        rows = rows.select("_row", "doc_id", *more, F.explode_outer(_words(F.col("text"))).alias("word"))
        rows = rows.withColumn("bucket", _bucket(F.col("word"))).join(F.broadcast(self.weights), "bucket", "left")  # BUCKETS rows
        sums = [F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col(f"w{k}"))), F.lit(0.0)).alias(f"s{k}") for k in range(len(self.domains))]
        return rows.groupBy("_row", "doc_id", *more).agg(F.count("word").alias("n_tokens"), *sums)

    def posterior(self, temperature: float) -> Column:
        scale = F.lit(temperature) / F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))
        return _softmax([F.lit(math.log(p)) + scale * F.col(f"s{k}") for k, p in enumerate(self.priors)])


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: Sequence[str], folder: str) -> Classifier:
    """docs (doc_id, text), labelled (doc_id, domain)."""
    known = labelled.where(F.col("domain").isin(list(domains)) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    total = known.count()
    draw = F.pmod(F.xxhash64(F.lit("labelled"), "doc_id"), F.lit(1 << 30))
    picked = known.where(draw < int(min(1.0, MAX_LABELLED / max(1, total)) * (1 << 30))).limit(2 * MAX_LABELLED)
    picked = written(picked.withColumn("counted", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0), folder, "labelled")
    texts = docs.join(F.broadcast(picked), "doc_id")  # 2 * MAX_LABELLED ids at most
    words = texts.where("counted").select("domain", F.explode(_words(F.col("text"))).alias("word")).select("domain", _bucket(F.col("word")).alias("bucket"))
    counts = written(words.groupBy("bucket").agg(*(F.count_if(F.col("domain") == d).alias(f"c{k}") for k, d in enumerate(domains))), folder, "counts")
    sums = counts.agg(*(F.coalesce(F.sum(f"c{k}"), F.lit(0)) for k in range(len(domains)))).first()
    sizes = picked.agg(*(F.count_if(F.col("domain") == d) for d in domains)).first()
    priors = [(n + 1e-9) / (sum(sizes) + 1e-9 * len(domains)) for n in sizes]
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    log = lambda k: F.log((F.coalesce(F.col(f"c{k}"), F.lit(0)) + SMOOTHING) / (sums[k] + SMOOTHING * BUCKETS))
    weights = written(every.select("bucket", *(log(k).alias(f"w{k}") for k in range(len(domains)))), folder, "weights")
    made = Classifier(domains, weights, priors, 1.0)
    held = written(made.sums(texts.where("not counted").select("doc_id", "text", "domain"), "domain"), folder, "held")
    at = F.array_position(F.array(*(F.lit(d) for d in domains)), F.col("domain")).cast("int")
    losses = held.agg(*(F.avg(-F.log(F.greatest(F.element_at(made.posterior(t), at), F.lit(1e-12)))) for t in TEMPERATURES)).first()
    made.temperature = min(zip(losses, TEMPERATURES, strict=True))[1] if losses[0] is not None else 0.0
    return made


def _dot(p: Column, v: Column | list[float], size: int) -> Column:
    terms = [p[k] * v[k] for k in range(size)]
    return sum(terms[1:], terms[0])


def rate(steps: list[list[float]], size: int) -> Column:
    """The rate after `steps`, from p; each step is followed by the projection to r >= 0."""
    if not steps:
        return F.lit(1.0)
    vectors = F.array(*(F.array(*(F.lit(float(x)) for x in step)) for step in steps))
    return F.aggregate(vectors, F.lit(1.0), lambda r, v: F.greatest(F.lit(0.0), r - _dot(F.col("p"), v, size)))


def fit_rates(rows: DataFrame, targets: list[float], steps: int = STEPS) -> list[list[float]]:
    """The steps that bring sum n p r to `targets` (in tokens), from rows (n_tokens, p); warns where `steps` of them don't."""
    size = len(targets)
    n = F.col("n_tokens").cast("double")
    p = [F.col("p")[k] for k in range(size)]

    def at(made: list[list[float]]) -> tuple[float, np.ndarray, np.ndarray]:
        """All tokens, the distances to the targets and the metric of rows with a rate above 0, by `total`."""
        own = rows.select("n_tokens", "p", rate(made, size).alias("rate"))
        on = F.when(F.col("rate") > 0, n).otherwise(0.0)
        metric = [F.coalesce(F.sum(on * p[j] * p[k]), F.lit(0.0)) for j in range(size) for k in range(size)]
        sums = own.agg(F.coalesce(F.sum(n), F.lit(0.0)), *(F.coalesce(F.sum(n * p[k] * F.col("rate")), F.lit(0.0)) for k in range(size)), *metric).first()
        total = sums[0] or 1.0
        return sums[0], (np.array(sums[1 : size + 1]) - targets) / total, np.array(sums[size + 1 :]).reshape(size, size) / total

    inverse = lambda m: np.linalg.pinv(m, rcond=1e-9, hermitian=True)
    total, gap, metric = at([])
    if not total:
        return []
    weight = inverse(metric)
    made: list[list[float]] = []
    for _ in range(steps):
        if np.abs(gap).max() < TOLERANCE:
            return made
        loss = gap @ weight @ gap
        for own, most in ((inverse(metric), 0.95), (weight, 1 - 1e-6)):
            step = (own @ gap).tolist()
            _, new_gap, new_metric = at([*made, step])
            if new_gap @ weight @ new_gap < most * loss:
                break
        else:
            return made
        made.append(step)
        gap, metric = new_gap, new_metric
    warnings.warn(f"mixing: shares are still up to {np.abs(gap).max():.1e} off after {steps} steps", stacklevel=2)
    return made


def fit_repeats(rows: DataFrame, shares: list[float], steps: int = STEPS) -> list[float]:
    """v of the rates 1 + max(0, v (p - shares)) that bring sum n p r to `shares` of sum n r, from rows (n_tokens, p).

    v is where the convex sum n (max(0, v q)^2 / 2 + v q) / sum n + RIDGE v^2 / 2 for q = p - shares is least."""
    size = len(shares)
    n = F.col("n_tokens").cast("double")
    q = [F.col("p")[k] - F.lit(float(shares[k])) for k in range(size)]

    def at(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        along = _dot(F.array(*q), [F.lit(float(x)) for x in v], size)
        over = F.greatest(F.lit(0.0), along)
        # at 0 every row is on the edge; the rows that a first step moves are those that lie along it
        on = along > 0 if v.any() else _dot(F.array(*q), [F.lit(float(-x)) for x in mean], size) > 0
        curve = [F.sum(F.when(on, n * q[j] * q[k]).otherwise(0.0)) for j in range(size) for k in range(size)]
        sums = rows.agg(F.sum(n * (over * over / 2 + along)), *(F.sum(n * x * (1 + over)) for x in q), *curve).first()
        value, slope, bend = sums[0] / total, np.array(sums[1 : size + 1]) / total, np.array(sums[size + 1 :]).reshape(size, size) / total
        return value + RIDGE * v @ v / 2, slope + RIDGE * v, bend + RIDGE * np.eye(size)

    first = rows.agg(F.coalesce(F.sum(n), F.lit(0.0)), *(F.sum(n * x) for x in q)).first()
    total = first[0]
    if not total:
        return [0.0] * size
    v, mean = np.zeros(size), np.array(first[1:]) / total
    value, slope, bend = at(v)
    for _ in range(steps):
        step = -np.linalg.solve(bend, slope)
        if np.abs(slope).max() < TOLERANCE:
            break
        length, new = 1.0, at(v + step)
        while new[0] > value + 1e-4 * length * (slope @ step) and length > 1e-6:
            length /= 2
            new = at(v + length * step)
        if new[0] >= value:
            break
        v, (value, slope, bend) = v + length * step, new
    return v.tolist()


def mixture(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], epochs: float = 1.0, key: str = "doc_id", text: str = "text", steps: int = STEPS) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), p (posteriors in the order of `weights`), rate of every row of docs.

    Targets: a domain's weight times `epochs` times all tokens of docs; of Repeated weights the shares alone."""
    folder, domains = shared_folder(docs.sparkSession), list(weights)
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    model = fit_classifier(own, labelled, domains, folder)
    rows = written(model.sums(own).select("doc_id", "n_tokens", model.posterior(model.temperature).alias("p")), folder, "posteriors")
    total = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    scale = sum(weights.values())
    if isinstance(weights, Repeated):
        shares = [weights[d] / scale for d in domains]
        v = fit_repeats(rows, shares, steps)
        over = _dot(F.array(*(F.col("p")[k] - F.lit(x) for k, x in enumerate(shares))), [F.lit(x) for x in v], len(domains))
        found = F.lit(1.0) + F.greatest(F.lit(0.0), over)
    else:
        found = rate(fit_rates(rows, [weights[d] / scale * epochs * total for d in domains], steps), len(domains))
    domain = F.element_at(F.array(*(F.lit(d) for d in domains)), F.array_position("p", F.array_max("p")).cast("int"))
    return rows.select("doc_id", "n_tokens", domain.alias("domain"), "p", found.alias("rate"))


def copies(rate_column: Column, key: Column, at_least: int = 0) -> Column:
    """How often a document of that rate is taken: its whole part, and once more by a hash of its key with the chance of the rest."""
    return F.greatest(F.lit(at_least), F.floor(rate_column + uniform("mixing", key))).cast("int")


def mixed_documents(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], epochs: float = 1.0, at_least: int = 0, steps: int = STEPS) -> DataFrame:
    """The rows of docs, each as often as its rate says, at least `at_least` times. Rows that share an id, or have none, are all taken as
    often as the one of them with the most copies; texts without words have the rate of the prior."""
    taken = mixture(docs, labelled, weights, epochs, steps=steps).groupBy("doc_id").agg(F.max(copies(F.col("rate"), F.col("doc_id"), at_least)).alias("_copies"))
    # rows travel as a struct, so that no column's name can clash
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    kept = rows.join(taken.where("_copies > 0"), F.col("_row")["doc_id"].eqNullSafe(F.col("doc_id")))
    return kept.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain of the labels table: `toxic`, else `high` or `low` quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")
