"""Operator 2: licence scans by the Dice coefficient over word bigrams.

Texts and templates are normalised (A-Z lower-cased; anything but ASCII letters, digits and bytes of other scripts parts words). Units of a
text are its windows of words, wherever they begin and end within lines; a unit's set is its distinct word bigrams. Dice is
2 c / (a + b) for c shared bigrams. For a threshold t a template of b bigrams can only match a unit of a bigrams if 2 min(a, b) >=
t (a + b), so templates of which a text has fewer bigrams, looked up in an index from bigrams to templates, are never compared, and
windows end at that size. Windows that start or end at a bigram the template lacks, or that they have again further in, are left out:
without it they are at least as alike. So all windows of a template cost time in proportion to the text at most.

Results: a row for each document; without a match the licence is null, dice 0 and spans empty. Null and empty texts have none. Of
units that share words and match the same template the best is kept (ties: the shorter, then the earlier); the best licence of a
document is its highest Dice, ties go to the larger template and then to the name. Repeated rows get the same row again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import hashed_words, mixed, text_batches, word_table

_TABLE = word_table(bytes(b for b in range(128) if not chr(b).isalnum()))
SPANS = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())]))


def bigrams(words: np.ndarray) -> np.ndarray:
    return mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else words[:0]


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.names, self.threshold = sorted(templates), threshold
        sets = [np.unique(bigrams(hashed_words([templates[n]], _TABLE)[0])) for n in self.names]
        self.sizes = np.array([len(s) for s in sets])
        self.known = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]))
        self.of = np.array([np.isin(self.known, s) for s in sets], bool).reshape(len(sets), len(self.known))
        reach = threshold / (2 - threshold)
        self.least, self.most = self.sizes * reach - 1e-9, self.sizes / reach + 1e-9

    def windows(self, i: int, hit: np.ndarray, before: np.ndarray, after: np.ndarray, present: int) -> list[tuple[float, int, int]]:
        """(Dice, first, last bigram) of the best window from each start that matches template i.

        `hit` are the text's bigrams of the template, `before` and `after` where each bigram of the text is found next; `present` are
        the template's distinct bigrams in the text."""
        found = []
        for start in np.flatnonzero(hit).tolist():
            # from its next place on, this bigram is further in
            stop, size = int(after[start]), int(2 * self.most[i]) + 16
            while True:
                end = min(stop, start + size)
                new = before[start:end] < start
                distinct, common = np.cumsum(new), np.cumsum(new & hit[start:end])
                if end == stop or distinct[-1] > self.most[i] or common[-1] == present:
                    break
                size *= 2
            dice = np.where(new & hit[start:end] & (distinct <= self.most[i]), 2 * common / (distinct + self.sizes[i]), 0.0)
            last = int(dice.argmax())
            if dice[last] >= self.threshold:
                found.append((float(dice[last]), start, start + last))
        return found

    def scan(self, text: str, words: np.ndarray, starts: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(licence, dice, first line, last line) of a text, of which the words' hashes and first bytes are known."""
        pairs = bigrams(words)
        if not len(pairs) or not len(self.known):
            return []
        at = np.minimum(np.searchsorted(self.known, pairs), len(self.known) - 1)
        at[self.known[at] != pairs] = -1
        known = np.unique(at[at >= 0])
        present = self.of[:, known].sum(1)
        wanted = np.flatnonzero((present >= self.least) & (present > 0))
        if not len(wanted):
            return []  # no unit can share enough bigrams with a template
        order = np.argsort(pairs, kind="stable")
        same = pairs[order[1:]] == pairs[order[:-1]]
        before, after = np.full(len(pairs), -1), np.full(len(pairs), len(pairs))
        before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
        line = np.searchsorted(np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 10), starts)
        kept: list[tuple[str, float, int, int]] = []
        for i in wanted.tolist():
            taken = np.zeros(len(words), bool)
            for dice, a, b in sorted(self.windows(i, (at >= 0) & self.of[i][at], before, after, int(present[i])), key=lambda f: (-f[0], f[2] - f[1], f[1])):
                if not taken[a : b + 2].any():
                    taken[a : b + 2] = True
                    kept.append((self.names[i], dice, int(line[a]), int(line[b + 1])))
        return sorted(kept, key=lambda f: (f[2], f[3], f[0]))


def scan_licences(docs: DataFrame, templates: dict[str, str], threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, licence, dice, n_spans, spans of every row of docs."""
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    sizes = {n: len(np.unique(bigrams(hashed_words([t], _TABLE)[0]))) for n, t in templates.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in text_batches(batches):
            texts = batch["text"].to_pylist()
            words, owner, starts, _ = hashed_words(texts, _TABLE)
            edges = np.searchsorted(owner, np.arange(len(texts) + 1))
            spans = [scanner.scan(t, words[a:b], starts[a:b]) if t else [] for t, a, b in zip(texts, edges, edges[1:], strict=False)]
            best = [min(s, key=lambda f: (-f[1], -sizes[f[0]], f[0])) if s else (None, 0.0) for s in spans]
            rows = [[dict(zip(("licence", "dice", "first_line", "last_line"), f, strict=True)) for f in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64()), pa.array(map(len, spans), pa.int32()), pa.array(rows, SPANS)], ["doc_id", "licence", "dice", "n_spans", "spans"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, licence string, dice double, n_spans int, spans array<struct<licence:string,dice:double,first_line:int,last_line:int>>")
