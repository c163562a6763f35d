"""What several training-data operators use: the shared folder, bounded batches of texts and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see. Where that is unset, a local one is set if the master is local;
    on a cluster it has to be named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/strandline-{uuid.uuid4().hex}"


#: Whether Spark deletes an execution's shuffle files at its end; else they stay until the driver's memory happens to be collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives the loss of executors. What it shuffled goes once the table is there."""
    path, conf = f"{folder}/{name}", df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, folder: str, *names: str) -> None:
    """Deletes tables of the shared folder that no plan reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in names:
        path = hadoop(f"{folder}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_batches(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the column `text` of each holds about `size` bytes, one row at least: what a worker makes of texts at
    once stays bounded, as the batches themselves are by Spark's own limit on their bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch["text"]), 0), dtype=np.int64)
        part = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if end > start:
                yield batch.slice(start, end - start)


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
#: Bytes that part words: [\x20\x09-\x0D].
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 18, n + n // 4)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
        _POWERS[base] = have
    return have[:n]


def word_table(separators: bytes = SPACES) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


_SPACE_TABLE = word_table()


def hashed_words(texts: list[str | None], table: np.ndarray = _SPACE_TABLE, lower: bool = True, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and for each word its text's index, its first byte and its length.

    `prefixes` adds, behind the words, the first so many bytes of each longer word, hashed apart from words.
    Only A-Z are lower-cased. Null and empty texts have no words. The sentinel byte between texts is a separator.
    """
    encoded = [t.encode() if t else b"" for t in texts]
    joined = b"\n".join(encoded) + b"\n"
    raw = np.frombuffer(joined.translate(_LOWER) if lower else joined, np.uint8)
    inside = table[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)), dtype=np.uint64)])
    inverse = _powers(_BASE_INVERSE, len(raw))
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _MULTIPLIER)
    if prefixes:
        parts, begun, length = [hashes], [starts], ends - starts
        for k in prefixes:
            longer = starts[length > k]
            parts.append(mixed((sums[longer + k] - sums[longer]) * inverse[longer] + np.uint64((k << 32) * 0x9E3779B97F4A7C15 % (1 << 64))))
            begun.append(longer)
        sizes = np.concatenate([length, *(np.full(len(b), k) for k, b in zip(prefixes, begun[1:], strict=True))])
        hashes, starts = np.concatenate(parts), np.concatenate(begun)
    else:
        sizes = ends - starts
    firsts = np.cumsum([0, *(len(e) + 1 for e in encoded)])
    owner = np.searchsorted(firsts, starts, "right") - 1
    return hashes, owner, starts - firsts[owner], sizes


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word shingles of all texts, sorted within each, and the offsets of the texts (one more than texts).

    A text of fewer words than `width` has its whole word sequence as one shingle, one without words none.
    """
    words, owner, _, _ = hashed_words(texts)
    counts = np.bincount(owner, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    mixers = [mixed(np.uint64([k + 1]) * _MULTIPLIER)[0] | np.uint64(1) for k in range(width)]
    place = np.arange(n) - np.concatenate([[0], np.cumsum(counts)])[owner]
    shingle = np.zeros(n, np.uint64)
    for k in range(width):
        if n > k:
            part = words[k:] * mixers[k]
            part[owner[k:] != owner[: n - k]] = 0
            shingle[: n - k] += part
    length = np.minimum(counts[owner] - place, width)
    keep = (length == width) | ((place == 0) & (counts[owner] < width))
    shingle, owner = mixed(shingle[keep] + length[keep].astype(np.uint64)), owner[keep]
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    first = np.ones(len(shingle), bool)
    first[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    shingle, owner = shingle[first], owner[first]
    return shingle, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])


def uniform(*parts: Column | str | int) -> Column:
    """A hash draw in (0, 1) decided by `parts` alone."""
    hashed = F.xxhash64(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / float(1 << 53)
