"""Operator 3: byte-level BPE by prefix dynamic programming.

For every prefix of a piece of bytes there is one token that can stand last in that prefix's encoding. The table of these
tokens is all that is kept: an encoding is read from it backwards, an append only adds entries, and an edit keeps the entries
before it. A token t may follow the last token s of the prefix before it if, and only if, the merges of s + t give (s, t).

Results: a null text is taken as empty, an empty text has no ids. Very long pieces (runs of spaces, a word of a megabyte) take
time in proportion to their length. Repeated rows give repeated rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import text_batches

#: Pieces in one generation of the cache, and the longest that is kept there; two generations bound a worker's memory.
CACHED_PIECES, CACHED_CHARS = 250_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class _Pieces(dict):
    """Ids of pieces; the older of two generations goes when the younger is full."""

    def __init__(self, encode: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class PrefixBPE:
    """Encodes and decodes by a rank table; `pattern` parts a text into pieces that are encoded one by one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.pieces = _Pieces(lambda piece: tuple(self.encode_piece(piece.encode())))
        self._follows: dict[tuple[int, int], bool] = {}
        self._automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            if len(token) == 1 or self.merged(token) == [i]:  # a token that merges never make can't be in a longer encoding
                self._automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self._automaton.make_automaton()

    def merged(self, piece: bytes) -> list[int]:
        """The merges themselves, lowest rank first, leftmost of equals; for short pieces."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        ranks, none = self.ranks, len(self.ranks) + 1
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[k] + parts[k + 1], none), k) for k in range(len(parts) - 1))
            if rank == none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        known = self._follows.get((left, right))
        if known is None:
            if len(self._follows) >= 1_000_000:
                self._follows.clear()
            known = self._follows[left, right] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """For each prefix its last token; `known` holds those of a first part of `piece` that didn't change."""
        last: list[int | None] = list(known or [])
        done = len(last)
        last += [None] * (len(piece) - done)
        longest = max(0, done - max(map(len, self.ranks), default=0)) if done else 0
        for end, (token, size) in self._automaton.iter(piece[longest:].decode("latin-1")):
            end += longest
            if end < done or last[end] is not None:
                continue
            start = end - size
            if start < 0 or (last[start] is not None and self.follows(last[start], token)):
                last[end] = token
        return last

    def read_back(self, last: list[int]) -> list[int]:
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.bytes_of[ids[-1]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.read_back(self.last_tokens(piece))

    def append(self, last: list[int], piece: bytes, more: bytes) -> list[int]:
        """The table of piece + more from that of piece."""
        return self.last_tokens(piece + more, last)

    def edit(self, last: list[int], piece: bytes, start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """piece with [start, end) replaced, and its table. What lies before the edit is kept; behind it, the old entries are
        taken over as soon as they agree over the length of the longest token."""
        edited = piece[:start] + new + piece[end:]
        table = self.last_tokens(edited[: start + len(new)], last[:start])
        reach, agree, shift = max(map(len, self.ranks)), 0, end - start - len(new)
        while len(table) < len(edited) and agree < reach:
            table = self.last_tokens(edited[: len(table) + 1], table)
            agree = agree + 1 if table[-1] == last[len(table) - 1 + shift] else 0
        return edited, table + last[len(table) + shift :]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(text or ""))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[tuple[str, str], PrefixBPE] = {}


def codec(path: str, pattern: str) -> PrefixBPE:
    """This worker's codec, made once."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = PrefixBPE(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids of every row of docs."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in text_batches(batches):
            ids = [own.encode(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["key", "n_tokens", "ids"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_tokens long, ids array<int>").withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """key, text of every row of `encoded` (key, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            texts = [own.decode(ids or []) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array([t.decode(errors="replace") for t in texts], pa.string())], ["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("key"), "ids").mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 of the decimal ids parted by spaces, decoded_sha256 of the bytes that the ids decode to.

    Encoding and decoding share one pass, so that ids needn't travel through the JVM only to be hashed."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        decimal = {i: str(i) for i in own.bytes_of}
        for batch in text_batches(batches):
            counts, of_ids, of_bytes = [], [], []
            for t in batch["text"]:
                ids = own.encode(t.as_py())
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
