"""Operator 5: token ids in sorted-string-table shards.

A shard is one file: blocks of entries in key order, then a sparse index, a Bloom filter and a footer. Inside a block a key is
stored as the number of bytes that it shares with the key before and the rest; its value is the document's ids as little-endian
unsigned integers of 2 or 4 bytes. The index names the first key, place, length and CRC of each block, so a lookup asks the Bloom
filter, bisects the index and reads one block.

    shard  := block* index bloom footer
    entry  := varint(shared) varint(rest) varint(bytes of value) rest value
    key    := b"" for null, else b"\\x01" + the id as big-endian 64 bits with the sign bit turned

Results: a null or empty text has the end id alone. Rows of one id stay as they are, ordered by their text; rows without an id
come first. Task attempts write to files of their own and only those in the manifest count, so a lost executor does no harm.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.shared import shared_folder, text_batches

MAGIC = b"STRSST01"
FOOTER = struct.Struct("<QQQQQQQB7x8s")  # index at, bytes; bloom at, bytes; documents; ids; bloom hashes; bytes an id; magic
BLOCK_BYTES, BLOOM_BITS_A_KEY, BLOOM_HASHES = 64 << 10, 10, 7


def key_bytes(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def key_value(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while data[at] > 127:
        n |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
    return n | data[at] << shift, at + 1


def _bloom_hash(key: bytes) -> tuple[int, int]:
    """First place and step of a key, small enough that their sums stay below 64 bits."""
    h = xxhash.xxh3_128_intdigest(key)
    return h & (1 << 62) - 1, h >> 64 & (1 << 32) - 1 | 1


def _places(key: bytes, bits: int, hashes: int) -> list[int]:
    first, step = _bloom_hash(key)
    return [(first + k * step) % bits for k in range(hashes)]


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    """Writes entries whose keys don't descend."""

    def __init__(self, file, id_bytes: int = 4):
        self.file, self.at, self.id_bytes = file, 0, id_bytes
        self.block, self.index = bytearray(), []
        self.firsts, self.steps = array("Q"), array("Q")  # 16 bytes a key: the filter is sized when all keys are known
        self.last = self.first = b""
        self.documents = self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian integers of id_bytes bytes."""
        key = key_bytes(doc_id)
        if self.documents and key < self._before:
            raise ValueError("keys must not descend")
        if not self.documents or key != self._before:
            first, step = _bloom_hash(key)
            self.firsts.append(first)
            self.steps.append(step)
        self._before = key
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.last = key
        self.documents += 1
        self.ids += len(ids) // self.id_bytes
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.file.write(bytes(self.block))
            self.index.append((self.first, self.at, len(self.block), zlib.crc32(self.block)))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQI", at, n, crc) for k, at, n, crc in self.index)
        bits = max(64, BLOOM_BITS_A_KEY * len(self.firsts) + 7 & ~7)
        bloom = np.zeros(bits // 8, np.uint8)
        firsts, steps = np.frombuffer(self.firsts, np.uint64), np.frombuffer(self.steps, np.uint64)
        for k in range(BLOOM_HASHES):
            place = (firsts + np.uint64(k) * steps) % np.uint64(bits)
            np.bitwise_or.at(bloom, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        self.file.write(index + bloom.tobytes() + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.documents, self.ids, BLOOM_HASHES, self.id_bytes, MAGIC))


class ShardReader:
    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - FOOTER.size)
        self.index_at, index_bytes, self.bloom_at, bloom_bytes, self.documents, self.ids, self.bloom_hashes, self.id_bytes, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        file.seek(self.index_at)
        data, at, self.blocks = file.read(index_bytes), 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.blocks.append((data[at : at + n], *struct.unpack_from("<QQI", data, at + n)))
            at += n + 20
        self.bloom = file.read(bloom_bytes)

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, place, size, crc = self.blocks[k]
        self.file.seek(place)
        data, at, key = self.file.read(size), 0, b""
        if zlib.crc32(data) != crc:
            raise ValueError("a block is damaged")
        while at < size:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            yield key, np.frombuffer(data, f"<u{self.id_bytes}", n // self.id_bytes, at + rest)
            at += rest + n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        return chain.from_iterable(map(self.block, range(len(self.blocks))))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all rows of one document id."""
        key = key_bytes(doc_id)
        if not self.blocks or not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _places(key, 8 * len(self.bloom), self.bloom_hashes)):
            return []
        k = max(0, bisect.bisect_left([b[0] for b in self.blocks], key) - 1)
        found = []
        while k < len(self.blocks) and self.blocks[k][0] <= key:
            found += [ids for own, ids in self.block(k) if own == key]
            k += 1
        return found


#: Chunks in each of the cache's two generations and the longest that is kept there; chunks sent to the library in one string.
CACHED_CHUNKS, CACHED_CHARS, JOINED_CHUNKS = 1_200_000, 32, 4096
#: A space between white space and white space, or after white space at the end: there a text can't be cut before the space.
_UNSAFE = re.compile(r"\s (?:\s|$)")


class LibraryEncoder:
    """The tokenizers library's ids of whole texts.

    The library's byte-level pre-tokenizer always starts a new piece at a space that white space doesn't both precede and
    follow, and it encodes each piece by itself. A text may therefore be cut before such spaces, and equal chunks get equal
    ids: each distinct chunk goes through the library once and is then looked up. Chunks that are new go there together in one
    string; as each starts with its only space, its ids start at the only token that starts with one. Texts with other spaces or
    with an added token's string, and tokenizers of another make (a normalizer, another pre-tokenizer), go through whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:
            made = json.load(file)
        pre, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
        self.by_chunks = (
            not made.get("normalizer") and not made.get("post_processor") and not made.get("truncation") and not made.get("padding")
            and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("dropout")
        )
        self.added = [t["content"] for t in made.get("added_tokens") or []]
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.spaced = np.zeros(self.size, bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True  # a space's byte-level sign
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of a space and each of `new`, which hold no space."""
        odd = [w for w in new if not w or w[0].isspace()]
        found = dict(zip(odd, self._whole([" " + w for w in odd]), strict=True))
        plain = [w for w in new if w and not w[0].isspace()]
        groups = [plain[k : k + JOINED_CHUNKS] for k in range(0, len(plain), JOINED_CHUNKS)]
        size = self.kind.itemsize
        for words, ids in zip(groups, self._whole([" " + " ".join(g) for g in groups]), strict=True):
            starts = (size * np.flatnonzero(self.spaced[np.frombuffer(ids, self.kind)])).tolist()
            if len(starts) != len(words) or starts[0]:
                found.update(zip(words, self._whole([" " + w for w in words]), strict=True))
            else:
                found.update((w, ids[a:b]) for w, a, b in zip(words, starts, [*starts[1:], len(ids)], strict=True))
        return found

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of self.kind."""
        if not self.by_chunks:
            return self._whole(texts)
        cut = [None if _UNSAFE.search(t) or any(a in t for a in self.added) else t.split(" ") for t in texts]
        heads = iter(self._whole([c.pop(0) for c in cut if c]))
        get = self.young.get
        ids = [None if c is None else list(map(get, c)) for c in cut]
        missed = {w for c, i in zip(cut, ids, strict=True) if i and None in i for w, known in zip(c, i, strict=True) if known is None}
        found = {w: i for w, i in zip(missed, map(self.old.get, missed), strict=True) if i is not None}
        found.update(self._learn(list(missed - found.keys())))
        look, out = found.__getitem__, []
        for t, c, i in zip(texts, cut, ids, strict=True):
            if c is None:
                out += self._whole([t])
            else:
                if None in i:
                    i = [look(w) if known is None else known for w, known in zip(c, i, strict=True)]
                out.append(next(heads) + b"".join(i))
        if len(self.young) + len(found) > CACHED_CHUNKS:
            self.old, self.young = self.young, {}
        self.young.update((w, i) for w, i in found.items() if len(w) <= CACHED_CHARS)
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(i, self.kind).tolist() for i in self.encode_bytes(texts)]


_ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one thread
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


MANIFEST = "shard int, path string, documents long, ids long, bytes long"


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs as shards of ascending keys below `folder`; the manifest (a row for each shard) as a DataFrame.

    Texts are range-partitioned once; each task encodes and writes what it has. The manifest has a row for each partition.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.select("key", "text", F.spark_partition_id().alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, shard, path = library_encoder(tokenizer_path), None, None, ""
        store, base = filesystem(folder)
        stream = None
        for batch in text_batches(batches):
            if writer is None:
                shard = batch["shard"][0].as_py()
                path = f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
                store.create_dir(base, recursive=True)
                stream = store.open_output_stream(path)
                writer = ShardWriter(stream, encoder.kind.itemsize)
                end = np.asarray([end_id], encoder.kind).tobytes()
            for doc_id, ids in zip(batch["key"].to_pylist(), encoder.encode_bytes([t or "" for t in batch["text"].to_pylist()]), strict=True):
                writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            size = stream.tell()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "documents": writer.documents, "ids": writer.ids, "bytes": size}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    manifest = rows.mapInArrow(run, MANIFEST).collect()  # a row for each shard
    return spark.createDataFrame(manifest, MANIFEST)


def read_shards(manifest: DataFrame, folder: str, finish: Callable[[np.ndarray], object] | None = None, schema: str = "ids array<long>") -> DataFrame:
    """doc_id, start (ids before the document, over all shards), n_tokens and what `finish` makes of the ids (else the ids)."""
    by_shard = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spark = manifest.sparkSession
    plan = manifest.withColumn("before", F.coalesce(F.sum("ids").over(by_shard), F.lit(0)).cast("long")).select("path", "before").collect()  # a row for each shard
    shards = spark.createDataFrame(plan, "path string, before long").repartition(max(1, len(plan)))
    names = [part.strip().split()[0] for part in schema.split(",")]
    if len(names) != 1:
        raise ValueError("finish gives one column")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                start = row["before"]
                with store.open_input_file(row["path"]) as file:
                    reader = ShardReader(file)
                    for k in range(len(reader.blocks)):
                        keys, starts, counts, made = [], [], [], []
                        for key, ids in reader.block(k):
                            keys.append(key_value(key))
                            starts.append(start)
                            counts.append(len(ids))
                            made.append(finish(ids) if finish else ids.tolist())
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(made, pa.int64() if finish else pa.list_(pa.int64()))], ["doc_id", "start", "n_tokens", names[0]])

    return shards.mapInArrow(run, f"doc_id long, start long, n_tokens long, {schema}")


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def shard_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Writes docs as shards in the shared folder, reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark: SparkSession = docs.sparkSession
    folder = shared_folder(spark)
    return read_shards(write_shards(docs, tokenizer_path, end_id, folder), folder, ids_crc32, "ids_crc32 long")
