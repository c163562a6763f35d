"""GeoTIFF files as rows of bands, and the files of a scene as one row of scenes.TILES."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.scalar import date_of_filename
from strandline.operators.scenes import _each

#: TIFF field types: struct codes and bytes (fixed values).
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8)}
#: Tags that are read (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, GEO_KEYS, PROJECTED, GEOGRAPHIC = 33550, 33922, 34735, 3072, 2048
#: LZW codes that empty the table and end the data (fixed values).
CLEAR, END = 256, 257


def tags_read(read: Callable[[int, int], bytes]) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of the first image of a file, of which `read(start, length)` gives bytes."""
    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8 or struct.unpack_from(order + "H", head, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, tags = struct.unpack_from(order + "I", head, 4)[0], {}
    fields = read(at + 2, 12 * struct.unpack(order + "H", read(at, 2))[0])
    for k in range(0, len(fields), 12):
        tag, kind, count = struct.unpack_from(order + "HHI", fields, k)
        if kind in _TYPES and kind != 2:
            code, size = _TYPES[kind]
            raw = fields[k + 8 : k + 8 + size * count] if size * count <= 4 else read(struct.unpack_from(order + "I", fields, k + 8)[0], size * count)
            tags[tag] = struct.unpack(order + code * count, raw)
    return order, tags


def tags_of(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of the first image of a file."""
    return tags_read(lambda at, n: data[at : at + n])


def unlzw(data: bytes) -> bytes:
    """Bytes of a strip or tile under LZW: codes of 9 to 12 bits, high bits first, each width left one code early."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, last, width, held, bits, out = list(first), b"", 9, 0, 0, bytearray()
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == CLEAR:
            table, last, width = list(first), b"", 9
            continue
        if code == END:
            break
        if code > len(table) or (code == len(table) and not last):
            raise ValueError("broken LZW data")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last, width = entry, min(12, (len(table) + 1).bit_length())
    return bytes(out)


#: What undoes each compression that is read (fixed values): none, LZW and the two codes of deflate.
_UNPACK = {1: bytes, 5: unlzw, 8: zlib.decompress, 32946: zlib.decompress}


@dataclass(frozen=True)
class Layout:
    """What a header says of a file's parts, which are strips or tiles of one plane or of all bands."""

    order: str
    tags: dict[int, tuple]

    def one(self, tag: int, default: int = 1) -> int:
        return self.tags.get(tag, (default,))[0]

    def __post_init__(self):
        if self.one(COMPRESSION) not in _UNPACK or self.one(PREDICTOR) not in (1, 2, 3):
            raise ValueError("this compression isn't read")

    @property
    def size(self) -> tuple[int, int, int]:
        return self.tags[HEIGHT][0], self.tags[WIDTH][0], self.one(SAMPLES)

    @property
    def kind(self) -> np.dtype:
        return np.dtype(self.order + {1: "u", 2: "i", 3: "f"}[self.one(FORMAT)] + str(self.one(BITS, 8) // 8))

    @property
    def tiled(self) -> bool:
        return TILE_OFFSETS in self.tags

    @property
    def part(self) -> tuple[int, int]:
        height, width, _ = self.size
        return (self.tags[TILE_HEIGHT][0], self.tags[TILE_WIDTH][0]) if self.tiled else (min(height, self.one(ROWS, height)), width)

    @property
    def ranges(self) -> list[tuple[int, int]]:
        """Start and length of every part's bytes."""
        return list(zip(*((self.tags[TILE_OFFSETS], self.tags[TILE_COUNTS]) if self.tiled else (self.tags[OFFSETS], self.tags[COUNTS])), strict=True))

    def place(self, k: int) -> tuple[int, int, int, int, range]:
        """First row and column, rows, columns and bands of part k, as far as they lie in the image."""
        (height, width, samples), (h, w) = self.size, self.part
        across, down = -(-width // w), -(-height // h)
        plane, at = divmod(k, across * down)
        r, c = at // across * h, at % across * w
        return r, c, min(h, height - r), min(w, width - c), range(plane, plane + 1) if self.one(PLANAR) == 2 else range(samples)

    def values(self, k: int, raw: bytes) -> np.ndarray:
        """Rows, columns and bands of part k from its bytes; a part without bytes was never written and is 0."""
        r, c, rows, cols, bands = self.place(k)
        (h, w), depth, kind = self.part, len(bands), self.kind
        if not raw:
            return np.zeros((rows, cols, depth), kind)
        flat = _UNPACK[self.one(COMPRESSION)](raw)
        h = h if self.tiled else rows
        if self.one(PREDICTOR) == 3:  # rows hold the differences of bytes, the highest bytes of all values first
            split = np.cumsum(np.frombuffer(flat, "u1", h * w * depth * kind.itemsize).reshape(h, -1, depth), 1, "u1")
            cube = np.ascontiguousarray(split.reshape(h, kind.itemsize, w * depth).swapaxes(1, 2)).view(kind.newbyteorder(">")).reshape(h, w, depth)
        else:
            cube = np.frombuffer(flat, kind, h * w * depth).reshape(h, w, depth)
            if self.one(PREDICTOR) == 2:
                cube = np.cumsum(cube, 1, kind.newbyteorder("="))
        return cube[:rows, :cols]

    @property
    def georef(self) -> list[float] | None:
        scale, tie = self.tags.get(PIXEL_SCALE), self.tags.get(TIEPOINT)
        return [tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1]] if scale and tie else None

    @property
    def epsg(self) -> int | None:
        keys = np.array(self.tags.get(GEO_KEYS, ()), int).reshape(-1, 4)[1:]
        known = {int(a): int(d) for a, b, _, d in keys if b == 0}
        return known.get(PROJECTED, known.get(GEOGRAPHIC))


def decoded(data: bytes) -> dict:
    """height, width, bands, georef and epsg of a file of strips or tiles: plain, deflated or LZW, with or without a predictor."""
    layout = Layout(*tags_of(data))
    height, width, samples = layout.size
    out = np.zeros((height, width, samples), layout.kind)
    for k, (start, count) in enumerate(layout.ranges):
        r, c, rows, cols, bands = layout.place(k)
        out[r : r + rows, c : c + cols, bands.start : bands.stop] = layout.values(k, data[start : start + count])
    return {"height": height, "width": width, "bands": [out[..., k].ravel().astype(float) for k in range(samples)], "georef": layout.georef, "epsg": layout.epsg}


def geotiffs(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, bands, georef, epsg and error of all .tif files below path; files that can't be read have their error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", True).load(path).select("path", "content")

    def make(row: pd.Series) -> dict:
        return decoded(bytes(row["content"]))

    return _each(files, make, "height int, width int, bands array<array<double>>, georef array<double>, epsg int").drop("content")


def _named(files: DataFrame) -> DataFrame:
    """files with `kind` (ms, pan, swir or mask) and `scene_id` by their names."""
    own = files.withColumn("_n", F.regexp_extract("path", r"([^/]*)\.tif$", 1))
    own = own.withColumn("kind", F.regexp_extract("_n", r"_(ms|pan|swir|mask)(?:_dup\d+)?$", 1))
    return own.withColumn("scene_id", F.regexp_replace("_n", r"_(ms|pan|swir|mask)(?=(_dup\d+)?$)", ""))


def left_out(files: DataFrame) -> DataFrame:
    """scene_id, path, reason: what `scene_tiles` makes no scene of. Files that can't be read, with their error, files whose names say no
    kind, and scenes without a readable ms or mask file (path NULL)."""
    own = _named(files)
    said = F.when(F.col("error").isNotNull(), F.concat(F.lit("unreadable: "), "error")).when(F.col("kind") == "", "no kind of file")
    single = own.select("scene_id", "path", said.alias("reason")).where("reason IS NOT NULL")
    good = lambda kind: F.coalesce(F.bool_or((F.col("kind") == kind) & F.col("error").isNull()), F.lit(False))
    whole = own.where("kind <> ''").groupBy("scene_id").agg(good("ms").alias("ms"), good("mask").alias("mask"))
    missing = F.concat_ws(", ", F.when(~F.col("ms"), "ms"), F.when(~F.col("mask"), "mask"))
    return single.union(whole.where("NOT (ms AND mask)").select("scene_id", F.lit(None).cast("string"), F.concat(F.lit("missing: "), missing)))


def scene_tiles(files: DataFrame) -> DataFrame:
    """scenes.TILES of the files (geotiffs) of scenes named <time>_<mission>_<site>_<kind>.tif: kinds ms, pan, swir and mask, all of the
    grid of ms. A fifth ms band of Sentinel-2 is its cloud probability, and the SWIR band comes from a file of its own. `left_out` says which
    files and scenes are none."""
    own = _named(files).where("error IS NULL")
    of = lambda kind, c: F.first(F.when(F.col("kind") == kind, F.col(c)), ignorenulls=True)
    columns = [of("ms", c).alias(c) for c in ("height", "width", "bands", "georef", "epsg")]
    one = own.groupBy("scene_id").agg(*columns, of("pan", "bands")[0].alias("pan"), of("swir", "bands")[0].alias("_swir"), F.transform(of("mask", "bands")[0], lambda x: x.cast("int")).alias("qa"))
    s2 = F.split("scene_id", "_")[1] == "S2"
    bands = F.when(s2, F.concat(F.slice("bands", 1, 4), F.array("_swir"))).otherwise(F.slice("bands", 1, 5))
    return one.where("bands IS NOT NULL AND qa IS NOT NULL").select(
        "scene_id", F.regexp_extract("scene_id", r"^[^_]*_[^_]*_(.*?)(?:_dup\d+)?$", 1).alias("site"), F.split("scene_id", "_")[1].alias("satname"), date_of_filename(F.col("scene_id")).alias("acq_ts"),
        "height", "width", bands.alias("bands"), "pan", "qa", F.when(s2, F.get("bands", F.lit(4))).alias("cloud_prob"), "georef", "epsg",
    )
