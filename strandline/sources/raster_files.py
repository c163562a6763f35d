"""GeoTIFF files as a Spark data source of tiles: a task reads the parts of its files that the filters leave, by ranges of bytes, and a
sink that streams tiles into tiled files, which show only when all tasks are done.

Paths are local ones or URIs that pyarrow opens (file, hdfs, s3 and others); all executors must reach them.
"""

from __future__ import annotations

import operator
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

from strandline.sources import rasters
from strandline.sources.rasters import Layout, tags_read

#: A tile: its file and what that says of the raster, the band, its place and size, its extent in the raster's system and its pixels.
TILE = (
    "path string, height int, width int, bands int, georef array<double>, epsg int, band int, r0 int, c0 int, rows int, cols int, "
    "x_min double, x_max double, y_min double, y_max double, values array<double>, error string"
)
_ARROW = pa.schema([
    ("path", pa.string()), *((c, pa.int32()) for c in ("height", "width", "bands")), ("georef", pa.list_(pa.float64())), *((c, pa.int32()) for c in ("epsg", "band", "r0", "c0", "rows", "cols")),
    *((c, pa.float64()) for c in ("x_min", "x_max", "y_min", "y_max")), ("values", pa.list_(pa.float64())), ("error", pa.string()),
])
#: Bytes of files that a task reads.
SPLIT = 64 << 20
#: Bytes at a file's beginning that are read at once, as most headers lie there.
HEAD = 16 << 10
_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda a, b: a in b}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class Ranged:
    """A file of which ranges of bytes are read; its beginning is kept."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.file = system.open_input_file(path)
        self.head = self.fetch(0, HEAD)

    def fetch(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def read(self, at: int, length: int) -> bytes:
        return self.head[at : at + length] if at + length <= len(self.head) else self.fetch(at, length)


@dataclass
class Share(InputPartition):
    """Files, and which of how many shares of each one's parts."""

    files: list[tuple[str, int, int]]


def satisfied(filters: Iterable[Filter], known: dict) -> bool:
    """Whether a tile's description meets all filters; what is unknown meets none but IS NULL."""
    for f in filters:
        value = known.get(f.attribute[0])
        if isinstance(f, (IsNull, IsNotNull)):
            if (value is None) != isinstance(f, IsNull):
                return False
        elif value is None or not _COMPARED[type(f)](value, f.value):
            return False
    return True


class TileReader(DataSourceReader):
    """Filters on anything but the pixels are met before a part's bytes are read, those on `path` before its file is opened."""

    def __init__(self, options: dict):
        self.path, self.split, self.pixels = options["path"], int(options.get("split", SPLIT)), str(options.get("pixels", "true")).lower() == "true"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        names = set(_ARROW.names) - {"values", "georef"}
        for f in filters:
            if type(f) in (*_COMPARED, IsNull, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in names:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Share]:
        """Small files share a task, large ones are dealt to several; only names and sizes are looked up here."""
        system, root = file_system(self.path)
        found = system.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        own = [f for f in self.filters if f.attribute[0] == "path"]
        files = sorted((f.path, f.size or 0) for f in files if f.type == fs.FileType.File and f.path.endswith(".tif") and "/_" not in f.path[len(root) :] and satisfied(own, {"path": f.path}))
        shares, held, size = [], [], 0
        for path, length in files:
            pieces = max(1, -(-length // self.split))
            if pieces > 1:
                shares += [Share([(path, k, pieces)]) for k in range(pieces)]
                continue
            if held and size + length > self.split:
                shares.append(Share(held))
                held, size = [], 0
            held, size = [*held, (path, 0, 1)], size + length
        return shares + [Share(held)] if held or not shares else shares

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        for path, share, shares in partition.files:
            try:
                for row in self.tiles(Ranged(system, path), path, share, shares):
                    yield pa.RecordBatch.from_pylist([row], _ARROW)
            except Exception as problem:  # a file that can't be read is a row with its reason, once
                known = {"path": path, "error": str(problem) or type(problem).__name__}
                if share == 0 and satisfied(self.filters, known):
                    yield pa.RecordBatch.from_pylist([known], _ARROW)

    def tiles(self, file: Ranged, path: str, share: int, shares: int) -> Iterator[dict]:
        layout = Layout(*tags_read(file.read))
        (height, width, samples), g, ranges = layout.size, layout.georef, layout.ranges
        raster = {"path": path, "height": height, "width": width, "bands": samples, "georef": g, "epsg": layout.epsg}
        for k in range(len(ranges) * share // shares, len(ranges) * (share + 1) // shares):
            r, c, rows, cols, bands = layout.place(k)
            known = {**raster, "r0": r, "c0": c, "rows": rows, "cols": cols}
            if g:
                x, y = (g[0] + c * g[1], g[0] + (c + cols) * g[1]), (g[3] + r * g[5], g[3] + (r + rows) * g[5])
                known |= {"x_min": min(x), "x_max": max(x), "y_min": min(y), "y_max": max(y)}
            wanted = [b for b in bands if satisfied(self.filters, {**known, "band": b})]
            if not wanted:
                continue
            cube = layout.values(k, file.read(*ranges[k]) if ranges[k][1] else b"") if self.pixels else None
            for b in wanted:
                yield {**known, "band": b, "values": None if cube is None else cube[..., b - bands.start].ravel().astype(float)}


@dataclass
class Finished(WriterCommitMessage):
    """Files that a task has finished, in a folder of its own."""

    folder: str
    names: list[str]


class TileWriter(DataSourceArrowWriter):
    """Tiles in the order of `tiles_written` become files, a tile at a time; they move to their place when all tasks are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.tile, self.kind, self.overwrite = options["path"], int(options.get("tile", 256)), np.dtype(options.get("kind", "f8")).newbyteorder("<"), overwrite
        self.hidden = f"_writing-{uuid.uuid4().hex}"
        if self.tile % 16:
            raise ValueError("tiles of a file have sides that 16 divides")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Finished:
        system, root = file_system(self.path)
        folder, names, out = f"{root}/{self.hidden}/{uuid.uuid4().hex}", [], None
        system.create_dir(folder, recursive=True)
        for batch in iterator:
            for row in range(batch.num_rows):
                own = {c: batch.column(c)[row] for c in ("path", "height", "width", "bands", "georef", "epsg", "band", "r0", "c0", "rows", "cols", "values")}
                own = {c: v.values.to_numpy(zero_copy_only=False) if c == "values" and v.is_valid else v.as_py() for c, v in own.items()}
                name = own["path"].rsplit("/", 1)[-1]
                if out is None or out.name != name:
                    if out is not None:
                        out.close()
                    names.append(name)
                    out = TiledFile(system, folder, name, own, self.tile, self.kind)
                out.add(own)
        if out is not None:
            out.close()
        return Finished(folder, names)

    def commit(self, messages: list[Finished | None]) -> None:
        system, root = file_system(self.path)
        done = [(m.folder, n) for m in messages if m is not None for n in m.names]
        if len({n for _, n in done}) < len(done):
            self.abort(messages)
            raise ValueError("a file's tiles came from several tasks or apart from each other: write through tiles_written")
        for folder, name in done:
            if not self.overwrite and system.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                self.abort(messages)
                raise ValueError(f"{name} exists")
        for folder, name in done:
            system.move(f"{folder}/{name}", f"{root}/{name}")
        system.delete_dir(f"{root}/{self.hidden}")

    def abort(self, messages: list[Finished | None]) -> None:
        system, root = file_system(self.path)
        if system.get_file_info(f"{root}/{self.hidden}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.hidden}")


#: Field codes of tags that are written (fixed values): short, long and double.
_FIELDS = {"H": 3, "I": 4, "d": 12}


class TiledFile:
    """A file of plain tiles, a plane a band, written front to back, as object stores ask. Tiles are of one size, so the directory that
    comes first knows where all will lie. Tiles that don't come are 0; NULL pixels are NaN in files of floats and 0 in others."""

    def __init__(self, system: fs.FileSystem, folder: str, name: str, raster: dict, tile: int, kind: np.dtype):
        self.name, self.raster, self.tile, self.kind, self.next = name, raster, tile, kind, 0
        self.across, self.down = -(-raster["width"] // tile), -(-raster["height"] // tile)
        self.count, self.length = raster["bands"] * self.across * self.down, tile * tile * kind.itemsize
        self.out = system.open_output_stream(f"{folder}/{name}")
        self.out.write(self.directory())

    def directory(self) -> bytes:
        g, n = self.raster["georef"], self.raster["bands"]
        fields = {rasters.WIDTH: ("I", [self.raster["width"]]), rasters.HEIGHT: ("I", [self.raster["height"]]), rasters.BITS: ("H", [8 * self.kind.itemsize] * n), rasters.COMPRESSION: ("H", [1])}
        fields |= {rasters.SAMPLES: ("H", [n]), rasters.PLANAR: ("H", [2]), rasters.TILE_WIDTH: ("I", [self.tile]), rasters.TILE_HEIGHT: ("I", [self.tile]), rasters.FORMAT: ("H", [{"u": 1, "i": 2, "f": 3}[self.kind.kind]] * n)}
        if g:
            fields |= {rasters.PIXEL_SCALE: ("d", [g[1], -g[5], 0.0]), rasters.TIEPOINT: ("d", [0.0, 0.0, 0.0, g[0], g[3], 0.0])}
        if self.raster["epsg"]:
            geographic = 4000 <= self.raster["epsg"] < 5000
            fields[rasters.GEO_KEYS] = "H", [1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, rasters.GEOGRAPHIC if geographic else rasters.PROJECTED, 0, 1, self.raster["epsg"]]
        start = 8 + 2 + 12 * (len(fields) + 2) + 4
        body = start + sum(struct.calcsize("<" + c * len(v)) for c, v in fields.values()) + 8 * self.count
        if body + self.count * self.length >= 1 << 32:
            raise ValueError(f"{self.name}: more than a file of this format holds")
        fields |= {rasters.TILE_OFFSETS: ("I", [body + k * self.length for k in range(self.count)]), rasters.TILE_COUNTS: ("I", [self.length] * self.count)}
        entries, beyond = b"", b""
        for tag, (code, values) in sorted(fields.items()):
            raw = struct.pack("<" + code * len(values), *values)
            place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", start + len(beyond))
            beyond += raw if len(raw) > 4 else b""
            entries += struct.pack("<HHI", tag, _FIELDS[code], len(values)) + place
        return (b"II" + struct.pack("<HIH", 42, 8, len(fields)) + entries + b"\0" * 4 + beyond).ljust(body, b"\0")

    def add(self, own: dict) -> None:
        raster = self.raster
        if own["r0"] % self.tile or own["c0"] % self.tile or not 0 <= own["band"] < raster["bands"] or [own[c] for c in ("height", "width", "bands")] != [raster[c] for c in ("height", "width", "bands")]:
            raise ValueError(f"{self.name}: a tile isn't on the file's grid")
        k = (own["band"] * self.down + own["r0"] // self.tile) * self.across + own["c0"] // self.tile
        if k < self.next:
            raise ValueError(f"{self.name}: tiles come twice or out of order")
        values = np.asarray(own["values"], float).reshape(own["rows"], own["cols"])
        whole = np.zeros((self.tile, self.tile), self.kind)
        whole[: own["rows"], : own["cols"]] = values if self.kind.kind == "f" else np.nan_to_num(values)
        self.blank(k)
        self.out.write(whole.tobytes())
        self.next = k + 1

    def blank(self, until: int) -> None:
        for _ in range(self.next, until):
            self.out.write(b"\0" * self.length)

    def close(self) -> None:
        self.blank(self.count)
        self.out.close()


class GeoTiffTiles(DataSource):
    """Format "geotiff_tiles": reads and appends TILE. Options: path; reading: split (bytes a task), pixels (false: headers alone);
    writing: tile (side, 256) and kind (a numpy type, f8)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff_tiles"

    def schema(self) -> str:
        return TILE

    def reader(self, schema) -> TileReader:
        return TileReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TileWriter:
        return TileWriter(dict(self.options), overwrite)


def tiles_of_files(spark: SparkSession, path: str, pixels: bool = True, split: int = SPLIT) -> DataFrame:
    """TILE of all .tif files at or below path: a row a band of each strip or tile, in the files' own cut.

    Filters on everything but the pixels and the georeference are pushed down: a window (x_max > a AND x_min < b ...) of one band reads
    the byte ranges that hold it, and of files whose bands lie apart no other band's. Without `pixels`, headers alone are read and values
    is NULL. A file that can't be read is one row with its error. Files in folders whose names begin with _ don't count. No file: no row."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiffTiles)
    return spark.read.format("geotiff_tiles").options(path=path, pixels=str(pixels).lower(), split=split).load()


def tiles_of_pixels(pixels: DataFrame, by: list[str], value: str, tile: int = 256) -> DataFrame:
    """by, r0, c0, rows, cols, values of pixels (by, r, c, value): squares of `tile`, cut off after their last pixel. Pixels that have no
    row are NULL; of rows that share a pixel the largest value counts, and rows without a place go."""
    own = pixels.where("r IS NOT NULL AND c IS NOT NULL").withColumns({f"_{c}0": (F.floor(F.col(c) / tile) * tile).cast("int") for c in "rc"})
    one = own.groupBy(*by, "_r0", "_c0", "r", "c").agg(F.max(value).cast("double").alias("_v"))
    sides = {"rows": (F.max("r") + 1 - F.col("_r0")).cast("int"), "cols": (F.max("c") + 1 - F.col("_c0")).cast("int")}
    packed = F.map_from_entries(F.collect_list(F.struct(((F.col("r") - F.col("_r0")) * tile + F.col("c") - F.col("_c0")).cast("int"), "_v")))
    made = one.groupBy(*by, "_r0", "_c0").agg(packed.alias("_p"), *(c.alias(n) for n, c in sides.items()))
    at = lambda k: (F.floor(k / F.col("cols")) * tile + k % F.col("cols")).cast("int")
    values = F.transform(F.sequence(F.lit(0), F.col("rows") * F.col("cols") - 1), lambda k: F.element_at("_p", at(k)))
    return made.select(*by, F.col("_r0").alias("r0"), F.col("_c0").alias("c0"), "rows", "cols", values.alias("values"))


def tiles_written(tiles: DataFrame, path: str, tile: int = 256, kind: str = "f8", overwrite: bool = False) -> None:
    """Tiles (path, height, width, bands, georef, epsg, band, r0, c0, rows, cols, values) as files of the last part of `path`.

    Tiles lie on a grid of `tile` from the raster's first pixel. A file is one task's stream, sorted by place, of which it holds one
    tile; the format ends at 4 GB a file. Files appear when all tasks are done; after a failure none does. A name that exists is an
    error unless `overwrite` (of that file alone)."""
    spark = tiles.sparkSession
    spark.dataSource.register(GeoTiffTiles)
    given = set(tiles.columns)
    fields = [c.split() for c in TILE.split(", ")]
    own = tiles.select(*((F.col(f"`{n}`") if n in given and n != "error" else F.lit(None)).cast(t).alias(n) for n, t in fields))
    own = own.withColumn("_name", F.substring_index("path", "/", -1)).repartition("_name").sortWithinPartitions("_name", "band", "r0", "c0").drop("_name")
    own.write.format("geotiff_tiles").options(path=path, tile=tile, kind=kind).mode("overwrite" if overwrite else "append").save()
