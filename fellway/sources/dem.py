"""Elevation rasters: the tiles that grids need, and their pixels from PNG files.

Only the tiles that a box or a table of grids needs are opened, and no folder is
listed. ``TileSource`` is a Spark data source (format ``elevation_tiles``) whose
partitions are the tiles of one box; ``needed_pixels`` reads the tiles of any number
of grids, which are named by a table, so that planning is distributed too.
"""

from __future__ import annotations

import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import config as C
from ..functions.geo import decode_elevation, tile_of
from ..functions.text import KEY_PATTERN
from .files import reading, writing

PIXELS = "zoom int, gx bigint, gy bigint, r int, g int, b int"
_PIXELS = pa.schema([("zoom", pa.int32()), ("gx", pa.int64()), ("gy", pa.int64()), ("r", pa.int32()), ("g", pa.int32()), ("b", pa.int32())])


def tiles_of(axes: DataFrame) -> DataFrame:
    """(grid_id, zoom, tile_x, tile_y) of all tiles that touch each grid's box."""
    b = F.col("bbox")
    x0, y0 = tile_of(b["min_lon"], b["max_lat"], "zoom")
    x1, y1 = tile_of(b["max_lon"], b["min_lat"], "zoom")
    columns = axes.select("grid_id", "zoom", F.explode(F.sequence(x0, x1)).alias("tile_x"), y0.alias("y0"), y1.alias("y1"))
    return columns.select("grid_id", "zoom", "tile_x", F.explode(F.sequence("y0", "y1")).alias("tile_y"))


def decode_png(data: bytes) -> np.ndarray:
    """Samples (rows, columns, channels) of an 8-bit RGB or RGBA image that is not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, size = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or colour not in (2, 6) or interlaced:
                raise ValueError("only plain 8-bit RGB or RGBA images are read")
            size = (height, width, 3 if colour == 2 else 4)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    height, width, channels = size
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width * channels + 1)
    return _unfiltered(raw[:, 0], raw[:, 1:].reshape(height, width, channels).astype(np.int32))


def _unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo the filter of each row: whole rows where no pixel needs its left neighbour's result, else by diagonals.

    A pixel follows from those to the left, above, and above to the left, so the pixels
    of a diagonal are independent of each other.
    """
    height, width, channels = lines.shape
    out = np.zeros((height + 1, width + 1, channels), np.int32)
    if not np.isin(kinds, (3, 4)).any():
        for row, kind in enumerate(kinds.tolist()):
            line = lines[row] if kind != 1 else np.cumsum(lines[row], axis=0)
            out[row + 1, 1:] = (line + (out[row, 1:] if kind == 2 else 0)) & 255
        return out[1:, 1:]
    for d in range(height + width - 1):
        rows = np.arange(max(0, d - width + 1), min(height, d + 1))
        cols, kind = d - rows, kinds[rows][:, None]
        left, up, corner = out[rows + 1, cols], out[rows, cols + 1], out[rows, cols]
        p = left + up - corner
        from_left, from_up, from_corner = abs(p - left), abs(p - up), abs(p - corner)
        nearest = np.where((from_left <= from_up) & (from_left <= from_corner), left, np.where(from_up <= from_corner, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, nearest], 0)
        out[rows + 1, cols + 1] = (lines[rows, cols] + guess) & 255
    return out[1:, 1:]


def encode_png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB image (rows, columns, 3) as a PNG file."""
    height, width, _ = rgb.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.zeros((height, 1 + 3 * width), np.uint8)
    rows[:, 1:] = rgb.reshape(height, -1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def tile_path(path: str, zoom: int, x: int, y: int) -> str:
    return path.replace("{z}", str(zoom)).replace("{x}", str(x)).replace("{y}", str(y))


def open_tile(path: str) -> bytes:
    """A tile's file; one that can't be read ends the read, without the key that its path may hold."""
    try:
        with reading(path) as f:
            return f.read()
    except OSError:
        raise FileNotFoundError(f"no elevation tile {re.sub(KEY_PATTERN, r'\1***REDACTED***', path)}") from None


def tile_pixels(path: str, zoom: int, x: int, y: int) -> pa.RecordBatch:
    return _pixels_of(open_tile(tile_path(path, zoom, x, y)), zoom, x, y)


def _pixels_of(content: bytes, zoom: int, x: int, y: int) -> pa.RecordBatch:
    rgb = decode_png(content)
    rows, cols = rgb.shape[:2]
    gy, gx = np.mgrid[y * C.TILE : y * C.TILE + rows, x * C.TILE : x * C.TILE + cols]
    columns = [np.full(rows * cols, zoom, np.int32), gx.ravel().astype(np.int64), gy.ravel().astype(np.int64), *(rgb[..., k].ravel().astype(np.int32) for k in range(3))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_PIXELS)


def _elevations(pixels: DataFrame) -> DataFrame:
    return pixels.select("zoom", "gx", "gy", decode_elevation("r", "g", "b").alias("elev"))


def needed_pixels(axes: DataFrame, path: str) -> DataFrame:
    """(zoom, gx, gy, elev) of the tiles that the grids (with bbox and zoom) need, each tile read once.

    ``path`` names a tile's file by ``{z}``, ``{x}`` and ``{y}``. A missing or damaged
    tile ends the read with an error, as a mosaic with a hole would be wrong.
    """

    def read(batches):
        for batch in batches:
            for zoom, x, y in zip(*(batch.column(c).to_pylist() for c in ("zoom", "tile_x", "tile_y"))):
                yield tile_pixels(path, zoom, x, y)

    tiles = tiles_of(axes).select("zoom", "tile_x", "tile_y").distinct()
    # A stated number of partitions: Spark would merge them, as rows that only name tiles are small.
    tiles = tiles.repartition(int(axes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "zoom", "tile_x", "tile_y")
    return _elevations(tiles.mapInArrow(read, PIXELS))


class _Tile(InputPartition):
    def __init__(self, zoom: int, x: int, y: int):
        self.zoom, self.x, self.y = zoom, x, y


class _TileReader(DataSourceReader):
    def __init__(self, path: str, zoom: int, box: list[float]):
        self.path, self.zoom, self.box = path, zoom, box

    def partitions(self) -> list[_Tile]:
        min_lat, min_lon, max_lat, max_lon = self.box
        n = 2**self.zoom
        across = lambda lon: int((lon + 180.0) / 360.0 * n)
        down = lambda lat: int((1.0 - math.log(math.tan(math.radians(lat)) + 1.0 / math.cos(math.radians(lat))) / math.pi) / 2.0 * n)
        return [_Tile(self.zoom, x, y) for x in range(across(min_lon), across(max_lon) + 1) for y in range(down(max_lat), down(min_lat) + 1)]

    def read(self, partition: _Tile):
        yield tile_pixels(self.path, partition.zoom, partition.x, partition.y)


class TileSource(DataSource):
    """``spark.read.format("elevation_tiles")`` with the options zoom, min_lat, min_lon, max_lat, max_lon: one partition a tile of the box."""

    @classmethod
    def name(cls) -> str:
        return "elevation_tiles"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> _TileReader:
        return _TileReader(self.options["path"], int(self.options["zoom"]), [float(self.options[c]) for c in ("min_lat", "min_lon", "max_lat", "max_lon")])


def box_pixels(spark: SparkSession, path: str, zoom: int, box: dict[str, float]) -> DataFrame:
    """(zoom, gx, gy, elev) of the tiles of one box, by the data source."""
    spark.dataSource.register(TileSource)
    return _elevations(spark.read.format("elevation_tiles").options(zoom=str(zoom), **{k: repr(float(v)) for k, v in box.items()}).load(path))


def write_tiles(pixels: DataFrame, path: str, fill: tuple[int, int, int] = (1, 134, 160)) -> DataFrame:
    """Writes the tiles of pixels (zoom, gx, gy, r, g, b) as PNG files and returns (zoom, tile_x, tile_y).

    Pixels that a tile lacks, also where their colours are null, get the colour ``fill``.
    """
    schema = pa.schema([("zoom", pa.int32()), ("tile_x", pa.int32()), ("tile_y", pa.int32())])

    def write(table: pa.Table) -> pa.Table:
        zoom, x, y = (table.column(c)[0].as_py() for c in ("zoom", "tile_x", "tile_y"))
        rgb = np.empty((C.TILE, C.TILE, 3), np.uint8)
        rgb[:] = fill
        known = table.filter(table.column("r").is_valid())
        gx, gy, *colours = (known.column(c).to_numpy() for c in ("gx", "gy", "r", "g", "b"))
        rgb[gy - y * C.TILE, gx - x * C.TILE] = np.stack(colours, axis=1)
        with writing(tile_path(path, zoom, x, y)) as f:
            f.write(encode_png(rgb))
        return pa.table([[zoom], [x], [y]], schema=schema)

    at = lambda c: F.floor(F.col(c) / C.TILE).cast("int")
    named = pixels.select(F.col("zoom").cast("int"), "gx", "gy", "r", "g", "b", at("gx").alias("tile_x"), at("gy").alias("tile_y"))
    return named.groupBy("zoom", "tile_x", "tile_y").applyInArrow(write, "zoom int, tile_x int, tile_y int")


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(zoom, gx, gy, elev) of all ``.../zoom/x/y.png`` files under a folder: the whole store, listed by Spark; one task decodes whole files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path)
    part = lambda k: F.regexp_extract("path", r"/(\d+)/(\d+)/(\d+)\.png$", k).cast("int")

    def decode(batches):
        for batch in batches:
            for content, zoom, x, y in zip(*(batch.column(c).to_pylist() for c in ("content", "zoom", "x", "y"))):
                yield _pixels_of(content, zoom, x, y)

    return _elevations(files.select("content", part(1).alias("zoom"), part(2).alias("x"), part(3).alias("y")).mapInArrow(decode, PIXELS))
