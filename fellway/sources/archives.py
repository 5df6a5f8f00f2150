"""Shape layers inside zip archives as tables.

A member of up to ``WHOLE_BYTES`` is read straight out of its archive, in a task of its own,
so nothing unpacked lies on disk. A larger one is copied out of it as a stream, one task a
member, into the shared folder; no archive is held in memory. It is then read in parts:
its index file says where each record begins, so a part of ``PART_RECORDS`` records
reads its own stretch of the shapes and of the attribute table, in a task of its own.

Either way records become columns by whole arrays, some ``BATCH`` of them at once.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import kept, shared_dir
from .files import reading, writing

#: Records of a layer that one task reads, bytes of a member's files that are unpacked in memory at most, and bytes of a member that are copied at once.
PART_RECORDS, WHOLE_BYTES, COPY_BYTES = 50_000, 32 << 20, 8 << 20
#: Features sent to Spark at once, and about the most bytes that their shapes have.
BATCH, BATCH_BYTES = 2000, 4 << 20
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_PART = pa.struct([("kind", pa.string()), ("points", pa.list_(_POINT))])
_FEATURES = pa.schema([
    ("archive", pa.string()), ("member", pa.string()), ("gid", pa.int64()), ("attributes", pa.map_(pa.string(), pa.string())), ("parts", pa.list_(_PART)),
    *((c, pa.float64()) for c in ("min_x", "min_y", "max_x", "max_y")),
])
FEATURES = "archive string, member string, gid bigint, attributes map<string,string>, parts array<struct<kind:string,points:array<struct<x:double,y:double>>>>, min_x double, min_y double, max_x double, max_y double"
#: Shape types of the format, with or without heights and measures.
_LINES, _POLYGONS = (3, 13, 23), (5, 15, 25)
_HEAD = np.dtype([("box", "<f8", 4), ("parts", "<i4"), ("points", "<i4")])


def _gathered(data: memoryview, at: np.ndarray, size: np.ndarray | int) -> bytes:
    """Stretches of bytes, one after the other."""
    stop = at + size
    if len(at) and int(stop.max()) > len(data):
        raise ValueError("a record goes on beyond the end of its file")
    return b"".join([data[a:b] for a, b in zip(at.tolist(), stop.tolist())])


def _shapes(data: memoryview, at: np.ndarray) -> list[pa.Array]:
    """Parts and boxes of the records at some places; null shapes have no parts and no box."""
    kind = np.frombuffer(_gathered(data, at + 8, 4), "<i4")
    known = np.flatnonzero(np.isin(kind, _LINES + _POLYGONS))
    head = np.frombuffer(_gathered(data, at[known] + 12, _HEAD.itemsize), _HEAD)
    parts, points = head["parts"].astype(np.int64), head["points"].astype(np.int64)
    starts = np.frombuffer(_gathered(data, at[known] + 52, 4 * parts), "<i4")
    xy = np.frombuffer(_gathered(data, at[known] + 52 + 4 * parts, 16 * points), "<f8").reshape(-1, 2)
    # The first part begins with the first point, the last one ends with the last.
    held = np.maximum(parts, 1)
    owner, first = np.repeat(np.arange(len(held)), held), np.cumsum(held) - held
    begin = np.zeros(len(owner), np.int64)
    later = np.ones(len(starts), bool)
    later[(np.cumsum(parts) - parts)[parts > 0]] = False
    begin[np.arange(len(owner)) != first[owner]] = starts[later]
    begin = np.clip(begin, 0, points[owner])
    stop = np.append(begin[1:], 0)
    stop[first + held - 1] = points
    size = np.maximum(stop - begin, 0)
    if size.sum() != len(xy):
        # Parts that overlap or run backwards.
        xy = xy[np.repeat((np.cumsum(points) - points)[owner] + begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    names = pa.array(["line", "polygon"]).take(pa.array(np.isin(kind[known], _POLYGONS).astype(np.int8)[owner]))
    lines = pa.ListArray.from_arrays(offsets(size), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k])) for k in (0, 1)], fields=list(_POINT)))
    count, box, none = np.zeros(len(at), np.int64), np.zeros((len(at), 4)), np.ones(len(at), bool)
    count[known], box[known], none[known] = held, head["box"], False
    return [pa.ListArray.from_arrays(offsets(count), pa.StructArray.from_arrays([names, lines], fields=list(_PART))), *(pa.array(np.ascontiguousarray(box[:, k]), mask=none) for k in range(4))]


class Attributes:
    """The attribute table beside a shape file: fixed-width rows, read by ranges."""

    def __init__(self, file, encoding: str):
        self.file, self.encoding = file, encoding
        self.count, self.head, self.width = struct.unpack_from("<IHH", file.read_at(32, 0), 4)
        fields, at, place = file.read_at(self.head, 0), 32, 1
        self.fields = {}
        while fields[at] != 0x0D:
            self.fields[fields[at : at + 11].split(b"\0")[0].decode("ascii")] = place, fields[at + 16]
            place, at = place + fields[at + 16], at + 32

    def rows(self, first: int, n: int) -> pa.MapArray:
        """Fields of records; blank ones are null."""
        data = self.file.read_at(n * self.width, self.head + first * self.width).ljust(n * self.width, b"\0")
        cells = np.frombuffer(data, np.uint8).reshape(n, self.width)
        columns = [pa.array([], pa.string())]
        for at, size in self.fields.values():
            own = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), n, [None, pa.py_buffer(cells[:, at : at + size].tobytes())]).dictionary_encode()
            columns.append(pa.array([v.decode(self.encoding, "replace").strip(" \0") or None for v in own.dictionary.to_pylist()], pa.string()).take(own.indices))
        m = len(self.fields)
        values = pa.concat_arrays(columns).take(pa.array(np.arange(n * m).reshape(m, n).T.ravel()))
        return pa.MapArray.from_arrays(pa.array(m * np.arange(n + 1), pa.int32()), pa.array(list(self.fields) * n, pa.string()), values)


MEMBERS = "archive string, member string, bytes bigint, n bigint"
COPIES = f"{MEMBERS}, copy string, encoding string"
_COPIES = pa.schema([("archive", pa.string()), ("member", pa.string()), ("bytes", pa.int64()), ("n", pa.int64()), ("copy", pa.string()), ("encoding", pa.string())])
_FILES = (".shp", ".shx", ".dbf")


def _beside(held: zipfile.ZipFile, member: str) -> dict[str, str | None]:
    """The files of a member by ending, whose case may differ; null where there is none."""
    names = {n.lower(): n for n in held.namelist()}
    return {ending: names.get(member[:-4].lower() + ending) for ending in (*_FILES, ".cpg")}


def _encoding(held: zipfile.ZipFile, names: dict[str, str | None]) -> str:
    return held.read(names[".cpg"]).decode("ascii").strip() if names[".cpg"] else "utf-8"


def layer_members(archives: DataFrame, prefix: str) -> DataFrame:
    """(archive, member, bytes, n): the shape files of a layer in each archive (path), what they and the files beside them have unpacked, and their records.

    An archive without the layer, or a layer without its attribute table or its index,
    ends the read with an error.
    """
    schema = pa.schema(list(_COPIES)[:4])

    def listed(batches):
        for batch in batches:
            out = []
            for archive in batch.column("path").to_pylist():
                with reading(archive) as f, zipfile.ZipFile(f) as held:
                    found = [n for n in held.namelist() if n.lower().endswith(".shp") and os.path.basename(n).startswith(prefix)]
                    if not found:
                        raise FileNotFoundError(f"no shape file of layer {prefix} in {archive}")
                    for member in found:
                        names = _beside(held, member)
                        for ending, what in ((".dbf", "attribute table"), (".shx", "index")):
                            if names[ending] is None:
                                raise FileNotFoundError(f"{member} in {archive} has no {what}")
                        size = {ending: held.getinfo(names[ending]).file_size for ending in _FILES}
                        out.append((archive, member, sum(size.values()), (size[".shx"] - 100) // 8))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, schema.types)], schema=schema)

    return archives.select("path").mapInArrow(listed, MEMBERS)


def _tasks(df: DataFrame) -> int:
    """A stated number of partitions, which Spark does not merge: their rows are small, but what they name is not."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def extracted(members: DataFrame, folder: str) -> DataFrame:
    """Members with ``copy`` and ``encoding``: each and the files beside it copied to the folder, a stretch at a time.

    ``copy`` is the path of the copies without their endings.
    """

    def copied(batches):
        for batch in batches:
            copies, encodings = [], []
            for archive, member in zip(*(batch.column(c).to_pylist() for c in ("archive", "member"))):
                copies.append(f"{folder}/{uuid.uuid4().hex}")
                with reading(archive) as f, zipfile.ZipFile(f) as held:
                    names = _beside(held, member)
                    for ending in _FILES:
                        with held.open(names[ending]) as source, writing(copies[-1] + ending) as target:
                            while part := source.read(COPY_BYTES):
                                target.write(part)
                    encodings.append(_encoding(held, names))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(copies, pa.string()), pa.array(encodings, pa.string())], schema=_COPIES)

    return members.repartition(_tasks(members), "archive", "member").mapInArrow(copied, COPIES)


@contextmanager
def _opened(archive: str, member: str, copy: str | None, encoding: str | None):
    """(shapes, index, attributes) of a member: of its copy, or, where there is none, unpacked in memory."""
    with ExitStack() as open_:
        if copy is not None:
            shp, shx, dbf = (open_.enter_context(reading(copy + ending)) for ending in _FILES)
        else:
            with reading(archive) as f, zipfile.ZipFile(f) as held:
                names = _beside(held, member)
                shp, shx, dbf = (pa.BufferReader(held.read(names[ending])) for ending in _FILES)
                encoding = _encoding(held, names)
        yield shp, shx, Attributes(dbf, encoding)


def _stretch(shp, place: np.ndarray, size: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The bytes of records, and where each begins in them: one read, unless they lie far apart, as records need not lie in the order of the index."""
    begin, stop = int(place.min()), int((place + size).max())
    if stop - begin <= 2 * int(size.sum()):
        return memoryview(shp.read_at(stop - begin, begin)), place - begin
    each = [shp.read_at(n, at) for at, n in zip(place.tolist(), size.tolist())]
    if sum(map(len, each)) < size.sum():
        raise ValueError("a record goes on beyond the end of its file")
    return memoryview(b"".join(each)), np.cumsum(size) - size


def _features(archive: str, member: str, files: tuple, first: int, n: int, most: int) -> Iterator[pa.RecordBatch]:
    """Some records of a member, at most ``most`` at once."""
    shp, shx, attributes = files
    index = np.frombuffer(shx.read_at(8 * n, 100 + 8 * first), ">i4").reshape(-1, 2).astype(np.int64) * 2
    place, size = index[:, 0], index[:, 1] + 8
    before, at = np.concatenate([[0], np.cumsum(size)]), 0
    while at < len(index):
        stop = min(at + most, max(at + 1, int(np.searchsorted(before, before[at] + BATCH_BYTES, "right")) - 1))
        parts, *box = _shapes(*_stretch(shp, place[at:stop], size[at:stop]))
        named = [pa.array([name] * (stop - at), pa.string()) for name in (archive, member)]
        yield pa.RecordBatch.from_arrays([*named, pa.array(np.arange(first + at, first + stop)), attributes.rows(first + at, stop - at), parts, *box], schema=_FEATURES)
        at = stop


def read_shape_layer(spark: SparkSession, path: str, prefix: str, part_records: int = PART_RECORDS) -> DataFrame:
    """Features of one layer (the start of its file names) of all zip archives under a path.

    Columns: archive, member, gid (the place in the file), attributes, parts and the
    stored box.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")
    members = kept(layer_members(files, prefix), "members")
    none = F.lit(None).cast("string")
    parts = members.filter(F.col("bytes") <= WHOLE_BYTES).select("archive", "member", none.alias("copy"), none.alias("encoding"), F.lit(0).cast("long").alias("first"), F.col("n").alias("size"))
    large = members.filter(F.col("bytes") > WHOLE_BYTES)
    if not large.isEmpty():
        # Written, so that each member is copied once whatever reads it.
        copies = kept(extracted(large, f"{shared_dir(spark)}/copies-{uuid.uuid4().hex}"), "copies")
        step = F.lit(part_records).cast("long")
        cut = copies.filter("n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step)).alias("first"))
        parts = parts.unionByName(cut.select("archive", "member", "copy", "encoding", "first", F.least(step, F.col("n") - F.col("first")).alias("size")))
    most = min(BATCH, part_records)

    def read(batches):
        for batch in batches:
            for archive, member, copy, encoding, first, size in zip(*(batch.column(c).to_pylist() for c in ("archive", "member", "copy", "encoding", "first", "size"))):
                with _opened(archive, member, copy, encoding) as opened:
                    yield from _features(archive, member, opened, first, size, most)

    # Dealt in turn: members and parts have about one size, and each is some work.
    return parts.filter("size > 0").repartition(_tasks(parts)).mapInArrow(read, FEATURES)


def _packed(kind: int, parts: np.ndarray, sizes: np.ndarray, points: np.ndarray) -> tuple[bytes, bytes]:
    """The records of shapes and of their index, from the parts of each feature, the points of each part and all points."""
    n, owner = len(parts), np.repeat(np.arange(len(parts)), parts)
    held = np.bincount(owner, sizes, n).astype(np.int64)
    some = held > 0
    sizes, owner, parts = sizes[some[owner]], owner[some[owner]], np.where(some, parts, 0)
    size = np.where(some, 44 + 4 * parts + 16 * held, 4)
    at = np.concatenate([[0], np.cumsum(8 + size)])
    out = np.zeros(at[-1], np.uint8)

    def put(where: np.ndarray, values: np.ndarray) -> None:
        out[where[:, None] + np.arange(values.dtype.itemsize)] = values.view(np.uint8).reshape(len(values), values.dtype.itemsize)

    head = np.zeros(n, [("number", ">i4"), ("words", ">i4")])
    head["number"], head["words"] = np.arange(1, n + 1), size // 2
    put(at[:-1], head)
    box = np.zeros(int(some.sum()), [("kind", "<i4"), ("box", "<f8", 4), ("parts", "<i4"), ("points", "<i4")])
    first = (np.cumsum(held) - held)[some]
    if len(box):
        box["box"] = np.concatenate([np.minimum.reduceat(points, first), np.maximum.reduceat(points, first)], axis=1)
    box["kind"], box["parts"], box["points"] = kind, parts[some], held[some]
    put(at[:-1][some] + 8, box)
    nth = np.arange(len(sizes)) - (np.cumsum(parts) - parts)[owner]
    begin = np.cumsum(sizes) - sizes
    put(at[owner] + 52 + 4 * nth, (begin - (np.cumsum(held) - held)[owner]).astype("<i4"))
    of = np.repeat(np.arange(n), held)
    put(at[of] + 52 + 4 * parts[of] + 16 * (np.arange(len(points)) - (np.cumsum(held) - held)[of]), np.ascontiguousarray(points, "<f8").view([("x", "<f8"), ("y", "<f8")]).ravel())
    index = np.zeros(n, [("place", ">i4"), ("words", ">i4")])
    index["place"], index["words"] = (100 + at[:-1]) // 2, size // 2
    return out.tobytes(), index.tobytes()


def _layer_files(kind: int, parts: np.ndarray, sizes: np.ndarray, points: np.ndarray, names: list[str], columns: list[list[str | None]], width: int) -> dict[str, bytes]:
    body, index = _packed(kind, parts, sizes, points)
    header = lambda data: struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, (100 + len(data)) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8) + data
    head = 33 + 32 * len(names)
    table = struct.pack("<B3BIHH20x", 3, 126, 1, 1, len(parts), head, 1 + width * len(names)) + b"".join(n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([width]) + bytes(15) for n in names) + b"\r"
    cells = [[(v or "").encode()[:width].ljust(width) for v in column] for column in columns]
    table += b"".join(b" " + b"".join(row) for row in zip(*cells))
    return {".shp": header(body), ".shx": header(index), ".dbf": table, ".cpg": b"UTF-8"}


def shape_files(kind: int, features: list[list[list[tuple[float, float]]]], names: list[str], rows: list[list[str | None]], width: int = 24) -> dict[str, bytes]:
    """The files of a layer by ending: its shapes (each a list of parts), their index, and their attributes as text."""
    parts, sizes = (np.array(n, np.int64) for n in ([*map(len, features)], [len(p) for f in features for p in f]))
    points = np.array([p for f in features for part in f for p in part], np.float64).reshape(-1, 2)
    return _layer_files(kind, parts, sizes, points, names, [[r[k] for r in rows] for k in range(len(names))], width)


def write_archives(features: DataFrame, folder: str, layer: str, kind: int, fields: list[str], width: int = 24) -> DataFrame:
    """Writes features (archive, gid, parts as arrays of points x, y, and the fields) as one zip archive for each ``archive`` and returns the paths."""
    schema = pa.schema([("path", pa.string())])

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("gid").combine_chunks()
        outer = table.column("parts").combine_chunks()
        inner = outer.flatten()
        points = inner.flatten()
        lengths = lambda lists: np.asarray(lists.value_lengths().fill_null(0), np.int64)
        xy = np.stack([np.asarray(points.field(c), np.float64) for c in ("x", "y")], axis=1)
        files = _layer_files(kind, lengths(outer), lengths(inner), xy, fields, [table.column(f).to_pylist() for f in fields], width)
        packed, path = io.BytesIO(), f"{folder}/{table.column('archive')[0].as_py()}.zip"
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as held:
            for ending, content in files.items():
                held.writestr(f"data/{layer}_1{ending}", content)
        with writing(path) as f:
            f.write(packed.getvalue())
        return pa.table([[path]], schema=schema)

    return features.select("archive", "gid", "parts", *fields).groupBy("archive").applyInArrow(write, "path string")


def with_fields(features: DataFrame, *names: str) -> DataFrame:
    """Attributes as columns of their own; one that the layer lacks is null."""
    return features.select("*", *(F.col("attributes")[n].alias(n) for n in names))
