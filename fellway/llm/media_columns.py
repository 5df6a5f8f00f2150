"""Media columns in archive directories, by a custom Spark data source (operator 4).

Format ``media_archive``. Writing: each task appends its payloads, as one-channel
8-bit PNG images 64 samples wide, to one archive file; a member is a fixed header
followed by its image, and an index of offsets ends the file. A file counts only
once the driver has committed its name to the directory's manifest, so repeated
or lost task attempts leave nothing behind that is read. Reading: the driver
plans byte ranges of about ``rangeBytes`` over the manifest's files, each task
seeks to its range, decodes member by member and streams Arrow batches bounded in
bytes. A member that fails is read again from its own offset, alone, a few times;
members read before it are kept.

The directory is a path or URI of any file system that Arrow opens (local or
mounted, HDFS, object stores); the executors and the driver must share it. The
features of a payload are a histogram of its samples and the sums of absolute
steps between neighbours along rows and down columns.

Defined cases: null text is an empty text; a null id is kept as null, by a magic of
its own in the member's header; a payload is the UTF-8 text with zero
bytes up to a positive multiple of 64; equal texts give equal images and rows;
an empty table gives an archive without members.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import time
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ._common import documents, session, shared_dir, small_batches

WIDTH, LEVEL = 64, 1
RANGE_BYTES, BATCH_BYTES, RETRIES = 8 << 20, 8 << 20, 3
#: magic, member id, text bytes, image bytes, checksum of the image
_HEADER = struct.Struct("<4sqqqI")
_MAGIC, _NULL_ID, _END = b"MEM1", b"MEM0", struct.Struct("<qq4s")
_PNG = b"\x89PNG\r\n\x1a\n"
READ_SCHEMA = "doc_id bigint, n_bytes bigint, media_bytes bigint, media_sha256 string, payload binary, histogram array<bigint>, gradients array<bigint>"
BINS = 8


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(payload: bytes, level: int = LEVEL) -> bytes:
    """A grey 8-bit PNG, WIDTH samples wide, without row filters."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows, level)) + _chunk(b"IEND", b"")


def decode_image(image: bytes) -> bytes:
    """The samples of an image that ``encode_image`` made; checks every chunk."""
    if image[:8] != _PNG:
        raise ValueError("not an image")
    at, packed, size = 8, [], (0, 0)
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("a row filter that is not in use here")
    return rows[:, 1:].tobytes()


def sample_features(payload: bytes) -> tuple[list[int], list[int]]:
    """Samples in each of BINS ranges of brightness, and the sums of absolute steps along rows and down columns."""
    samples = np.frombuffer(payload, np.uint8)
    rows = samples.reshape(-1, WIDTH).astype(np.int16)
    steps = [int(np.abs(np.diff(rows, axis=axis)).sum()) for axis in (1, 0)]
    return np.bincount(samples // (256 // BINS), minlength=BINS).tolist(), steps


def storage(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, object store), and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


@dataclass
class _Written(WriterCommitMessage):
    name: str | None
    members: int
    size: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches) -> _Written:
        """Columns doc_id and text; one archive file per task attempt."""
        store, path = storage(self.path)
        name, out, index, at = f"part-{uuid.uuid4().hex}.arc", None, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}")
                raw = (text or "").encode()
                image = encode_image(padded(raw))
                index.append(at)
                out.write(_HEADER.pack(*((_NULL_ID, 0) if doc_id is None else (_MAGIC, doc_id)), len(raw), len(image), zlib.crc32(image)) + image)
                at += _HEADER.size + len(image)
        if out is None:
            return _Written(None, 0, 0)
        with out:
            out.write(np.array(index, "<i8").tobytes())
            out.write(_END.pack(at, len(index), _MAGIC))
        return _Written(name, len(index), at)

    def commit(self, messages) -> None:
        store, path = storage(self.path)
        store.create_dir(path, recursive=True)
        files = [{"name": m.name, "members": m.members, "size": m.size} for m in messages if m and m.name]
        part = f"{path}/manifest-{uuid.uuid4().hex}.json"
        with store.open_output_stream(part + ".tmp") as f:
            f.write(json.dumps(files).encode())
        store.move(part + ".tmp", part)

    def abort(self, messages) -> None:
        store, path = storage(self.path)
        for m in messages:
            if m and m.name and store.get_file_info(f"{path}/{m.name}").type == fs.FileType.File:
                store.delete_file(f"{path}/{m.name}")


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    stop: int


class ArchiveReader(DataSourceReader):
    """Byte-range partitions; a member belongs to the range in which it starts."""

    def __init__(self, path: str, range_bytes: int, retries: int):
        self.path, self.range_bytes, self.retries = path, range_bytes, retries

    def partitions(self) -> list[ByteRange]:
        store, path = storage(self.path)
        ranges = []
        for info in sorted(store.get_file_info(fs.FileSelector(path)), key=lambda i: i.base_name):
            if info.base_name.startswith("manifest-") and info.base_name.endswith(".json"):
                with store.open_input_stream(info.path) as f:
                    for file in json.loads(f.read()):
                        ranges += [ByteRange(file["name"], at, min(at + self.range_bytes, file["size"])) for at in range(0, file["size"], self.range_bytes)]
        return ranges or [ByteRange("", 0, 0)]

    @staticmethod
    def member(f, offset: int) -> tuple[int | None, int, bytes, bytes]:
        """(id, text bytes, image, payload) of the member at an offset of an open file."""
        f.seek(offset)
        magic, doc_id, n_bytes, size, check = _HEADER.unpack(f.read(_HEADER.size))
        image = f.read(size)
        if magic not in (_MAGIC, _NULL_ID) or len(image) != size or zlib.crc32(image) != check:
            raise OSError(f"damaged member at {offset}")
        return None if magic == _NULL_ID else doc_id, n_bytes, image, decode_image(image)

    def read(self, partition: ByteRange):
        if not partition.file:
            return
        store, path = storage(self.path)
        file = f"{path}/{partition.file}"
        opened = None

        def retried(of, *args):
            """Reads with the open file; after a failure the file is opened anew and only this read is repeated."""
            nonlocal opened
            for attempt in range(self.retries + 1):
                try:
                    if opened is None:
                        opened = store.open_input_file(file)
                    return of(opened, *args)
                except (OSError, ValueError, struct.error, zlib.error):
                    opened = None
                    if attempt == self.retries:
                        raise
                    time.sleep(0.05 * 2**attempt)

        rows, held = [], 0
        for offset in retried(_offsets, partition.start, partition.stop):
            doc_id, n_bytes, image, payload = retried(self.member, offset)
            rows.append((doc_id, n_bytes, len(image), hashlib.sha256(image).hexdigest(), payload, *sample_features(payload)))
            held += len(payload)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ.types)], schema=_READ)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ.types)], schema=_READ)


_LONGS = pa.list_(pa.int64())
_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload", pa.binary()), ("histogram", _LONGS), ("gradients", _LONGS)])


def _offsets(f, start: int, stop: int) -> list[int]:
    """Offsets of the members that start in a byte range, from the index at the end of the file."""
    end = f.size()
    f.seek(end - _END.size)
    at, n, _ = _END.unpack(f.read(_END.size))
    f.seek(at)
    offsets = np.frombuffer(f.read(8 * n), "<i8")
    first, last = np.searchsorted(offsets, [start, stop])
    return offsets[first:last].tolist()


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)), int(self.options.get("retries", RETRIES)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def write_archive(docs: DataFrame, path: str) -> None:
    spark = session(docs)
    small_batches(spark)
    spark.dataSource.register(MediaArchive)
    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).write.format("media_archive").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("rangeBytes", str(range_bytes)).load(path)


def features(members: DataFrame) -> DataFrame:
    """Digests of the payload read back and a small description of its samples."""
    last = F.expr(f"substring(payload, -{WIDTH}, {WIDTH})")
    return members.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(last).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.format_string("png%dx%d:h%s:g%s", F.lit(WIDTH), (F.octet_length("payload") / WIDTH).cast("int"), F.array_join("histogram", ","), F.array_join("gradients", ",")).alias("feature"),
    )


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    write_archive(documents(spark, sf_dir), path)
    return features(read_archive(spark, path))
