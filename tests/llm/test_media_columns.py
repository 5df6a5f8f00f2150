"""Media columns: exact round trip, byte ranges, and retries by offset."""

import hashlib
import os
import zlib

import pytest

from fellway.llm import media_columns as media


def texts():
    return ["", None, "a", "x" * 64, "é" * 33, "日本" * 5000, "same", "same", "tail " * 20000]


def plain_png(image):
    """Samples of a grey 8-bit PNG by the format's own rules, all five row filters included."""
    assert image[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, packed = 8, b""
    while at < len(image):
        n, kind = int.from_bytes(image[at : at + 4], "big"), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(image[at + 8 + n : at + 12 + n], "big")
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            assert body[8:] == bytes([8, 0, 0, 0, 0])
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, out, above = zlib.decompress(packed), b"", bytes(width)
    for y in range(height):
        kind, line = raw[y * (width + 1)], bytearray(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        for x in range(width):
            a, b, c = line[x - 1] if x else 0, above[x], above[x - 1] if x else 0
            nearest = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line[x] = (line[x] + [0, a, b, (a + b) // 2, nearest][kind]) % 256
        out, above = out + bytes(line), bytes(line)
    return out


def test_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts())], "doc_id bigint, text string, payload int").repartition(3)
    path = f"file://{tmp_path}/archive"
    media.write_archive(docs, path)
    read = media.read_archive(spark, path, range_bytes=100)
    assert read.rdd.getNumPartitions() > 3
    rows = {r.doc_id: r for r in media.features(read).collect()}
    assert sorted(rows) == list(range(len(texts())))
    for i, text in enumerate(texts()):
        raw = (text or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        assert r.tail_crc32 == zlib.crc32(full[-64:])
        image = media.encode_image(full)
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        assert plain_png(image) == full
        lines = [full[k : k + 64] for k in range(0, len(full), 64)]
        bins = [sum(b // 32 == k for b in full) for k in range(8)]
        along = sum(abs(a - b) for x in lines for a, b in zip(x, x[1:]))
        down = sum(abs(a - b) for x, y in zip(lines, lines[1:]) for a, b in zip(x, y))
        assert r.feature == f"png64x{len(lines)}:h{','.join(map(str, bins))}:g{along},{down}"
    assert rows[6][1:] == rows[7][1:]


def test_empty_table(spark, tmp_path):
    media.write_archive(spark.createDataFrame([], "doc_id bigint, text string"), f"{tmp_path}/none")
    assert media.read_archive(spark, f"{tmp_path}/none").collect() == []


def test_uncommitted_files_are_not_read(spark, tmp_path):
    path = str(tmp_path / "archive")
    docs = spark.createDataFrame([(1, "one")], "doc_id bigint, text string")
    media.write_archive(docs, path)
    (tmp_path / "archive" / "part-lost.arc").write_bytes(b"half a file")
    assert media.read_archive(spark, path).count() == 1


def test_a_member_is_retried_alone(tmp_path, monkeypatch):
    import pyarrow as pa

    writer = media.ArchiveWriter(str(tmp_path))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["one", "two", "three"]})
    writer.commit([writer.write(iter([batch]))])
    reader, calls, plain = media.ArchiveReader(str(tmp_path), 1 << 20, 2), [], media.ArchiveReader.member

    def failing(f, offset):
        calls.append(offset)
        if len(calls) in (2, 3):
            raise OSError("gone for a moment")
        return plain(f, offset)

    monkeypatch.setattr(media.ArchiveReader, "member", staticmethod(failing))
    (part,) = reader.partitions()
    got = [x for b in reader.read(part) for x in b.column("doc_id").to_pylist()]
    assert got == [1, 2, 3] and len(calls) == 5 and calls[1] == calls[2] == calls[3]


def test_damage_is_found(tmp_path):
    image = bytearray(media.encode_image(bytes(128)))
    image[-20] ^= 1
    with pytest.raises((ValueError, OSError)):
        media.decode_image(bytes(image))
    assert os.listdir(tmp_path) == []


def test_a_null_id_stays_null(spark, tmp_path):
    docs = spark.createDataFrame([(None, "none"), (0, "zero"), (-1, "less")], "doc_id bigint, text string")
    media.write_archive(docs, f"{tmp_path}/archive")
    got = {(r.doc_id, bytes(r.payload).rstrip(b"\0")) for r in media.read_archive(spark, f"{tmp_path}/archive").collect()}
    assert got == {(None, b"none"), (0, b"zero"), (-1, b"less")}
