"""Byte-string removal against counting all strings of the width."""

import hashlib
import random
from collections import Counter

import numpy as np

from fellway.llm.substring_bytes import Suffixes, least_places, op2_substring_bytes, repeated_bytes, sorted_suffixes


def brute(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for k in range(len(t) - width + 1):
            if count[t[k : k + width]] > 1:
                gone[k : k + width] = [True] * width
        edge = [0, *map(int, gone), 0]
        starts = [k for k in range(len(t)) if edge[k + 1] > edge[k]]
        stops = [k for k in range(1, len(t) + 1) if edge[k] > edge[k + 1]]
        out.append((-1 if i is None else i, len(t), starts, stops, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out)


def corpus(seed, n, scale):
    rng = random.Random(seed)
    letters = "abcdefgh \né日"
    some = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [some(rng.randint(scale // 2, scale * 3)) for _ in range(8)] + ["a" * scale * 3, "ab" * scale]
    rows = [(3, None), (5, ""), (None, some(scale * 2))]
    for k in range(n):
        text = ""
        for _ in range(rng.randint(0, 5)):
            text += rng.choice(passages) if rng.random() < 0.5 else some(rng.randint(1, scale))
        if text and rng.random() < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        rows.append((k * 7, text))
    rows += [(9_000_000_000 + k, rows[12][1]) for k in range(12)]
    return rows


def same(spark, rows, width, **how):
    frame = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id bigint, text string, chunk int, kinds string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.starts, r.stops, bytes(r.kept)) for r in repeated_bytes(frame, width, **how).collect())
    assert got == brute(rows, width)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept).hexdigest() for r in repeated_bytes(frame, width, **how).collect())


def test_removal(spark):
    same(spark, corpus(1, 70, 30), 20, anchor=12)
    same(spark, corpus(2, 70, 30), 20, anchor=15, block_bytes=700, bucket_bytes=900)
    same(spark, corpus(3, 60, 500), 400, block_bytes=5000, bucket_bytes=9000)


def test_query_tells_planted_passages_by_what_it_removes(spark, tmp_path):
    """Passages of 60 words go where they have 400 bytes; the length of the input tells nothing."""
    rng = random.Random(11)
    some = lambda n, k: " ".join("".join(rng.choice("abcdefghé") for _ in range(k)) for _ in range(n))
    long, short = some(60, 7), some(60, 4)
    assert len(long.encode()) >= 400 > len(short.encode()) + 2
    rows = [(k, some(20 + k, 6) + " " + ((long, short, some(60, 7))[k % 3]) + " " + some(20, 6)) for k in range(30)] + [(30, None), (31, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = op2_substring_bytes(spark, str(tmp_path))
    assert frame.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    got = sorted(map(tuple, frame.collect()))
    assert got == [(i, n, sum(b) - sum(a), len(a), hashlib.sha256(kept).hexdigest()) for i, n, a, b, kept in brute(rows, 400)]
    assert all((r[2] >= len(long.encode())) == (r[0] < 30 and r[0] % 3 == 0) and (r[2] > 0) == (r[3] > 0) for r in got)
    assert [r[1] for r in got] == [len((t or "").encode()) for _, t in rows]


def test_hot_anchors(spark):
    rng = random.Random(7)
    some = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = some(60)
    rows = [(k, some(rng.randint(0, 30)) + passage + some(rng.randint(0, 30))) for k in range(120)] + [(500, "x" + passage), (501, "x" + passage)]
    same(spark, rows, 20, anchor=12, block_bytes=900, bucket_bytes=2000, hot=2)
    same(spark, rows, 20, anchor=12, block_bytes=900, bucket_bytes=2000, hot=50, hot_bucket=20)


def test_colliding_hashes_change_nothing(spark):
    for bits in (1, 4, 8):
        same(spark, corpus(4, 40, 30), 20, anchor=12, block_bytes=900, bucket_bytes=2000, hash_bits=bits)


def test_pieces_of_long_texts(spark, monkeypatch):
    import fellway.llm.substring_bytes as module

    monkeypatch.setattr(module, "PIECE", 37)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(n)).encode() for n in (0, 500, 19, 20, 21, 300)]
    own = module.Anchors(texts, 20, 12)
    base = [sum(map(len, texts[:k])) for k in range(len(texts))]
    assert sorted(w for a, b in zip(own.low.tolist(), own.high.tolist()) for w in range(a, b + 1)) == [base[k] + p for k, t in enumerate(texts) for p in range(len(t) - 19)]


def test_suffixes_are_sorted_by_their_bytes():
    rng = np.random.default_rng(5)
    for bits in (64, 6, 1):
        data = rng.integers(97, 99, 600).astype(np.uint8)
        data[300:] = data[:300]
        start, segment = rng.permutation(600 - 24)[:400], rng.integers(0, 5, 400)
        order, repeats = sorted_suffixes(Suffixes(data, 25, bits), start, segment)
        rows = [(int(segment[k]), data[start[k] : start[k] + 25].tobytes()) for k in order]
        assert rows == sorted(rows) and sorted(order.tolist()) == list(range(400))
        count = Counter(rows)
        assert [bool(repeats[k]) for k in order] == [count[r] > 1 for r in rows]


def test_empty_table(spark):
    assert repeated_bytes(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_least_places():
    rng = np.random.default_rng(1)
    for n, span in ((1, 1), (10, 3), (101, 101), (250, 7)):
        hashes = rng.integers(0, 5, n, np.uint64) << np.uint64(40)
        assert least_places(hashes, span).tolist() == [k + int(hashes[k : k + span].argmin()) for k in range(n - span + 1)]
