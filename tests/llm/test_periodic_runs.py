"""Periodic runs against trying every period at every word."""

import hashlib
import random
import re
import zlib

import pytest

from fellway.llm import periodic_runs as pr
from fellway.llm.queries import QUERIES


def brute(words, least=12, exp=2):
    n, runs = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exp * q):
                runs.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in runs.items()), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def some_texts():
    rng = random.Random(3)
    out = [None, "", " \t\n", "a", "a " * 11, "a " * 12, "a b " * 6, "a b " * 5 + "a c", "\x1c\x1d é é\x85é", "x" * 5000]
    for _ in range(250):
        words = [rng.choice("abc") for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(0, 3)):
            part = [rng.choice("abcdé") for _ in range(rng.randint(1, 9))]
            at = rng.randint(0, len(words))
            words[at:at] = (part * 9)[: rng.randint(len(part), 9 * len(part))]
        out.append(rng.choice([" ", "\n", " \t "]).join(words))
    return out + out[:40]


@pytest.mark.parametrize("range_bytes", [1 << 20, 40])
def test_equals_every_period(spark, range_bytes):
    texts = some_texts()
    docs = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in enumerate(texts)], "doc_id bigint, text string, k1 string, part int, runs int").repartition(5)
    got = {r.doc_id: r for r in pr.periodic_runs(docs, range_bytes=range_bytes).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        words = split(text)
        runs = brute(words)
        assert [(r.start, r.length, r.period) for r in got[k].runs] == runs, text
        assert got[k].n_words == len(words) and got[k].collapsed == collapse(words, runs)


def test_other_limits(spark):
    texts = some_texts()
    got = {r.doc_id: r.runs for r in pr.periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 5, 3).collect()}
    assert all([(r.start, r.length, r.period) for r in got[k]] == brute(split(t), 5, 3) for k, t in enumerate(texts))
    with pytest.raises(ValueError):
        pr.periodic_runs(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), min_exp=1.5)


def test_long_texts_and_pieces(monkeypatch):
    monkeypatch.setattr(pr, "PIECE_BYTES", 1000)
    rng = random.Random(8)
    words = [str(rng.randint(0, 500)) for _ in range(3000)]
    words[700:700] = words[:40] * 6
    raw = "  ".join(words).encode()
    ids = pr._ids(raw, pr._names())
    assert len(ids) == len(words)
    whole = pr.scan([ids], 12, 2)[0]
    assert whole == brute(words)
    last = len(ids) // 2
    parts = {r for k in range(7) for r in pr.scan([ids], 12, 2, (1 + last * k // 7, last * (k + 1) // 7))[0]}
    assert parts == set(whole)
    assert pr._collapsed(raw, len(ids), whole).decode() == collapse(words, whole)
    same = pr._ids(b"a " * 200_000, pr._names())
    assert pr.scan([same], 12, 2)[0] == [(0, 200_000, 1)] == pr.scan([same], 12, 2, (50_001, 60_000))[0]


def answer(doc_id, text):
    words = split(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), s, length, q, 1000 * length // q if runs else None, sha(listed), sha(collapse(words, runs)))


def test_query(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(some_texts())] + [(None, "a b " * 9), (None, None), (5, "a b " * 30), (5, "a b " * 30), (-7, "x y z " * 5), (14, " "), (14, None)]
    spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id bigint, text string, _h string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert frame.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted((answer(*r) for r in rows), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op13_periodic_runs"](spark, f"{tmp_path}/none").collect() == []
