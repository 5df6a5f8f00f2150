"""Sharding: sizes, gapless slots, and cutting a large group of equal texts."""

import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from fellway.llm.sharding import shard


def check(rows, texts, shards):
    assert sorted(r.doc_id for r in rows) == sorted(range(len(texts)))
    sizes, slots = [0] * shards, {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    largest = max((len((t or "").encode()) + 1 for t in texts), default=0)
    mean = sum(sizes) / shards
    assert all(abs(s - mean) <= largest for s in sizes)


def test_sizes_near_equal(spark):
    texts = [None, "", "é" * 3] + ["copy " * 7] * 500 + [f"text {i} " * (i % 40) for i in range(900)] + ["long " * 800]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, size int")
    for n in (1, 3, 8):
        check(shard(docs, n, rows_per_range=50).collect(), texts, n)


def test_equal_texts_lie_together(spark):
    texts = [f"group {i % 60} " * 5 for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = shard(docs, 4, rows_per_range=40).collect()
    held = {}
    for r in rows:
        held.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in held.values()) <= 3


def test_few_and_none(spark):
    docs = spark.createDataFrame([(0, "a"), (0, "a")], "doc_id bigint, text string")
    assert len(shard(docs).collect()) == 2
    assert shard(docs.limit(0)).collect() == []


def test_null_ids_among_equal_texts(spark):
    docs = spark.createDataFrame([(None if i % 3 else i, "same") for i in range(600)], "doc_id bigint, text string")
    rows = shard(docs, 4, rows_per_range=20).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i % 3 > 0, 0 if i % 3 else i) for i in range(600))
    for k in range(4):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(150))


def test_boundaries_of_the_last_round_count(spark, monkeypatch):
    from fellway.llm import sharding

    texts = ["same"] * 900 + [f"text {i} " * 9 for i in range(100)] + ["long " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    drawn, quantiles = [], sharding._quantiles
    # First boundaries that leave one range overfull.
    monkeypatch.setattr(sharding, "_quantiles", lambda sample, parts: drawn.append(parts) or quantiles(sample, 2 if len(drawn) == 1 else parts))
    monkeypatch.setattr(sharding, "ROUNDS", 1)
    check(shard(docs, 8, rows_per_range=20).collect(), texts, 8)
    assert len(drawn) > 1


def test_dealing_against_the_whole_order(spark):
    rng = random.Random(5)
    rows = [(None if k % 11 == 0 else k % 700, rng.choice([None, "", "copy " * 30, f"t{k % 90} " * (k % 50), "é" * (k % 7)])) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    keyed = docs.select(F.xxhash64("text").alias("h"), "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n")).collect()
    order = sorted((r.h, r.doc_id is not None, r.doc_id or 0, r.n + 1) for r in keyed)
    total, before, want, taken = sum(x[3] for x in order), 0, [], Counter()
    for h, named, doc_id, size in order:
        k = min(7, (2 * before + size) * 8 // (2 * total))
        want.append((doc_id if named else None, size, k, taken[k]))
        taken[k] += 1
        before += size
    for ranges in (20, 400, 10_000):
        got = [(r.doc_id, r["size"], r.shard, r.slot) for r in shard(docs, 8, rows_per_range=ranges).collect()]
        assert Counter(got) == Counter(want)
