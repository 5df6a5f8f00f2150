"""Top-k search against scoring every pair."""

import math
import random

from fellway.llm.topk_search import top_k


def brute(rows, k, every):
    whole = [(n, i, [math.floor(1024 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in whole:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j, m) for m, j, v in whole if m != n and len(v) == len(q))
            out += [(i, rank + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for rank, (s, j, _) in enumerate(scored[:k])]
    return sorted(out)


def same(spark, rows, k=10, every=10, **how):
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, row int, score string")
    assert sorted(map(tuple, top_k(frame, k, every, **how).collect())) == brute(rows, k, every)


def test_random_and_common_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]
    same(spark, rows, shard_rows=150, block_rows=40)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (10, None), (20, [1.0, None]), (30, [float("nan"), 1.0]), (40, [float("inf"), 1.0]), (50, []), (60, []), (70, [3.0]), (0, [1.0, 2.0]), (1, [1e12, -1e12]), (80, [1e12, 1e12])]
    same(spark, rows, k=3)


def test_fewer_than_k_and_none(spark):
    same(spark, [(0, [1.0])])
    same(spark, [(0, [1.0]), (1, [1.0]), (2, [2.0])])
    same(spark, [])


def test_null_ids(spark):
    big = (1 << 53) + 1
    rows = [(10, [1.0, 1.0]), (None, [2.0, 2.0]), (None, [1.0, 1.0]), (big, [1.0, 1.0]), (5, [-1.0, 0.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 4, 10).collect()
    one = 1024 * 1024
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(10, 1, None, 4 * one), (10, 2, big, 2 * one), (10, 3, None, 2 * one), (10, 4, 5, -one)]
