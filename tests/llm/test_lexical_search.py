"""Ranked search against scoring every document, and against the SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from fellway.llm import lexical_search as ls
from fellway.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def brute(docs, items, k):
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, len(w), Counter(w)) for i, w in bags if w]
    big_n, big_l = len(bags), sum(n for _, n, _ in bags)
    df = Counter(t for _, _, bag in bags for t in bag)
    out = []
    for item, text in set(items):
        scored = []
        for i, n, bag in bags:
            m = 75 + 25 * n * big_n // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text) if bag[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def table(seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["The", "ÉTÉ", "été", "naïve", "9", "漢字", "İ"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, rng.choice(" ,-").join(rng.choices(words, weights, k=rng.randint(1, 80)))) for k in range(400)]
    docs += [(1000 + k, docs[7][1]) for k in range(60)]  # ties
    docs += [(None, docs[7][1]), (3, docs[3][1]), (3, "w1 w2 x"), (2000, None), (2001, ""), (2002, " ... "), (2003, "w1 " * 50_000)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(25)] + [(30, docs[7][1]), (31, None), (32, "?"), (33, "absent"), (34, "w1 w1 W1"), (5, "w1 w9"), (5, "w1 w9"), (None, "w3")]
    return docs, items


def same(spark, docs, items, k, **how):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, text string, item bigint, score int").repartition(5)
    q = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id bigint, text string, rank int")
    frame = ls.lexical_top_k(d, q, k, **how)
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, frame.collect()), key=repr) == brute(docs, items, k)


def test_equals_every_score(spark):
    same(spark, *table(), 20)


def test_small_chunks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ls, "STEP", 3)
    same(spark, *table(6), 4, block_terms=90, chunk_postings=200)


def test_none(spark):
    same(spark, [], [(1, "a")], 20)
    same(spark, [(1, "a b")], [], 20)
    same(spark, [(1, "a b"), (2, "c")], [(1, "a")], 20)


def test_stops_before_all_postings():
    rng = np.random.default_rng(1)
    n_docs = 50_000
    rare = rng.choice(n_docs, 40, replace=False)
    docs = np.concatenate([np.arange(n_docs), rare])
    tfs = np.concatenate([rng.integers(1, 9, n_docs), rng.integers(1, 9, 40)])
    index = ls.Index(np.array([50, 9000]), np.full(n_docs, 100), (n_docs, 100 * n_docs), docs, np.repeat([0, 1], [n_docs, 40]), tfs)
    asked, times = np.array([0, 1]), np.array([1, 1])
    found, scores = index.search(asked, times, 20, 0)
    assert index.taken < 2000 and set(found) <= set(rare)
    every = index.complete(np.arange(n_docs), asked, times, 2)
    assert sorted(scores)[-20:] == np.sort(every)[-20:].tolist()


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame, answer = QUERIES["op12_lexical_search"](spark, SF), con.sql(ORACLE_SQL["op12_lexical_search"])
    assert frame.columns == answer.columns
    assert sorted(map(tuple, frame.collect())) == sorted(answer.fetchall())
