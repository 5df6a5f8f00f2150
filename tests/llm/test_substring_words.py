"""Word-window removal against a table of all windows."""

import random

import numpy as np

from fellway.llm._blocks import _Ranges, rank_of
from fellway.llm.substring_words import SuffixAutomaton, shared_words


def brute(rows, window):
    first, out = {}, []
    split = lambda t: (t or "").encode().split()
    for i, text in rows:
        words = split(text)
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, i), i)
    for i, text in rows:
        words = split(text)
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((i, len(words), sum(gone), b" ".join(kept).decode()))
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["é", "日本", "x" * 300, "\x1c\x85"]
    passages = [[rng.choice(words) for _ in range(rng.randint(5, 40))] for _ in range(12)]
    rows = [(3, None), (5, ""), (7, " \n\t ")]
    for k in range(n):
        text = []
        for _ in range(rng.randint(0, 6)):
            text += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 30))]
        rows.append((rng.choice([k * 10, k * 10, 11]), rng.choice([" ", "\n", "\t \x0b"]).join(text)))
    rows += [(9_000_000_000 + k, rows[20][1]) for k in range(15)]
    return rows


def test_removal(spark):
    for seed, chunk, shard in ((1, 1 << 20, 100_000), (2, 9000, 100_000), (3, 14_000, 60), (4, 2500, 100_000)):
        rows = corpus(seed, 120)
        frame = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id bigint, text string, chunk int, hashes string")
        got = shared_words(frame, chunk_bytes=chunk, shard_words=shard).collect()
        assert sorted(map(tuple, got)) == brute(rows, 13)


def test_null_id_is_last(spark):
    text = " ".join(f"w{k}" for k in range(20))
    rows = shared_words(spark.createDataFrame([(None, text), (1 << 60, text)], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 20), (1 << 60, 0)]


def test_a_passage_in_all_chunks_and_a_heavy_id(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = " ".join(word() for _ in range(20))
    big = 1 << 60
    rows = [(k if k % 3 else big, " ".join([*(word() for _ in range(rng.randint(1, 30))), passage, *(word() for _ in range(15))])) for k in range(300)]
    rows += [(big, rows[0][1]), (5, rows[3][1]), (big, " ".join(word() for _ in range(40)))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows, 13)
    assert sorted(map(tuple, shared_words(frame, chunk_bytes=3000).collect())) == want
    nulls = frame.selectExpr("nullif(doc_id, 1L << 60) AS doc_id", "text")
    got = shared_words(nulls, chunk_bytes=3000).collect()
    assert sorted((big if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got) == want


def test_ranges_keep_the_order_of_ids():
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 1000, 500), np.full(300, 400), np.full(250, (1 << 63) - 1)])
    texts = [bytes([k % 251]) for k in range(len(ids))]
    for chunks in (1, 2, 7, 60, 5000):
        plan = _Ranges(np.sort(rng.choice(ids, 200)) if chunks > 1 else ids[:0], chunks)
        own = plan.chunks_of(ids, texts)
        order = np.argsort(ids, kind="stable")
        rank = rank_of(plan.own, own[order])
        assert (np.diff(rank) >= 0).all()
        for r in np.unique(rank):
            mine = own[order][rank == r]
            assert len(np.unique(mine)) == 1 or len(np.unique(ids[order][rank == r])) == 1


def test_empty_table(spark):
    assert shared_words(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_automaton_matches_every_run():
    rng = random.Random(6)
    for _ in range(60):
        passages = [[bytes([rng.choice(b"abc")]) for _ in range(rng.randint(1, 12))] for _ in range(4)]
        automaton = SuffixAutomaton()
        for p in passages:
            automaton.add(p)
        text = [bytes([rng.choice(b"abc")]) for _ in range(25)]
        held = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        for least in (1, 2, 4):
            expected = [k for k in range(len(text)) if k + 1 >= least and tuple(text[k + 1 - least : k + 1]) in held]
            assert automaton.ends(text, least) == expected
