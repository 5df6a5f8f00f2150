"""Packing against one-by-one best-fit decreasing, and the pieces' own laws."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from fellway.llm.packing import CapacityTree, pack, plan_packing, word_encoder

MODEL = public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths, window):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(window - n)
    return sorted(room)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(60):
        window = rng.choice([1, 7, 16, 50])
        lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 200))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        table, windows = plan_packing(histogram, window)
        used = [[] for _ in range(windows)]
        for k, (n, rank, first, offset) in enumerate(table):
            last = table[k + 1][1] if k + 1 < len(table) and table[k + 1][0] == n else histogram[n]
            for w in range(last - rank):
                used[first + w].append((offset, n))
        for pieces in used:
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert 0 < at <= window
        assert sorted(window - sum(n for _, n in p) for p in used) == best_fit(lengths, window)


def test_tree_finds_tightest():
    tree = CapacityTree(20)
    for c in (3, 9, 20):
        tree.add(c, 1)
    assert [tree.tightest(k) for k in (1, 3, 4, 9, 10, 20)] == [3, 3, 9, 9, 20, 20]
    tree.add(20, -1)
    assert tree.tightest(10) is None


def test_words_equal_library(odd_texts):
    own, library = word_encoder(MODEL), Tokenizer.from_file(MODEL)
    for text in odd_texts:
        got = np.frombuffer(own.encode(text), "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text


def test_pack(spark):
    texts = ["", None, "one two three " * 900, "same", "same", "Ä b", "x " * 5000]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, sequence_id int")
    rows = pack(docs).collect()
    library = Tokenizer.from_file(MODEL)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert pack(docs.limit(0)).count() == 0
