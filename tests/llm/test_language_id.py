"""Language identification: exact forward-backward, and held-out accuracy."""

import itertools
import zlib

import numpy as np

from fellway.llm import language_id as L
from fellway.llm.language_id import Labeller, fit, forward_backward, has_letter, identify, known_language, labelled_spans, posteriors, train, word_scores, words_of

SF = "/root/testdata/sf0.01"


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    for lengths in ([1], [4, 1, 3], [2, 5, 2, 2]):
        n, labels = sum(lengths), 3
        scores, moves, start = rng.normal(size=(n, labels)) * 2, rng.normal(size=(labels, labels)), rng.normal(size=labels)
        first = np.zeros(n, bool)
        first[np.cumsum([0, *lengths[:-1]])] = True
        got, at = posteriors(scores, first, moves, start), 0
        for size in lengths:
            total = np.zeros((size, labels))
            for path in itertools.product(range(labels), repeat=size):
                value = start[path[0]] + sum(scores[at + k, p] for k, p in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
                for k, p in enumerate(path):
                    total[k, p] += np.exp(value)
            assert np.allclose(got[at : at + size], total / total.sum(axis=1, keepdims=True))
            at += size
    assert forward_backward(np.full((1000, 2), -900.0), np.arange(1000) % 7 == 0, np.zeros((2, 2)), np.zeros(2))[0].shape == (1000, 2)


def test_code_switched_words_follow_their_neighbours():
    model = fit([("the and with that this have " * 20, "en"), ("der und mit dass diese haben " * 20, "de")] * 5)
    own = Labeller(model)
    labels, scores = own.label(["the and with this", "der und mit diese", "", None, "123 !!", "the and with that der und mit dass"])
    assert labels[:5] == ["en", "de", "und", "und", "und"] and scores[2:5] == [0, 0, 0]
    assert 0.3 < scores[5] < 0.7


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = identify(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 1.0), (2, "", None, 1.0), (3, "12 ... !", "en", 1.0), (4, "x" * 100_000, "en", 1.0), (4, "日本語 テキスト", None, 1.0)], "doc_id bigint, text string, lang string, score double")
    rows = sorted(identify(docs).collect())
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and len(rows) == 5
    assert all(0 <= r.score <= 1 for r in rows)
    assert identify(docs.limit(0)).collect() == []


def test_no_labels(spark):
    own = Labeller(fit([]))
    assert own.label(["hello world", None, "12"])[0] == ["und"] * 3 and own.spans(["hello"]) == [[]]
    assert Labeller(fit([("12 !", "en")])).label(["hello"]) == (["und"], [0.0])
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("hello world", None), ("12 34", "en"), (None, "en"), ("", "de"), ("x", None)] * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {(r.lang_pred, r.score) for r in identify(docs).collect()} == {("und", 0.0)}
    assert known_language(docs).collect() == [] and labelled_spans(docs).count() == len(rows)


def test_one_id_and_mostly_long_texts(spark):
    en, de = "the and with that this have ", "der und mit dass diese haben "
    train_id = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5)
    rows = [(train_id, (en if k % 2 else de) * (2 + k % 7) + f"x{k}", "en" if k % 2 else "de") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert train(docs).labels == ["de", "en"]
    assert sorted({r.lang_pred for r in identify(docs).collect()}) == ["de", "en"]
    long = [(k, en * 4000, "en") for k in range(600)] + [(k, de * 3 + f"x{k}", "de") for k in range(600, 640)]
    assert train(spark.createDataFrame(long, "doc_id bigint, text string, lang string").repartition(4)).labels == ["de"]


def plain_label(model, text):
    """Language and score of one text by forward-backward in plain numbers."""
    words = [w for w in words_of(text) if has_letter(w)]
    if not words:
        return "und", 0.0
    emit, n = np.exp(word_scores(model, words)), len(model.labels)
    move, begin = np.exp(model.transitions), np.exp(model.start)
    forward, backward = [begin * emit[0]], [np.ones(n)]
    for e in emit[1:]:
        v = np.array([sum(forward[-1][a] * move[a, b] for a in range(n)) * e[b] for b in range(n)])
        forward.append(v / v.sum())
    for e in emit[:0:-1]:
        v = np.array([sum(move[a, b] * e[b] * backward[-1][b] for b in range(n)) for a in range(n)])
        backward.append(v / v.sum())
    both = [f * b / (f * b).sum() for f, b in zip(forward, backward[::-1])]
    mean = np.mean(both, axis=0)
    return model.labels[int(mean.argmax())], float(mean.max())


def test_every_text_equals_plain_forward_backward(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = train(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in identify(docs, model).collect():
        lang, score = plain_label(model, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-5


def test_words_of_code_switched_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, rng = train(docs), np.random.default_rng(4)
    rows = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.lang and 80 < len(words_of(r.text)) < 2000]
    mixed, truth = [], []
    for a, b in zip(rows[::2], rows[1::2]):
        if a.lang != b.lang:
            words, labels, at, side = [], [], [0, 0], 0
            while len(words) < 200 and at[side] < len(words_of((a, b)[side].text)):
                run = words_of((a, b)[side].text)[at[side] : at[side] + int(rng.integers(6, 30))]
                words, labels = words + run, labels + [(a, b)[side].lang] * len(run)
                at[side], side = at[side] + len(run), 1 - side
            mixed.append((len(mixed), " ".join(words)))
            truth.append(labels)
    assert len(mixed) > 20
    right = total = switched = 0
    for r in labelled_spans(spark.createDataFrame([*mixed, (900, None), (901, "12 !")], "doc_id bigint, text string"), model).collect():
        if r.doc_id >= 900:
            assert r.spans == []
            continue
        labels = truth[r.doc_id]
        assert r.spans[0].start == 0 and r.spans[-1].stop == len(labels) and all(x.stop == y.start for x, y in zip(r.spans, r.spans[1:]))
        found = [s.lang for s in r.spans for _ in range(s.start, s.stop)]
        right, total = right + sum(x == y for x, y in zip(found, labels)), total + len(labels)
        switched += len(r.spans) > 1
    print("word accuracy", right / total)
    assert right / total > 0.9 and switched > 0.9 * len(mixed)


def test_a_worker_holds_the_arrays_of_few_texts(monkeypatch):
    """Texts are labelled some at a time: the peak doesn't grow with the batch, and results are those of the whole batch."""
    import tracemalloc

    words = {"a": ["ana", "bela", "casa", "dona"], "b": ["og", "det", "hus", "vand"]}
    model = L.fit([(" ".join(w * 5), lang) for lang, w in words.items() for _ in range(4)])
    texts = [None, "", "12 3", *(" ".join(words["ab"[k % 2]] * 300) for k in range(400))]

    def measured(letters):
        monkeypatch.setattr(L, "LETTERS_AT_ONCE", letters)
        own = L.Labeller(model, shares=True)
        tracemalloc.start()
        found = own.measured(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found, own.spans(texts), peak

    whole, some = measured(10**9), measured(50_000)
    assert whole[:2] == some[:2] and whole[0][0][:5] == ["und", "und", "und", "a", "b"]
    assert some[2] < whole[2] / 5
    assert [len(x) for x in L._portions(["x" * L.LETTERS_AT_ONCE, "y", None, "z" * 60_000])] == [1, 2, 1] and not list(L._portions([]))
