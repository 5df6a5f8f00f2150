"""The pipeline's stages on documents with known copies and passages."""

import random

import corpus_pipeline
from fellway.llm._common import written

LANG = {"en": "the and that with this have from they would there".split(), "de": "der und dass mit diese haben von sie wird dort".split()}


def corpus():
    rng, rows = random.Random(9), []

    def text(lang, n):
        return [rng.choice(LANG[lang]) if rng.random() < 0.3 else rng.choice(LANG[lang]) + str(rng.randrange(10**6)) for _ in range(n)]

    for k in range(80):
        lang = rng.choice(["en", "de"])
        rows.append([k, text(lang, rng.randint(80, 200)), lang])
    shared = text("en", 60)
    rows[10][1] = rows[10][1][:40] + shared + rows[10][1][40:]
    rows[11][1] = rows[11][1][:30] + shared + rows[11][1][30:]
    rows.append([80, list(rows[5][1]), rows[5][2]])
    near = list(rows[6][1])
    near[50] = "changed"
    rows.append([81, near, rows[6][2]])
    out = [(k, " ".join(w), lang, "s", len(" ".join(w))) for k, w, lang in rows]
    return [*out, (82, None, None, "s", None), (83, "", "en", "s", 0), (84, "12 34 !!", "en", "s", 8)], shared


def test_stages(spark):
    rows, shared = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, ""), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: r for r in docs.collect()})
    assert set(kept[0]) == set(range(82))
    assert set(kept[1]) == set(range(80))
    assert set(kept[2]) == set(range(80))
    for k, r in kept[2].items():
        if k == 11:
            before = rows[11][1].split()
            assert r.text.split() == before[:30] + before[90:] and r.n_chars == len(r.text)
        else:
            assert r.text == rows[k][1]
    pieces = corpus_pipeline.STAGES[3][1](spark, docs, "").collect()
    assert {p.doc_id for p in pieces} == set(range(80))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_null_and_repeated_ids(spark):
    rng, big = random.Random(4), (1 << 53) + 1

    def text(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    a, b, c, d, shared = text(100), text(100), text(100), text(100), text(40)
    near = [*a[:50], "changed", *a[51:]]
    rows = [(big, a), (big, a), (None, near), (None, b), (None, b), (7, c + shared), (9, d[:50] + shared), (9, shared + d[50:]), (9, text(50))]
    docs = spark.createDataFrame([(i, " ".join(w), "s", 1) for i, w in rows], "doc_id bigint, text string, source string, n_chars bigint")
    kept = written(corpus_pipeline.near_copies(spark, docs, ""), "test")
    assert kept.columns == docs.columns
    expected = [(big, a), (None, b), *rows[5:]]
    order = lambda found: sorted(found, key=str)
    assert order((r.doc_id, r.text) for r in kept.collect()) == order((i, " ".join(w)) for i, w in expected)
    cut = corpus_pipeline.repeated_passages(spark, kept, "").collect()
    expected[3:5] = [(9, d[:50]), (9, d[50:])]
    assert order((r.doc_id, r.text) for r in cut) == order((i, " ".join(w)) for i, w in expected)
    # Without the stage before, copies of one doc_id are cut once each.
    twice = docs.filter("doc_id = 7 or doc_id = 9").unionByName(docs.filter("doc_id = 9"))
    assert corpus_pipeline.repeated_passages(spark, twice, "").count() == 7


def test_language_rejects_what_was_not_learned(spark):
    rng = random.Random(11)
    syllables = {"en": "the ing an er wor sh ould ly re st on ent ou ght".split(), "de": "sch ein ich ung der ge ver keit en lich au be zu st".split()}

    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    rows = [(k, text(("en", "de")[k % 2], 120), ("en", "de")[k % 2]) for k in range(120)]
    rows += [(200 + k, text("en", 40) + " " + text("de", 40), None) for k in range(10)]
    other = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + (" " if rng.random() < 0.2 else "") for _ in range(500)) for _ in range(20)]
    other += ["Это текст на русском языке о погоде", "これは 日本語の 文章です", "Ovo je tekst na hrvatskom jeziku o vremenu i onome"]
    rows += [(300 + k, t, None) for k, t in enumerate(other)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()} == {*range(120), *range(200, 210)}


def test_clashing_names_and_very_long_texts(spark):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(10**7)}" for _ in range(150_000))
    short = " ".join(f"w{rng.randrange(10**7)}" for _ in range(60))
    rows = [(1, long, "a"), (1, long, "b"), (2, long, "c"), (3, short, "d"), (3, short, "e"), (3, short, "f"), (4, "x", "g"), (None, None, "h"), (None, None, "i")]
    clash = "_id _key rows node root doc key carried row none whole kept n_removed chunk block s _rows n bands".split()
    docs = spark.createDataFrame([(i, t, *[c] * len(clash)) for i, t, c in rows], "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in clash))
    kept = written(corpus_pipeline.near_copies(spark, docs, ""), "test")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == [(1, long), (3, short), (4, "x")]
    assert sum(r.doc_id is None for r in kept.collect()) == 1
    cut = corpus_pipeline.repeated_passages(spark, docs, "")
    assert cut.columns == docs.columns and cut.count() == len(rows)
    pieces = corpus_pipeline.packing(spark, kept, "").collect()
    assert {p.doc_id for p in pieces} == {1, 3, 4, None}
