"""Token counts by the two-tier lookup against the library."""

import public_tokenizers
from tokenizers import Tokenizer

from fellway.llm.token_counts import LIMIT, _Counts, count_tokens, frequent_pieces, op5_token_counts

MODEL = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def library_counts(texts):
    library = Tokenizer.from_file(MODEL)
    library.no_truncation()
    library.no_padding()
    return [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_equal_library(odd_texts):
    own = _Counts(MODEL, {})
    assert [own.count(t) for t in odd_texts] == library_counts(odd_texts)


def test_choice_of_frequent_pieces_changes_nothing(spark, odd_texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts)], "doc_id bigint, text string")
    table = frequent_pieces(docs, MODEL)
    assert table
    with_table, without = _Counts(MODEL, table), _Counts(MODEL, {})
    assert [with_table.count(t) for t in odd_texts] == [without.count(t) for t in odd_texts]


def test_defined_cases(spark):
    texts = [None, "", "same", "same", "<|endoftext|>", "word " * 30_000, "x" * 100_000, "é日🙂" * 2000, "limit" + " a" * (LIMIT - 1), "limit" + " a" * LIMIT]
    docs = spark.createDataFrame([(i, t, i, 1.5) for i, t in enumerate(texts)] + [(None, "no id", 1, None), (2, "same", 1, None)], "doc_id bigint, text string, n_tokens int, piece double")
    rows = count_tokens(docs).collect()
    wanted = library_counts([t or "" for t in texts])
    found = sorted(tuple(r) for r in rows if r.doc_id is not None)
    expected = [(i, len((t or "").encode()), n, n > LIMIT) for i, (t, n) in enumerate(zip(texts, wanted))]
    assert found == sorted(expected + [expected[2]])
    assert [r.n_tokens for r in rows if r.doc_id is None] == library_counts(["no id"])
    assert count_tokens(docs.limit(0)).count() == 0


def test_whole_table_equals_library(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = op5_token_counts(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    wanted = dict(zip(texts, library_counts(texts.values())))
    for r in rows:
        n = wanted[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512), r.doc_id


def test_one_id_for_all_rows_and_long_texts(spark):
    texts = [f"word{k % 9} and more words {k}" for k in range(300)] + ["the same words again " * 200_000, None, ""]
    docs = spark.createDataFrame([(7, t) for t in texts] + [(None, texts[0])], "doc_id bigint, text string").repartition(3)
    assert frequent_pieces(docs, MODEL)[" same"] == 1
    library = Tokenizer.from_file(MODEL)
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) for t in [*texts, texts[0]])
    assert sorted(r.n_tokens for r in count_tokens(docs).collect()) == want
