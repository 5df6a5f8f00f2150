"""The prefix table's ids and decoded texts against the library."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece

from fellway.llm.sentencepiece_prefix import encode_decode, encoder, op6_sentencepiece

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def row(library, text):
    ids = library.encode(text or "")
    digests = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), library.decode(ids))]
    return (len(ids), *digests)


def test_ids_equal_library(library, odd_texts):
    own = encoder(MODEL)
    for text in odd_texts:
        ids = own.encode(text)
        assert ids == library.encode(text), text
        assert (own.decode(ids) if ids else "") == library.decode(ids), text


def test_runs_of_pieces_equal_library(library):
    """Every piece of the vocabulary, alone and glued to its neighbours."""
    own = encoder(MODEL)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(3, library.get_piece_size()) if not library.is_byte(i)]
    glued = [a + b + c for a, b, c in zip(pieces, pieces[7:], pieces[101:])]
    for text in pieces + glued[::3]:
        assert own.encode(text) == library.encode(text), text


def test_defined_cases(spark, library):
    texts = [None, "", "same", "same", "line\nend\n", "  two  blanks ", "word " * 20_000, "ab" * 40_000, "日本🙂" * 3000, "a\x00b"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, "no id", 0), (2, "same", 0)], "doc_id bigint, text string, n_tokens int")
    rows = encode_decode(docs).collect()
    expected = [(i, *row(library, t)) for i, t in enumerate(texts)]
    assert sorted(tuple(r) for r in rows if r.doc_id is not None) == sorted(expected + [expected[2]])
    assert [tuple(r)[1:] for r in rows if r.doc_id is None] == [row(library, "no id")]
    assert encode_decode(docs.limit(0)).count() == 0


def test_whole_table_equals_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = op6_sentencepiece(spark, SF).collect()
    assert sorted(tuple(r) for r in rows) == sorted((i, *row(library, t)) for i, t in texts.items())
