"""The corpus pipeline: language, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of documents. Null texts, empty tables and further columns pass through
as each operator's module defines them. doc_id only orders documents, a null one
after all others; a row is named by doc_id and text. So rows that repeat a doc_id
are documents of their own where their texts differ, and where they do not are
copies, of which any one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellway.llm._common import small_batches, written
from fellway.llm.language_id import known_language
from fellway.llm.packing import pack
from fellway.llm.simhash import first_of_groups, text_key
from fellway.llm.substring_words import shared_words

#: A document whose best language has a lower mean probability is rejected.
LEAST_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return known_language(docs, LEAST_LANGUAGE_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    # Names that no column of the documents has.
    fresh = "_" * max(map(len, docs.columns))
    doc_id, key, rows = (fresh + x for x in ("_id", "_key", "_rows"))
    stays = written(first_of_groups(docs).withColumnsRenamed({"doc_id": doc_id, "key": key, "rows": rows}), "first")
    once, often = stays.filter(F.col(rows) == 1), stays.filter(F.col(rows) > 1)

    def same(other: DataFrame):
        """Rows with the same doc_id, null or not, and the same text."""
        return docs["doc_id"].cast("long").eqNullSafe(other[doc_id]) & (text_key() == other[key])

    kept = docs.join(once, same(once), "left_semi").select(*docs.columns)
    if often.isEmpty():
        return kept
    alike = docs.join(often, same(often)).dropDuplicates([doc_id, key]).select(*(docs[c] for c in docs.columns))
    return kept.unionByName(alike)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 13 words or more that an earlier document holds are cut out of a text; n_chars follows."""
    found, cut = shared_words(docs, carried=True), F.col("n_removed") > 0
    row = {c: F.col("carried")["row"][c] for c in docs.columns if c != "text"}
    row["text"] = F.when(cut, F.col("kept")).otherwise(F.col("whole"))
    if "n_chars" in row:
        row["n_chars"] = F.when(cut, F.length("kept").cast("long")).otherwise(row["n_chars"])
    return found.select(*(row[c].alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [("language ID", language), ("SimHash near-dedup", near_copies), ("substring dedup", repeated_passages), ("packing", packing)]

#: No SQL: a learned model, a prefix of stages that depend on it, and tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs, f"stage{n + 1}")
    return docs
