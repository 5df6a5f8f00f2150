"""Ranked lexical search, impact-ordered and score at a time (operator 12).

A posting's impact is what one occurrence of its term in a query adds to its
document's score; it is a whole number and known once the corpus statistics are.
The documents are read once into a table of query-term counts (a document's terms
that no query has can't add to a score), from which Spark sums N, L and df. Each
partition of that table is a shard: its postings are grouped by term and exact
impact, and every query takes the groups in descending order of impact into
accumulators. It stops when the bounds that remain prove the top k: no unseen
document can reach the k-th partial score. The scores of the documents that still
can are then completed from the postings not yet taken, so they are exact. The best
k of the shards meet in two rounds, first within salted parts of an item.

The k-th score of what a task has already searched is a floor for its later chunks;
chunks hold a bounded number of postings. Queries are dealt to blocks whose
vocabulary is bounded (``BLOCK_TERMS``), so what is broadcast has a bound; each
block reads the documents anew.

Terms are the maximal stretches of ASCII digits, ASCII letters and characters beyond
ASCII; only A-Z are lower-cased. In UTF-8 that is a table of 256 bytes.

Defined cases: null and termless texts take no part; a null, empty or termless
item returns no rows; identical rows of an item count once, two texts under one
item_id are two queries that each return their rows; documents that repeat a doc_id
are each their own; a null doc_id comes after others of equal score; equal scores
with equal ids stand in any order; an empty table on either side gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, session, small_batches, written

K = 20
#: Distinct query terms of one block of items, about; it bounds what is broadcast.
BLOCK_TERMS = 200_000
#: Postings and documents of a shard that are indexed at once.
CHUNK_POSTINGS = 4_000_000
#: Postings of a term taken before the stopping rule is first tried; each further round takes twice as many.
STEP = 256
#: Parts that an item's findings are first merged in.
SALTS = 64

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_SEEN = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
_FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()), ("shard", pa.int64())])


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


class Index:
    """The postings of a chunk of documents, by term and descending impact."""

    def __init__(self, weights: np.ndarray, n: np.ndarray, mean: tuple[int, int], docs: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        big_n, big_l = mean
        m = 75 + (25 * n * big_n) // big_l
        impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[docs]))
        kept = impact > 0
        docs, terms, impact = docs[kept], terms[kept], impact[kept]
        order = np.lexsort((docs, -impact, terms))
        self.docs, self.falling, self.n_docs, self.taken = docs[order], -impact[order], len(n), 0
        self.at = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        by_doc = np.lexsort((terms, docs))
        self.forward = docs[by_doc].astype(np.int64) * len(weights) + terms[by_doc]
        self.forward_impact = impact[by_doc]

    def complete(self, docs: np.ndarray, terms: np.ndarray, repeats: np.ndarray, n_terms: int) -> np.ndarray:
        """Whole scores of these documents."""
        keys = docs.astype(np.int64)[:, None] * n_terms + terms
        where = np.minimum(np.searchsorted(self.forward, keys), len(self.forward) - 1)
        return np.where(self.forward[where] == keys, self.forward_impact[where], 0) @ repeats

    def search(self, terms: np.ndarray, repeats: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, exact scores) that hold every one of the best k with a score of ``floor`` or more."""
        low, high = self.at[terms], self.at[terms + 1]
        there = low < high
        low, high, queried, times = low[there], high[there], terms[there], repeats[there]
        if not len(low):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        partial, at = np.zeros(self.n_docs, np.int64), low.copy()
        kth, step = max(floor, 1), STEP
        while True:
            left = at < high
            if not left.any():
                rest = 0
                break
            # The groups of impact down to the level that some term reaches in a step.
            ahead = np.minimum(at + step, high) - 1
            level = int((-self.falling[ahead[left]] * times[left]).max())
            for t in np.flatnonzero(left).tolist():
                least = -(-level // int(times[t]))
                stop = int(at[t]) + int(np.searchsorted(self.falling[at[t] : high[t]], -least, side="right"))
                if stop > at[t]:
                    partial[self.docs[at[t] : stop]] -= self.falling[at[t] : stop] * times[t]
                    at[t] = stop
            more = at < high
            rest = int((-self.falling[at[more]] * times[more]).sum())
            if self.n_docs >= k:
                kth = max(kth, int(np.partition(partial, self.n_docs - k)[self.n_docs - k]))
            if rest < kth:
                break
            step *= 2
        self.taken = int((at - low).sum())
        # Unseen documents have at most ``rest``; seen ones at most that much more.
        able = np.flatnonzero((partial > 0) & (partial + rest >= kth))
        return able, self.complete(able, queried, times, len(self.at) - 1)


def _best(docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What has one of the k highest scores, with every document that ties with the k-th."""
    if len(scores) > k:
        kept = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        docs, scores = docs[kept], scores[kept]
    return docs, scores


def _firsts(rows: list[tuple], k: int) -> list[tuple]:
    return sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[:k]


def _counts(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n, and the counts of the terms named, of every document that has a term at all."""
    names = session(docs).sparkContext.broadcast(terms)

    def tally(batches):
        number = {t: k for k, t in enumerate(names.value)}
        for batch in batches:
            ids, lengths, found, tfs = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if words := terms_of(text or ""):
                    own = [(number[t], tf) for t, tf in Counter(words).items() if t in number]
                    ids.append(doc_id)
                    lengths.append(len(words))
                    found.append([t for t, _ in own])
                    tfs.append([tf for _, tf in own])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, lengths, found, tfs), _SEEN)], schema=_SEEN)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tally, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def _search_block(docs: DataFrame, queries: list[tuple[int, list[bytes]]], k: int, chunk_postings: int) -> DataFrame:
    """item, doc_id, score: the best k of every shard for each of the block's items."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    items = []
    for item, words in queries:
        own = Counter(number[t] for t in words)
        items.append((item, np.array(list(own), np.int64), np.array(list(own.values()), np.int64)))
    seen = written(_counts(docs, list(number)), "term_counts")
    total = seen.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = seen.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * total.n + 2) / (2 * F.col("df") + 1)))
    weights = np.zeros(len(number), np.int64)
    for r in df.select("term", weight.alias("w")).collect():  # at most the terms of a block
        weights[r.term] = r.w
    shared = session(docs).sparkContext.broadcast((items, weights))
    mean = (total.n, max(1, total.l))

    def shard(batches):
        items, weights = shared.value
        tops: dict[int, list[tuple]] = {}

        def take(ids, n, terms, tfs):
            sizes = np.array([len(x) for x in terms], np.int64)
            if not sizes.sum():
                return
            index = Index(weights, np.array(n, np.int64), mean, np.repeat(np.arange(len(n)), sizes), np.concatenate([np.asarray(x, np.int64) for x in terms]), np.concatenate([np.asarray(x, np.int64) for x in tfs]))
            for q, (_, own, times) in enumerate(items):
                held = tops.get(q, [])
                rows, scores = _best(*index.search(own, times, k, held[-1][1] if len(held) == k else 0), k)
                if len(rows):
                    tops[q] = _firsts(held + [(ids[r], s) for r, s in zip(rows.tolist(), scores.tolist())], k)

        chunk: tuple[list, ...] = ([], [], [], [])
        for batch in batches:
            for part, column in zip(chunk, ("doc_id", "n", "terms", "tfs")):
                values = batch.column(column)
                part.extend(values.to_pylist() if column in ("doc_id", "n") else [v.values.to_numpy() for v in values])
            held = len(chunk[2]) + sum(map(len, chunk[2]))
            if held >= chunk_postings:
                take(*chunk)
                chunk = ([], [], [], [])
        take(*chunk)
        rows = [(items[q][0], doc_id, score) for q, top in tops.items() for doc_id, score in top]
        own = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([*zip(*rows), [own] * len(rows)] if rows else [[]] * 4)], schema=_FOUND)

    return seen.mapInArrow(shard, "item bigint, doc_id bigint, score bigint, shard bigint")


def lexical_top_k(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, chunk_postings: int = CHUNK_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item."""
    spark = session(docs)
    small_batches(spark)
    texts = items.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    texts = written(texts.withColumn("item", F.xxhash64("item_id", "text")), "items")
    # An item has at most half as many terms as bytes; blocks of items are dealt by hash.
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first().bytes
    blocks = max(1, -(-size // (2 * block_terms)))
    found = None
    for b in range(blocks):
        rows = texts.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "text").collect()
        queries = [(r.item, words) for r in rows if (words := terms_of(r.text))]
        if queries:
            part = written(_search_block(docs, queries, k, chunk_postings), "found")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    for within in (Window.partitionBy("item", "shard").orderBy(*order), Window.partitionBy("item").orderBy(*order)):
        found = found.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= k)
    names = texts.select("item", "item_id")
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_top_k(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Every document's score for every item that shares a term with it.
ORACLE = """
WITH cut AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), counted AS (
  SELECT row_no, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM cut WHERE len(terms) > 0
), whole AS (
  SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM counted
), postings AS (
  SELECT row_no, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row_no, unnest(terms) AS term FROM counted) GROUP BY row_no, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * CAST(big_n AS DOUBLE) + 2) / (2 * CAST(count(*) AS DOUBLE) + 1))) AS BIGINT) AS w
  FROM postings, whole GROUP BY term, big_n
), asked AS (
  SELECT item, item_id, term, CAST(count(*) AS BIGINT) AS times FROM (
    SELECT row_number() OVER () AS item, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)
  ) GROUP BY item, item_id, term
), scored AS (
  SELECT item, item_id, c.row_no, c.doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN counted c ON c.row_no = postings.row_no, whole
  GROUP BY item, item_id, c.row_no, c.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, row_no) AS place FROM scored WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 20
"""
