"""Exact top-k search with one KD-tree per shard (operator 9).

Vectors become integers and are dealt to shards by a hash. Each shard is built
once into a KD-tree, median splits on the widest dimension with tight bounding
boxes, and kept as one row in the shared folder. Queries go out in blocks of a
fixed size, so a broadcast never grows with the data. For each query a shard's
tree is walked best box first; a box whose largest possible score lies below the
query's k-th score is not opened, nor is any after it. The k-th scores of a block
come first from a pilot shard and are sent along to all shards, and each task
carries them on from shard to shard.

Scores are inner products of integers: in double precision while every sum stays
below 2**53, with whole numbers of any size otherwise, and held to the range of
a 64-bit number in the result.

Defined cases: vectors that are null, or hold a null or non-finite component,
take no part; vectors of another length than the query are no candidates; empty
vectors score 0; rows that repeat a vec_id are separate rows, and a query leaves
out its own row alone; equal scores are ranked by vec_id, a null one after all
others; a null vec_id is a candidate but no query; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import session, small_batches, written

K, EVERY, SCALE = 10, 100, 1024
SHARD_ROWS, LEAF_ROWS, QUERY_BLOCK = 4096, 128, 4096
FOUND = "query bigint, query_id bigint, row bigint, vec_id bigint, score bigint"
_FOUND = pa.schema([(n, pa.int64()) for n in ("query", "query_id", "row", "vec_id", "score")])


class KDTree:
    """Points in leaf order with the boxes of all nodes; nodes stand before their children.

    ``named`` is false where a point has no id; None: all have.
    """

    def __init__(self, points: np.ndarray, rows: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS, named: np.ndarray | None = None):
        order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, stop, left, right
        low, high = [], []

        def split(start: int, stop: int) -> int:
            own, at = order[start:stop], len(self.nodes)
            box = points[own]
            low.append(box.min(axis=0))
            high.append(box.max(axis=0))
            self.nodes.append((start, stop, -1, -1))
            spread = high[at] - low[at]
            if stop - start > leaf and spread.size and spread.max() > 0:
                middle = (stop - start) // 2
                order[start:stop] = own[np.argpartition(box[:, int(spread.argmax())], middle)]
                left = split(start, start + middle)
                self.nodes[at] = (start, stop, left, split(start + middle, stop))
            return at

        split(0, len(points))
        self.low, self.high = np.array(low), np.array(high)
        self.points, self.rows, self.ids = points[order], rows[order], ids[order]
        self.named = np.ones(len(points), bool) if named is None else named[order]

    def exact_as_double(self, queries: np.ndarray) -> bool:
        most = [int(np.abs(a).max()) if a.size else 0 for a in (self.points.astype(float), queries.astype(float))]
        return most[0] * most[1] * max(1, self.points.shape[1]) < 1 << 53


class TopK:
    """The best k of one query: by score, then by smaller id (none stands last), then by row."""

    def __init__(self, k: int, least: int | None = None):
        self.k, self.best, self.floor = k, [], least

    @property
    def kth(self) -> int | None:
        """Scores below it can't be among the best; equal ones still can."""
        own = self.best[-1][0] if len(self.best) == self.k else None
        own = None if own is None else -own
        return own if self.floor is None else self.floor if own is None else max(own, self.floor)

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, named: np.ndarray | None = None) -> None:
        named = np.ones(len(ids), bool) if named is None else named
        kth = self.kth
        if kth is not None:
            near = scores >= kth
            scores, ids, rows, named = scores[near], ids[near], rows[near], named[near]
        if len(scores) > 4 * self.k:
            # Many equal scores: order only those that can be among the best.
            edge = np.partition(scores, len(scores) - self.k)[-self.k]
            near = scores >= edge
            scores, ids, rows, named = scores[near], ids[near], rows[near], named[near]
        found = sorted(self.best + [(-int(s), not known, i, r) for s, known, i, r in zip(scores.tolist(), named.tolist(), ids.tolist(), rows.tolist())])
        self.best = found[: self.k]


def search(tree: KDTree, queries: np.ndarray, own_rows: np.ndarray, tops: list[TopK]) -> None:
    """Add the tree's points to the tops of the queries, best box first."""
    kind = np.float64 if tree.exact_as_double(queries) else object
    q, low, high, points = (a.astype(kind) for a in (queries, tree.low, tree.high, tree.points))
    # The largest score in a box takes the upper side where the query is positive.
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    for n, top in enumerate(tops):
        bound, heap = bounds[n], [(-bounds[n][0], 0)]
        while heap:
            least, at = heapq.heappop(heap)
            kth = top.kth
            if kth is not None and -least < kth:
                break
            start, stop, left, right = tree.nodes[at]
            if left >= 0:
                heapq.heappush(heap, (-bound[left], left))
                heapq.heappush(heap, (-bound[right], right))
            else:
                scores, rows = points[start:stop] @ q[n], tree.rows[start:stop]
                others = rows != own_rows[n]
                top.add(scores[others], tree.ids[start:stop][others], rows[others], tree.named[start:stop][others])


def integer_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """row, vec_id, v: whole vectors as integers; others take no part."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).cast("long").alias("vec_id"),
        F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE)))).alias("v"),
    )


def build_trees(points: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard with its pickled tree, written to the shared folder."""
    shards = max(1, -(-points.count() // shard_rows))
    schema = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("tree", pa.binary())])

    def build(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        values = np.array(table.column("v").combine_chunks().flatten() if dim else [], np.int64).reshape(table.num_rows, dim)
        most = int(np.abs(values.astype(float)).max()) if values.size else 0
        values = values.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)
        ids = table.column("vec_id")
        tree = KDTree(values.astype(np.int64), table.column("row").to_numpy(), ids.fill_null(0).to_numpy(), named=ids.is_valid().to_numpy())
        tree.points = tree.points.astype(values.dtype)
        return pa.table({"shard": [table.column("shard")[0].as_py()], "dim": [dim], "tree": [pickle.dumps(tree)]}, schema=schema)

    dealt = points.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return written(dealt.groupBy("dim", "shard").applyInArrow(build, "shard bigint, dim int, tree binary"), "trees")


def _scan(trees: DataFrame, block, k: int) -> DataFrame:
    """The best k of each tree's task for every query of a broadcast block."""

    def run(batches):
        tops: dict[int, list[TopK]] = {}
        for batch in batches:
            for dim, packed in zip(batch.column("dim").to_pylist(), batch.column("tree")):
                if dim not in block.value:
                    continue
                queries, rows, _, floors = block.value[dim]
                own = tops.setdefault(dim, [TopK(k, f) for f in floors])
                search(pickle.loads(packed.as_py()), queries, rows, own)
        most, out = (1 << 63) - 1, []
        for dim, own in tops.items():
            _, rows, ids, _ = block.value[dim]
            out += [(int(rows[n]), int(ids[n]), r, None if unnamed else i, max(-most - 1, min(most, -s))) for n, top in enumerate(own) for s, unnamed, i, r in top.best]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], schema=_FOUND)

    return trees.mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, shard_rows: int = SHARD_ROWS, block_rows: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose vec_id is divisible by ``every``."""
    spark = session(vectors)
    small_batches(spark)
    points = written(integer_vectors(vectors), "vectors")
    trees = build_trees(points, shard_rows)
    queries = points.filter(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = -(-queries.count() // block_rows)
    best = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    parts = []
    for b in range(blocks):
        own: dict[int, list] = {}
        for r in queries.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect():
            own.setdefault(len(r.v), []).append(r)
        arrays = {dim: [np.array([r.v for r in rs], np.int64).reshape(len(rs), dim), np.array([r.row for r in rs]), np.array([r.vec_id for r in rs])] for dim, rs in own.items()}
        pilot = _scan(trees.filter("shard = 0"), spark.sparkContext.broadcast({d: (*a, [None] * len(a[1])) for d, a in arrays.items()}), k)
        floor = {r.query: r.kth for r in pilot.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k).collect()}
        full = spark.sparkContext.broadcast({d: (*a, [floor.get(x) for x in a[1].tolist()]) for d, a in arrays.items()})
        parts.append(written(_scan(trees, full, k), "found"))
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Every query row against all other rows, as whole numbers.
ORACLE = """
WITH whole AS (
  SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.row_no AS q, c.vec_id AS vec_id, c.row_no AS c,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.row_no <> c.row_no AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, c) AS place FROM scored
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 10
"""
