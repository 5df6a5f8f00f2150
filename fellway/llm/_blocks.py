"""Chunks of documents as compressed blocks, and polynomial hashes over byte ranges.

Both substring operators deal documents once into chunks by ranges of doc_id and
then talk between chunks through buckets of hashes. A chunk's documents travel
as compressed Arrow blocks, so the one shuffle of texts stays small; every later
stage that needs the texts reads the same shuffle again.
"""

from __future__ import annotations

import ctypes
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import session, small_batches, text_bytes

#: How many ids are drawn to place the borders of chunks, and what a row weighs besides its bytes.
SAMPLES, ROW_BYTES = 8192, 256
#: Bytes of text that a block holds at most; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
_PACKED = pa.schema([("chunk", pa.int32()), ("block", pa.binary())])


def _pack(ids: np.ndarray, texts: list[bytes], carried: pa.Array | None = None) -> bytes:
    columns = {"doc_id": pa.array(ids), "text": pa.array(texts, pa.large_binary())}
    if carried is not None:
        columns["carried"] = carried
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


#: Stands for a null doc_id.
_NO_ID = (1 << 63) - 1


def id_of(value: int) -> int | None:
    return None if value == _NO_ID else int(value)


def unpack(table: pa.Table, sort: bool = True, carried: bool = False):
    """Ids and texts of a chunk, in order of doc_id or as they were packed; with ``carried`` also what was carried along."""
    parts = [pa.ipc.open_stream(b.as_py()).read_all() for b in table.column("block")]
    if not parts:
        return (np.zeros(0, np.int64), [], None)[: 3 if carried else 2]
    whole = pa.concat_tables(parts)
    ids = whole.column("doc_id").to_numpy()
    if sort:
        order = np.argsort(ids, kind="stable")
        whole, ids = whole.take(pa.array(order)), ids[order]
    texts = whole.column("text").to_pylist()
    return (ids, texts, whole.column("carried")) if carried else (ids, texts)


def content_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(chunk, block) rows in no order of doc_id: every block is a chunk, named by its content, its task and how often it came before there.

    Blocks are bounded in bytes whatever ids and texts repeat, equal blocks are chunks of
    their own, and a block's name and the order inside it are the same each time it is made.
    """
    spark = session(docs)
    small_batches(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col("text").cast("string"))
    schema = pa.schema([("chunk", pa.int64()), ("block", pa.binary())])

    def pack(batches):
        task, before = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_numpy(), [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for a, b in grouped([len(t) for t in texts], block_bytes):
                block = _pack(ids[a:b], texts[a:b])
                digest = xxhash.xxh3_64_intdigest(block)
                before[digest] += 1
                name = xxhash.xxh3_64_intdigest(f"{digest} {task} {before[digest]}")
                yield pa.RecordBatch.from_arrays([pa.array([name - (1 << 63)], pa.int64()), pa.array([block], pa.binary())], schema=schema)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return docs.mapInArrow(pack, "chunk bigint, block binary").repartition(parts, "chunk")


class _Ranges:
    """Chunks by ranges of ids, planned from a sorted sample; an id heavier than a chunk has chunks of its own."""

    def __init__(self, sample: np.ndarray, chunks: int):
        known, times = np.unique(sample, return_counts=True)
        per = chunks / max(1, len(sample))
        heavy = (times > 1) & (times * per > 1)
        self.heavy, self.chunks, self.stretches, self.own = known[heavy], 0, [], []
        at = [0, *(np.searchsorted(sample, self.heavy, "left")).tolist(), len(sample)]
        after = [0, *(np.searchsorted(sample, self.heavy, "right")).tolist()]
        for k in range(len(self.heavy) + 1):
            light = sample[after[k] : at[k + 1]]
            n = max(1, round(len(light) * per))
            self.stretches.append((self.chunks, n, light.astype(float) if len(light) else np.zeros(1)))
            self.chunks += n
            if k < len(self.heavy):
                n = max(1, round(int(times[heavy][k]) * per))
                self.own.append((self.chunks, n))
                self.chunks += n

    def chunks_of(self, ids: np.ndarray, texts: list[bytes]) -> np.ndarray:
        at = np.searchsorted(self.heavy, ids, "left")
        is_heavy = np.zeros(len(ids), bool)
        if len(self.heavy):
            is_heavy = self.heavy[np.minimum(at, len(self.heavy) - 1)] == ids
        out = np.zeros(len(ids), np.int64)
        for k in np.unique(at[~is_heavy]).tolist():
            mine = ~is_heavy & (at == k)
            base, n, edges = self.stretches[k]
            out[mine] = base + np.minimum(np.interp(ids[mine].astype(float), edges, np.linspace(0, n, len(edges))).astype(np.int64), n - 1)
        for x in np.flatnonzero(is_heavy).tolist():
            base, n = self.own[at[x]]
            out[x] = base + xxhash.xxh3_64_intdigest(texts[x]) % n
        return out


def rank_of(own: list[tuple[int, int]], chunks: np.ndarray) -> np.ndarray:
    """Ranks of chunks: their own numbers, but the chunks of one heavy id (first, how many) have the number of the first."""
    if not own:
        return chunks
    first, n = np.array(own, np.int64).T
    at = np.maximum(np.searchsorted(first, chunks, "right") - 1, 0)
    return np.where((chunks >= first[at]) & (chunks < first[at] + n[at]), first[at], chunks)


def carried_column(docs: DataFrame) -> Column:
    """All columns but the text, and whether that is null, as one struct."""
    row = F.struct(*(docs[c] for c in docs.columns if c != "text"))
    return F.struct(row.alias("row"), F.col("text").isNull().alias("none")).alias("carried")


def chunked(docs: DataFrame, chunk_bytes: int = BLOCK_BYTES, carried: bool = False) -> tuple[DataFrame, _Ranges]:
    """(chunk, block) rows dealt by chunk, and the plan of the chunks, with their number and ranks.

    Chunks are ranges of doc_id of near equal weight (bytes, and a little for a row),
    in order: every doc_id of a chunk is smaller than those of chunks of a larger rank.
    The rows of a doc_id that would overfill a chunk, null for one, are dealt to
    several chunks of one rank. Null texts are empty; a null doc_id stands after all
    others. With ``carried`` the other columns, doc_id as it is, and whether the text
    is null go along.
    """
    spark = session(docs)
    small_batches(spark)
    along = [carried_column(docs)] if carried else []
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col("text").cast("string"), *along)
    weight = text_bytes("text") + ROW_BYTES
    total = int(docs.agg(F.sum(weight)).first()[0] or 0)
    chunks = max(1, -(-total // chunk_bytes))
    drawn = []
    if chunks > 1:
        # A sample of ids by weight, of about SAMPLES rows at any size.
        drawn = [r.doc_id for r in docs.filter(F.rand(11) < weight * F.lit(SAMPLES / total)).select("doc_id").collect()]
    plan = _Ranges(np.sort(np.array(drawn, np.int64)), chunks)

    def pack(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            own = plan.chunks_of(ids, texts)
            order = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.diff(own[order])) + 1
            more = (lambda part: batch.column("carried").take(pa.array(part))) if carried else (lambda part: None)
            out = [(int(own[part[0]]), _pack(ids[part], [texts[x] for x in part], more(part))) for part in np.split(order, cuts) if len(part)]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], schema=_PACKED)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return docs.mapInArrow(pack, "chunk int, block binary").repartition(parts, "chunk"), plan


#: An odd multiplier, and a fixed random number for every byte value.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_OF_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 19)
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes; different inputs stay different."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


class PrefixHash:
    """Polynomial prefix hashes of a sequence of numbers, modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        power, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power[:n], out=self.sums[1:])

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> "PrefixHash":
        return cls(_OF_BYTE[data])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def every(self, width: int) -> np.ndarray:
        """Hashes of all spans of one width."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def grouped(lengths: list[int], most: int = 1 << 18) -> list[tuple[int, int]]:
    """Runs of consecutive texts of about ``most`` bytes together; a longer text stands alone."""
    runs, first, held = [], 0, 0
    for k, n in enumerate(lengths):
        if k > first and held + n > most:
            runs.append((first, k))
            first, held = k, 0
        held += n + 1
    if first < len(lengths):
        runs.append((first, len(lengths)))
    return runs


def to_buckets(hashes: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Sorted hashes cut by their leading bits into (bucket, hashes)."""
    own = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(own)) + 1
    return [(int(own[a]), hashes[a:b]) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]) if b > a]


def give_back() -> None:
    """Return freed memory to the system: a worker serves many groups, and heaps keep what they had at most."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def numbers(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]
