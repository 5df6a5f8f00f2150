"""Periodic runs of words by an all-lag vectorised scan (operator 13).

A run is a stretch of consecutive words that repeats with a smallest period ``q``:
words ``q`` apart are identical, it has at least ``max(min_length, min_exp * q)``
words, and no neighbouring word extends it. The word ids of many documents lie in
one array, longest document first, which is compared with itself at every shift up
to n / min_exp; stretches where both sides agree are run-length coded, and long
enough ones are runs. A stretch of m true comparisons covers an aligned block of
(m + 1) // 2, so a shift first compares one word in each block and only documents
with a whole block agreeing are compared word by word. That leaves nothing out and
makes the shifts of a document cost n log n comparisons in all.

Documents of up to ``RANGE_BYTES`` are scanned where they are read, without a
shuffle. A longer one is dealt out as ranges of lags, one task each, so its shifts
run on many machines; the runs found meet again as one row a text (runs are
numbers, at most a few for each word), and only such texts are shuffled.

Defined cases: a null text has no words and no runs; so has an empty one; equal
texts give equal runs; documents are never compared with one another; an empty
table gives an empty result; null and repeated doc_ids pass through; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, session, small_batches, text_bytes

MIN_LENGTH, MIN_EXP = 12, 2
#: Texts beyond this are dealt out as ranges of lags, one for each so many bytes.
RANGE_BYTES = 1 << 20
#: Bytes of text that are split into words at once.
PIECE_BYTES = 1 << 21
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_BLANK = re.compile(rb"[\x20\x09-\x0d]")

Run = tuple[int, int, int]


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded stretch of it at a time."""
    at = 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + PIECE_BYTES)
        end = cut.start() if cut else len(raw)
        yield raw[at:end].split()
        at = end


def _ids(raw: bytes, names: dict) -> np.ndarray:
    parts = [np.fromiter(map(names.__getitem__, words), np.int32, len(words)) for words in _pieces(raw)]
    return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.int32), *parts])


def _names() -> dict:
    return defaultdict(count().__next__)


def _smallest_period(words: np.ndarray, lag: int) -> int:
    """Of words that repeat after ``lag`` at least twice: the smallest period divides it."""
    small = [q for q in range(1, math.isqrt(lag) + 1) if lag % q == 0]
    for q in sorted({*small, *(lag // q for q in small)}):
        if np.array_equal(words[q:], words[:-q]):
            return q
    return lag


class _Known:
    """The runs found so far in a document, to pass over what its multiples would find again."""

    def __init__(self):
        self.rows = np.empty((0, 3), np.int64)
        self.runs: set[Run] = set()

    def add(self, start: int, stop: int, period: int) -> None:
        self.runs.add((start, stop - start, period))
        self.rows = np.vstack([self.rows, [[start, stop, period]]])

    def new(self, at: np.ndarray, lag: int) -> np.ndarray:
        """The places whose stretch at this lag is not one of a known run whose period divides it."""
        self.rows = self.rows[self.rows[:, 1] - self.rows[:, 0] > lag]
        own = self.rows[lag % self.rows[:, 2] == 0] if len(self.rows) else self.rows
        if not len(own):
            return at
        own = own[np.argsort(own[:, 0])]  # these stretches are disjoint
        before = np.searchsorted(own[:, 0], at, side="right") - 1
        return at[(before < 0) | (at >= own[before, 1] - lag)]


def scan(texts: list[np.ndarray], min_length: int, min_exp: float, lags: tuple[int, int] | None = None) -> list[list[Run]]:
    """The runs of each array of word ids; ``lags``: only those that a shift of this range shows."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    sizes = np.array([len(texts[k]) for k in order], np.int64)
    ids = np.concatenate([np.empty(0, np.int32), *(texts[k] for k in order)])
    ends = np.cumsum(sizes)
    known: dict[int, _Known] = {}
    first, last = lags or (1, int(sizes[0] // min_exp) if len(sizes) else 0)
    for lag in range(first, last + 1):
        need = max(min_length, math.ceil(min_exp * lag))
        docs = int(np.searchsorted(-sizes, -need, side="right"))
        if not docs:
            break
        end, least = int(ends[docs - 1]), need - lag
        block = (least + 1) // 2
        at = np.flatnonzero(ids[0 : end - lag : block] == ids[lag:end:block]) * block
        at = at[at + (block - 1 + lag) < end]
        for step in {1, block // 2, block - 1}:
            if 0 < step < block and len(at):
                at = at[ids[at + step] == ids[at + (step + lag)]]
        if not len(at):
            continue
        owners = np.searchsorted(ends, at, side="right")
        inside = at + (block - 1 + lag) < ends[owners]
        at, owners = at[inside], owners[inside]
        for d in np.unique(owners).tolist():
            begin, stop = int(ends[d] - sizes[d]), int(ends[d])
            seen = known.setdefault(d, _Known())
            if not len(seen.new(at[owners == d] - begin, lag)):
                continue
            words = ids[begin:stop]
            same = np.zeros(len(words) - lag + 2, np.int8)
            same[1:-1] = words[:-lag] == words[lag:]
            edges = np.flatnonzero(np.diff(same))
            starts, stops = edges[::2], edges[1::2]
            long = stops - starts >= least
            # Of stretches that a known run shows again, the places are not new.
            for a, b in zip(starts[long].tolist(), stops[long].tolist()):
                if len(seen.new(np.array([a]), lag)):
                    seen.add(a, b + lag, _smallest_period(words[a : b + lag], lag))
    out: list[list[Run]] = [[] for _ in texts]
    for d, seen in known.items():
        out[order[d]] = sorted(seen.runs, key=lambda r: (r[0], r[2]))
    return out


def _collapsed(raw: bytes, n: int, runs: list[Run]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change)[:n] == 0
    parts, at = [], 0
    for words in _pieces(raw):
        parts.append(b" ".join(compress(words, keep[at : at + len(words)].tolist())))
        at += len(words)
    return b" ".join(p for p in parts if p)


def _row_batch(ids, runs, n_words, collapsed, schema):
    listed = [[{"start": a, "length": b, "period": c} for a, b, c in r] for r in runs]
    return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(listed, _RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())], schema=schema)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])
SCHEMA = f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string"


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exp: float = MIN_EXP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row a document: doc_id, n_words, runs (by start, then period) and the collapsed text.

    ``min_exp`` is 2 or more: below, a run's smallest period need not divide its shifts.
    """
    if min_exp < 2:
        raise ValueError("min_exp must be 2 or more")
    small_batches(session(docs))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def here(batches):
        for batch in batches:
            raws = [(t or "").encode() for t in batch.column("text").to_pylist()]
            runs: list[list[Run]] = [[] for _ in raws]
            sizes, group, held, names = [0] * len(raws), [], 0, _names()
            # Texts of like length are scanned together, a bounded stretch of them at a time.
            for k in sorted(range(len(raws)), key=lambda k: len(raws[k])):
                group.append((k, _ids(raws[k], names)))
                sizes[k] = len(group[-1][1])
                held += len(raws[k])
                if held >= PIECE_BYTES:
                    for (j, _), found in zip(group, scan([x for _, x in group], min_length, min_exp)):
                        runs[j] = found
                    group, held, names = [], 0, _names()
            for (j, _), found in zip(group, scan([x for _, x in group], min_length, min_exp)):
                runs[j] = found
            yield _row_batch(batch.column("doc_id"), runs, sizes, [_collapsed(*x) for x in zip(raws, sizes, runs)], _SCHEMA)

    long = text_bytes() > range_bytes
    short = docs.filter(~long).mapInArrow(here, SCHEMA)
    return short.unionByName(_by_ranges(docs.filter(long), min_length, min_exp, range_bytes))


def _by_ranges(docs: DataFrame, min_length: int, min_exp: float, range_bytes: int) -> DataFrame:
    """As ``periodic_runs``; every text's lags are dealt over many tasks. Texts are named by two hashes and a length."""
    named = docs.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text"), "k3": text_bytes()})

    def some_lags(batches):
        for batch in batches:
            rows = []
            for *key, text, part, parts in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "k3", "text", "part", "parts"))):
                ids = _ids(text.encode(), _names())
                last = int(len(ids) // min_exp)
                # A shift's comparisons fall with the lag, but each has a cost of its own.
                lags = (1 + last * part // parts, last * (part + 1) // parts)
                rows += [(*key, *run) for run in scan([ids], min_length, min_exp, lags)[0]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)], names=["k1", "k2", "k3", "start", "length", "period"])

    parts = F.ceil(F.col("k3") / F.lit(range_bytes)).cast("int")
    units = named.select("k1", "k2", "k3", "text", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).repartition("k1", "k2", "part")
    found = units.mapInArrow(some_lags, "k1 bigint, k2 bigint, k3 bigint, start bigint, length bigint, period bigint").distinct()
    whole = found.groupBy("k1", "k2", "k3").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("r"))

    def collapse(batches):
        for batch in batches:
            raws = [t.encode() for t in batch.column("text").to_pylist()]
            runs = [[(x["start"], x["length"], x["period"]) for x in r or []] for r in batch.column("r").to_pylist()]
            sizes = [sum(map(len, _pieces(raw))) for raw in raws]
            yield _row_batch(batch.column("doc_id"), runs, sizes, [_collapsed(*x) for x in zip(raws, sizes, runs)], _SCHEMA)

    return named.join(whole, ["k1", "k2", "k3"], "left").select("doc_id", "text", "r").mapInArrow(collapse, SCHEMA)


def with_repeats(docs: DataFrame) -> DataFrame:
    """The query's documents: of one in ten by crc32 of doc_id, the tail becomes a repetition; null doc_ids stay."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))

    def repeated(words):
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        head, tail = F.slice(words, F.lit(1), a.cast("int")), F.slice(words, (a + 1).cast("int"), p.cast("int"))
        again = F.slice(F.flatten(F.array_repeat(tail, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
        return F.array_join(F.concat(head, again), " ")

    # The lambda's variable holds the words, so that they are split once.
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    text = F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(documents(spark, sf_dir, "doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
