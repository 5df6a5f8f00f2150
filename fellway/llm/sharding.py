"""Sharding by sampled splitters (operator 10, DataFrame functions only).

Records are ordered by (hash of the text, doc_id), so equal texts lie next to
each other. Keys are sampled with a chance in proportion to size, quantiles of
the sample become range boundaries, and records are dealt to ranges by comparing
their key with the boundaries. Ranges that hold too much, a large group of equal
texts for one, get more splitters from a sample of their own; the key ends in
doc_id, so a group can be cut anywhere. Exact totals of the ranges then place
the shard limits: a record belongs to the shard in which the middle of its bytes
falls along the whole order.

The law is ``bytes``: shard sizes differ from the mean by one record at most.
``grown_shard`` is null, since this law deals everything anew when shards are
added.

Defined cases: null text has size 1 and the checksum of no bytes; rows that
repeat a doc_id are separate records; a null doc_id stands before all others of its
text and stays null; an empty table gives no rows.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import documents, session, text_bytes, written

SHARDS = 8
#: Records per range aimed at, and sampled keys per range.
ROWS_PER_RANGE, SAMPLES_PER_RANGE = 800, 16
#: Ranges aimed at, at most: boundaries are one literal in the plan. Records are 40
#: bytes each whatever their texts, so at 30 billion records a range is 300 MB.
MOST_RANGES = 4096
#: A range over this many times its fair share is divided again, so often at most.
OVERFULL, ROUNDS = 2.0, 4


def _key() -> Column:
    return F.struct("text_hash", "doc_id", "place")


def _order(key: tuple) -> tuple:
    """A key as Spark compares it: null before every number."""
    return tuple((x is not None, x or 0) for x in key)


def _range_of(bounds: list[tuple]) -> Column:
    """How many boundaries lie below the key, by two levels of search in sorted arrays."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    key = "array<struct<text_hash:bigint,doc_id:bigint,place:bigint>>"

    def below(some: Column) -> Column:
        return F.size(F.filter(some, lambda b: b < _key()))

    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    last, every = _literal([_fields(b[-1]) for b in blocks], key), _literal([[_fields(b) for b in own] for own in blocks], f"array<{key}>")
    block = below(last)
    inner = F.element_at(every, F.least(block + 1, F.lit(len(blocks))).cast("int"))
    return F.when(block >= len(blocks), F.lit(len(bounds))).otherwise(block * step + below(inner)).cast("int")


def _fields(key: tuple) -> dict:
    return dict(zip(("text_hash", "doc_id", "place"), key))


def _literal(values: list, kind: str) -> Column:
    """An array as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _quantiles(sample: list[tuple[tuple, float]], parts: int) -> list[tuple]:
    """Keys that cut a weighted sample into so many parts of near equal weight."""
    sample = sorted(sample, key=lambda x: (_order(x[0]), x[1]))
    total, at, cuts = sum(w for _, w in sample), 0.0, []
    for key, weight in sample:
        at += weight
        if at >= total * (len(cuts) + 1) / parts and len(cuts) < parts - 1:
            cuts.append(key)
            while at >= total * (len(cuts) + 1) / parts and len(cuts) < parts - 1:
                cuts.append(key)
    return sorted(set(cuts), key=_order)


def shard(docs: DataFrame, shards: int = SHARDS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    text = F.col("text").cast("string")
    records = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (text_bytes("text") + 1).alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "records",
    )
    total = records.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    n, size = total.n, total.b or 0
    ranges = max(1, min(MOST_RANGES, n // rows_per_range))
    # A record weighs by its bytes and as a row, so ranges are even in both.
    weight = F.col("size") / F.lit(float(size or 1)) + F.lit(1.0 / (n or 1))

    def sampled(of: DataFrame, share: float, wanted: int) -> list[tuple[tuple, float]]:
        """Keys kept with a chance of weight x wanted / share; certain ones keep their weight."""
        step = share / wanted
        drawn = F.pmod(F.xxhash64("doc_id", "place", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        kept = of.filter(drawn < weight / F.lit(step)).select("text_hash", "doc_id", "place", F.greatest(weight, F.lit(step)).alias("w"))
        return [((r.text_hash, r.doc_id, r.place), r.w) for r in kept.collect()]

    bounds: list[tuple] = _quantiles(sampled(records, 2.0, SAMPLES_PER_RANGE * ranges), ranges) if n and ranges > 1 else []

    def held(dealt: DataFrame) -> dict:
        return {r.range: r for r in dealt.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.sum(weight).alias("w")).collect()}

    for _ in range(ROUNDS):
        dealt = records.withColumn("range", _range_of(bounds))
        totals = held(dealt)
        fair = 2.0 / ranges
        over = {k: r for k, r in totals.items() if r.w > OVERFULL * fair and r.n > 1}
        if not over:
            break
        more = sampled(dealt.filter(F.col("range").isin(*over)), sum(r.w for r in over.values()), SAMPLES_PER_RANGE * len(over) * 4)
        found = set(bounds)
        for k, r in over.items():
            own = [x for x in more if bisect_left(bounds, _order(x[0]), key=_order) == k]
            found |= set(_quantiles(own, int(r.w / fair) + 1))
        if len(found) == len(bounds):
            break
        bounds = sorted(found, key=_order)
    else:
        # The last round moved the boundaries.
        totals = held(records.withColumn("range", _range_of(bounds)))

    # Exact positions along the order: totals of the ranges before, then a running sum inside each.
    rows_before, bytes_before, at_rows, at_bytes = [], [], 0, 0
    for k in range(len(bounds) + 1):
        rows_before.append(at_rows)
        bytes_before.append(at_bytes)
        if k in totals:
            at_rows, at_bytes = at_rows + totals[k].n, at_bytes + totals[k].b
    inside = W.partitionBy("range").orderBy("text_hash", "doc_id", "place")

    def of_range(values: list[int]) -> Column:
        return F.element_at(_literal(values, "array<bigint>"), F.col("range") + 1)

    placed = (
        records.withColumn("range", _range_of(bounds))
        .withColumn("before", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size") + of_range(bytes_before))
        .withColumn("nth", F.row_number().over(inside) - 1 + of_range(rows_before))
        .withColumn("shard", F.least(F.expr(f"((2 * before + size) * {shards}) div {2 * max(size, 1)}"), F.lit(shards - 1)).cast("int"))
    )
    placed = written(placed.select("doc_id", "size", "text_crc32", "shard", "nth"), "placed")
    first = {r.shard: r.nth for r in placed.groupBy("shard").agg(F.min("nth").alias("nth")).collect()}
    start = F.element_at(F.array(*[F.lit(first.get(k, 0)).cast("long") for k in range(shards)]), F.col("shard") + 1)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
