"""Containment and distance joins as equi-joins on buckets, then exact tests.

A range join would plan as a nested loop. Here every geometry is listed under the
buckets its padded box touches, a point has exactly one bucket, and what meets is
tested exactly.

Polygons are covered by cells that are inside, outside (not listed) or on the
boundary (``cover``). A boundary cell holds only the edges that come into it, so
a polygon of a million edges has no hot key; runs of inside cells are listed as
dyadic intervals, so a large polygon has few. A point meets its own cell alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept, shuffled

#: Degrees of the smallest and largest bucket, and buckets along the largest geometry.
LEAST_DEG, MOST_DEG, ALONG = 0.0002, 0.05, 1000


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def boxes(edges: DataFrame) -> DataFrame:
    """gid with the box of all its edges."""
    return edges.groupBy("gid").agg(
        F.min(F.least("ax", "bx")).alias("min_x"), F.max(F.greatest("ax", "bx")).alias("max_x"), F.min(F.least("ay", "by")).alias("min_y"), F.max(F.greatest("ay", "by")).alias("max_y")
    )


def bucket_size(edges: DataFrame, pad: float = 0.0) -> float:
    """Buckets of about the usual box, so a point meets few boxes it lies outside of.

    The largest box still bounds it: no geometry is listed under more than about
    ``ALONG`` squared buckets.
    """
    extent = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) + 2 * pad
    r = boxes(edges).agg(F.avg(extent).alias("usual"), F.max(extent).alias("most")).first()
    return max(LEAST_DEG, min(MOST_DEG, r.usual), r.most / ALONG) if r.usual is not None else MOST_DEG


def near_boxes(points: DataFrame, edges: DataFrame, pad: float = 0.0, size: float | None = None) -> DataFrame:
    """(points.*, gid) where a point lies in the padded box of a geometry."""
    size = size or bucket_size(edges, pad)
    listed = (
        boxes(edges)
        .select("*", F.explode(_cells(F.col("min_x") - pad, F.col("max_x") + pad, size)).alias("cx"))
        .select("*", F.explode(_cells(F.col("min_y") - pad, F.col("max_y") + pad, size)).alias("cy"))
    )
    at = points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    inside = (F.col("x") >= F.col("min_x") - pad) & (F.col("x") <= F.col("max_x") + pad) & (F.col("y") >= F.col("min_y") - pad) & (F.col("y") <= F.col("max_y") + pad)
    return at.join(listed, ["cx", "cy"]).filter(inside).select(*points.columns, "gid")


#: The widest inside cell: 2 ** TOP_LEVEL cells side by side.
TOP_LEVEL = 16
_EDGE = "struct<ax:double,ay:double,bx:double,by:double>"
COVER = f"gid bigint, level int, cx bigint, cy bigint, odd boolean, turns array<double>, edges array<{_EDGE}>"
_EDGES = pa.list_(pa.struct([(c, pa.float64()) for c in ("ax", "ay", "bx", "by")]))
_COVER = pa.schema([("gid", pa.int64()), ("level", pa.int32()), ("cx", pa.int64()), ("cy", pa.int64()), ("odd", pa.bool_()), ("turns", pa.list_(pa.float64())), ("edges", _EDGES)])


def dyadic(first: int, stop: int) -> list[tuple[int, int]]:
    """(level, place) of the fewest aligned intervals that make up [first, stop)."""
    out, level = [], 0
    while first < stop and level < TOP_LEVEL:
        if first & 1:
            out.append((level, first))
            first += 1
        if stop & 1 and stop > first:
            stop -= 1
            out.append((level, stop))
        first, stop, level = first >> 1, stop >> 1, level + 1
    return out + [(level, k) for k in range(first, stop)]


def cover(edges: DataFrame, size: float) -> DataFrame:
    """The cells of ``size`` degrees that each polygon's edges (gid, ax, ay, bx, by) touch or enclose.

    Whether a point is inside follows from its cell alone: an edge wholly to the
    cell's right is crossed by the point's ray if one of its ends lies above the point
    and the other does not. So such edges matter by their ends only, and where two
    edges meet the ends cancel. What is left are ``odd``, the parity of ends above
    the cell, and ``turns``, the latitudes of ends within it. Cells have a level: one of
    level n is 2 ** n cells wide, and all of it is inside.

    A row of cells of one polygon is worked out at once; its edges lie side by side in a
    sorted partition.
    """

    def strip(gid: int, cy: int, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> list[tuple]:
        first, last = np.floor(np.minimum(ax, bx) / size).astype(np.int64), np.floor(np.maximum(ax, bx) / size).astype(np.int64)
        edge = [{"ax": a, "ay": b, "bx": c, "by": d} for a, b, c, d in zip(ax.tolist(), ay.tolist(), bx.tolist(), by.tolist())]
        if first.min() == last.max():
            return [(gid, 0, int(first[0]), cy, False, [], edge)]
        cells = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first.tolist(), last.tolist())]))
        by_first = np.argsort(first, kind="stable")[::-1]
        rows, at, odd, turns, held = [], 0, False, set(), None
        for cx in cells[::-1].tolist():
            # Edges that begin to the right of this cell join those that matter by their ends.
            while at < len(by_first) and first[by_first[at]] > cx:
                e = by_first[at]
                for y in (float(ay[e]), float(by[e])):
                    place = int(np.floor(y / size))
                    if place > cy:
                        odd = not odd
                    elif place == cy:
                        turns ^= {y}
                at += 1
            # No edge comes into the cells between the last one and this: their parity is one.
            if held is not None and held > cx + 1 and odd and not turns:
                rows += [(gid, level, x, cy, True, [], []) for level, x in dyadic(cx + 1, held)]
            mine = np.flatnonzero((first <= cx) & (last >= cx))
            rows.append((gid, 0, cx, cy, odd, sorted(turns), [edge[e] for e in mine.tolist()]))
            held = cx
        return rows

    def strips_of(batches):
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                now = [batch.column(c).to_numpy() for c in ("gid", "cy", "ax", "ay", "bx", "by")]
                held = now if held is None else [np.concatenate(pair) for pair in zip(held, now)]
            if held is None or not len(held[0]):
                continue
            new = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
            cuts = [0, *new.tolist(), len(held[0])]
            # The last row of cells may go on in the next batch.
            rows, whole = [], len(cuts) - (1 if batch is None else 2)
            for k in range(whole):
                part = slice(cuts[k], cuts[k + 1])
                rows += strip(int(held[0][cuts[k]]), int(held[1][cuts[k]]), *(c[part] for c in held[2:]))
            held = [c[cuts[whole] :] for c in held]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_COVER), _COVER.types)], schema=_COVER)

    strips = edges.select(F.col("gid").cast("long"), "ax", "ay", "bx", "by", F.explode(_cells(F.least("ay", "by"), F.greatest("ay", "by"), size)).alias("cy"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return strips.repartition(parts, "gid", "cy").sortWithinPartitions("gid", "cy").mapInArrow(strips_of, COVER)


def _with_end(batches):
    yield from batches
    yield None


def inside(x: Column, y: Column) -> Column:
    """Whether a point is inside the polygon of the cover's cell it lies in."""
    spans = lambda e: (e["ay"] > y) != (e["by"] > y)
    right = lambda e: x < (e["bx"] - e["ax"]) * F.try_divide(y - e["ay"], e["by"] - e["ay"]) + e["ax"]
    crossed = F.size(F.filter("edges", lambda e: spans(e) & F.coalesce(right(e), F.lit(False)))) + F.size(F.filter("turns", lambda t: t > y))
    return (crossed + F.col("odd").cast("int")) % 2 == 1


def contained(points: DataFrame, edges: DataFrame, key: list[str], size: float | None = None) -> DataFrame:
    """Keys of the points (key, x, y) inside any polygon, by the parity of crossings to the right.

    ``edges`` holds all rings of a polygon under one gid, so holes need no care of
    their own.
    """
    size = size or bucket_size(edges)
    cells, wide = covered(edges, size)
    at = points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    # Semi-joins: of these no more than the cells can be sent whole, never the points.
    own = cells.filter("level = 0").select(F.col("cx").alias("own_x"), F.col("cy").alias("own_y"), "odd", "turns", "edges")
    found = at.join(own, (F.col("cx") == F.col("own_x")) & (F.col("cy") == F.col("own_y")) & inside(F.col("x"), F.col("y")), "left_semi").select(*key)
    if wide:
        found = found.unionByName(at.join(in_wide_cells(at.select("cx", "cy").distinct(), cells, wide).select("cx", "cy").distinct(), ["cx", "cy"], "left_semi").select(*key))
    return found.distinct()


def covered(edges: DataFrame, size: float) -> tuple[DataFrame, list[int]]:
    """The cover, written as several joins read it, and which levels its wide cells have."""
    cells = kept(cover(edges, size), "cover")
    return cells, [r.level for r in cells.filter("level > 0").select("level").distinct().collect()]  # at most TOP_LEVEL


def in_wide_cells(places: DataFrame, cells: DataFrame, levels: list[int]) -> DataFrame:
    """places (with cx, cy) joined with the wide cells they lie in: gid, level, wx."""
    each = places.select("*", F.explode(F.array(*map(F.lit, levels))).alias("level")).withColumn("wx", F.expr("shiftright(cx, level)"))
    return each.join(shuffled(cells.filter("level > 0").select("gid", "level", "cy", F.col("cx").alias("wx"))), ["level", "cy", "wx"])


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """(distance to the nearest place of a segment, place along its line: 0 to 1 between the ends)."""
    dx, dy = bx - ax, by - ay
    along = F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy)
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    ex, ey = px - (ax + held * dx), py - (ay + held * dy)
    return F.sqrt(ex * ex + ey * ey), along


def near_segments(points: DataFrame, segments: DataFrame, pad_x: float, pad_y: float, size: float | None = None) -> DataFrame:
    """(points.*, ax, ay, bx, by) where a point shares a bucket with the padded box of a segment."""
    size = size or bucket_size(segments.withColumn("gid", F.monotonically_increasing_id()), max(pad_x, pad_y))
    listed = (
        segments.select("ax", "ay", "bx", "by")
        .select("*", F.explode(_cells(F.least("ax", "bx") - pad_x, F.greatest("ax", "bx") + pad_x, size)).alias("cx"))
        .select("*", F.explode(_cells(F.least("ay", "by") - pad_y, F.greatest("ay", "by") + pad_y, size)).alias("cy"))
    )
    at = points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    return at.join(listed, ["cx", "cy"]).drop("cx", "cy")


def within_distance(points: DataFrame, segments: DataFrame, distance: float, key: list[str], size: float | None = None) -> DataFrame:
    """Keys of the points within a distance (degrees) of any segment."""
    d, _ = segment_distance(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
    return near_segments(points, segments, distance, distance, size).filter(d <= distance).select(*key).distinct()
