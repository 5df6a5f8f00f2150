"""Preparing the water, stream and bridge layers from raw features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C


def usable_line(points: str = "points") -> Column:
    """At least two vertices that are not all the same place."""
    return (F.size(points) >= 2) & (F.size(F.array_distinct(points)) >= 2)


def stream_lines(records: DataFrame) -> DataFrame:
    return records.filter(F.col("fclass").isin(*C.STREAM_CLASSES))


def bridge_lines(records: DataFrame) -> DataFrame:
    """Bridges that may be walked; a missing class is allowed, a missing mark is no bridge."""
    return records.filter((F.col("bridge") == "T") & (F.col("fclass").isNull() | ~F.col("fclass").isin(*C.NO_FOOT_CLASSES)))


def split_parts(features: DataFrame, parts: str = "parts", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """One row per part of multi-part features; empty parts go.

    With ``kinds``, only parts of those kinds stay (a collection keeps its polygons).
    """
    split = features.select("*", F.posexplode(parts).alias("part", "geometry")).drop(parts)
    split = split.filter(F.size("geometry.points") > 0)
    return split.filter(F.col("geometry.kind").isin(*kinds)) if kinds else split


def flattened_parts(features: DataFrame, parts: str = "parts") -> DataFrame:
    """All parts run together as one line: joins the parts' ends, as old data sets do."""
    return features.withColumn("points", F.flatten(F.transform(parts, lambda p: p["points"])))


def in_box(features: DataFrame, box: dict[str, float] | None = None) -> DataFrame:
    """Features whose stored box meets a box: four range predicates that reach the scan."""
    b = box or C.REGION
    return features.filter((F.col("max_x") >= b["min_lon"]) & (F.col("min_x") <= b["max_lon"]) & (F.col("max_y") >= b["min_lat"]) & (F.col("min_y") <= b["max_lat"]))


def clip_segments(segments: DataFrame, box: dict[str, float]) -> DataFrame:
    """Segments (ax, ay, bx, by) cut to a box (Liang-Barsky); those outside go."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    enter, leave, outside = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for step, gap in ((-dx, F.col("ax") - box["min_lon"]), (dx, box["max_lon"] - F.col("ax")), (-dy, F.col("ay") - box["min_lat"]), (dy, box["max_lat"] - F.col("ay"))):
        at = F.try_divide(gap, step)
        enter.append(F.when(step < 0, at).otherwise(F.lit(0.0)))
        leave.append(F.when(step > 0, at).otherwise(F.lit(1.0)))
        outside = outside | ((step == 0) & (gap < 0))
    cut = segments.withColumns({"t0": F.greatest(*enter), "t1": F.least(*leave), "out": outside}).filter((F.col("t0") <= F.col("t1")) & ~F.col("out"))
    return cut.withColumns({"ax": F.col("ax") + F.col("t0") * dx, "ay": F.col("ay") + F.col("t0") * dy, "bx": F.col("ax") + F.col("t1") * dx, "by": F.col("ay") + F.col("t1") * dy}).drop("t0", "t1", "out")


def _half_plane(axis: str, limit: float, sign: int):
    """A function that cuts a ring to one half-plane."""
    other, at = "y" if axis == "x" else "x", F.lit(limit)

    def inside(p: Column) -> Column:
        return sign * (p[axis] - at) >= 0

    def cut(p: Column, q: Column) -> Column:
        """Where the side from p to q meets the half-plane's border."""
        place = {axis: at, other: p[other] + F.try_divide(at - p[axis], q[axis] - p[axis]) * (q[other] - p[other])}
        return F.struct(place["x"].alias("x"), place["y"].alias("y"))

    def ring_cut(ring: Column) -> Column:
        def of_vertex(q: Column, k: Column) -> Column:
            p = F.element_at(ring, F.when(k == 0, F.size(ring)).otherwise(k).cast("int"))
            return F.array(F.when(inside(p) != inside(q), cut(p, q)), F.when(inside(q), F.struct(q["x"].alias("x"), q["y"].alias("y"))))

        return F.filter(F.flatten(F.transform(ring, of_vertex)), lambda p: p.isNotNull())

    return ring_cut


def clipped_ring(ring: Column, box: dict[str, float]) -> Column:
    """A ring (an array of open vertices x, y) cut to a box: one half-plane after the other, in column functions."""
    for axis, limit, sign in (("x", box["min_lon"], 1), ("x", box["max_lon"], -1), ("y", box["min_lat"], 1), ("y", box["max_lat"], -1)):
        # The lambda's variable holds the ring, so that each half-plane's is worked out once.
        ring = F.transform(F.array(ring), _half_plane(axis, limit, sign))[0]
    return ring


def clip_rings(rings: DataFrame, box: dict[str, float], ring: str = "ring") -> DataFrame:
    """(gid, ring): rings cut to a box; empty ones go."""
    return rings.select(F.col("gid").cast("long").alias("gid"), clipped_ring(F.col(ring), box).alias("ring")).filter(F.size("ring") > 2)


def ring_edges(rings: DataFrame, ring: str = "ring") -> DataFrame:
    """(gid, seq, ax, ay, bx, by): edges of closed rings."""
    n = F.size(ring)
    ends = F.transform(ring, lambda p, k: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.element_at(F.col(ring), ((k + 1) % n + 1).cast("int")).alias("q")))
    return rings.select("gid", F.posexplode(ends).alias("seq", "e")).select("gid", "seq", "e.ax", "e.ay", F.col("e.q.x").alias("bx"), F.col("e.q.y").alias("by"))


def line_edges(lines: DataFrame, points: str = "points") -> DataFrame:
    """(gid, part, seq, ax, ay, bx, by): as ``cost.line_segments`` of the vertices of lines, each line within its own row."""
    n = F.size(points)
    ends = F.transform(F.slice(points, 1, n - 1), lambda p, k: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.element_at(F.col(points), (k + 2).cast("int")).alias("q")))
    edges = lines.filter(n > 1).select("gid", "part", F.posexplode(ends).alias("seq", "e")).select("gid", "part", "seq", "e.ax", "e.ay", F.col("e.q.x").alias("bx"), F.col("e.q.y").alias("by"))
    return edges.filter(~((F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))))


def all_water(inland: DataFrame, ocean: DataFrame) -> DataFrame:
    return inland.unionByName(ocean)


def layer_counts(records: DataFrame) -> DataFrame:
    """Scanned and kept records of each layer, in one pass."""
    streams = F.col("fclass").isin(*C.STREAM_CLASSES)
    bridge = F.coalesce((F.col("bridge") == "T") & (F.col("fclass").isNull() | ~F.col("fclass").isin(*C.NO_FOOT_CLASSES)), F.lit(False))
    return records.agg(F.count("*").alias("scanned"), F.count_if(streams).alias("streams"), F.count_if(bridge).alias("bridges"))


def line_vertices(lines: DataFrame) -> DataFrame:
    """(gid, part, seq, x, y) of lines with arrays of (x, y)."""
    return lines.select("gid", "part", F.posexplode("points").alias("seq", "p")).select("gid", "part", "seq", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def first_rows(df: DataFrame, key: list[str], order: str, n: int = 1) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return df.withColumn("_nth", nth).filter(F.col("_nth") <= n).drop("_nth")
