"""Distances along a track and the place at a given share of it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .. import config as C
from ..functions.geo import haversine_m


def cumulative_distance(points: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """Points with ``step_m`` and ``along_m``, the metres from the first point."""
    at = Window.partitionBy(*key).orderBy(order)
    step = F.coalesce(haversine_m(F.lag("lon").over(at), F.lag("lat").over(at), F.col("lon"), F.col("lat")), F.lit(0.0))
    stepped = points.withColumn("step_m", step)
    return stepped.withColumn("along_m", F.sum("step_m").over(at.rowsBetween(Window.unboundedPreceding, 0)))


def positions_at(points: DataFrame, key: list[str], shares: list[float], order: str = "seq") -> DataFrame:
    """(key, share, lon, lat): the place reached after a share of a track's length.

    Each segment answers the shares that end in it, so no join is needed. Share 1
    is the last point itself; tracks of one point or no length have no places.
    """
    at = Window.partitionBy(*key).orderBy(order)
    whole = Window.partitionBy(*key)
    tracks = cumulative_distance(points, key, order).withColumns({"total": F.max("along_m").over(whole), "n": F.count("*").over(whole), "nth": F.row_number().over(at)})
    segments = tracks.withColumns({"from_m": F.lag("along_m").over(at), "lon0": F.lag("lon").over(at), "lat0": F.lag("lat").over(at)}).filter((F.col("nth") > 1) & (F.col("total") > 0))
    each = segments.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("target", F.col("share") * F.col("total"))
    # The first segment whose end reaches the target; the last one takes what is left.
    held = ((F.col("nth") == 2) | (F.col("target") > F.col("from_m"))) & ((F.col("target") <= F.col("along_m")) | (F.col("nth") == F.col("n")))
    part = F.coalesce(F.try_divide(F.col("target") - F.col("from_m"), F.col("along_m") - F.col("from_m")), F.lit(1.0))
    end = F.col("share") >= 1.0
    place = lambda c: F.when(end & (F.col("nth") == F.col("n")), F.col(c)).otherwise(F.col(f"{c}0") + (F.col(c) - F.col(f"{c}0")) * part)
    return each.filter(F.when(end, F.col("nth") == F.col("n")).otherwise(held)).select(*key, "share", place("lon").alias("lon"), place("lat").alias("lat"))


def track_bounds(points: DataFrame, key: list[str]) -> DataFrame:
    return points.groupBy(*key).agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))


class RoutePoints:
    """The points of one route in order, with the kilometres and the metres climbed so far.

    Each partition of the table argument is a route, and gets an instance of its own,
    which holds one point.
    """

    def __init__(self):
        self.before, self.km, self.climb = None, 0.0, 0.0

    def eval(self, row: Row):
        if self.before is not None:
            lon, lat = math.radians(row["lon"] - self.before["lon"]), math.radians(row["lat"] - self.before["lat"])
            across = math.cos(math.radians(self.before["lat"])) * math.cos(math.radians(row["lat"])) * math.sin(lon / 2) ** 2
            self.km += 2 * C.EARTH_KM * math.asin(math.sqrt(math.sin(lat / 2) ** 2 + across))
            self.climb += max(0.0, row["elev"] - self.before["elev"])
        self.before = row
        yield row["route_id"], row["seq"], row["lon"], row["lat"], row["elev"], self.km, self.climb


def register_route_points(spark: SparkSession, name: str = "route_points") -> None:
    """Makes the points callable in SQL: ``SELECT * FROM route_points(TABLE(points) PARTITION BY route_id ORDER BY seq)``.

    ``points`` has route_id (a string), seq, lon, lat and elev.
    """
    columns = "route_id string, seq bigint, lon double, lat double, elev double, along_km double, climb_m double"
    spark.udtf.register(name, udtf(RoutePoints, returnType=columns))
