"""Geodesic, tile and walking-speed expressions; all are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    lon1, lat1, lon2, lat2 = map(col, (lon1, lat1, lon2, lat2))
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    # Null stays null: least() would skip it.
    return F.lit(2 * C.EARTH_KM) * F.asin(F.when(h > 1, F.lit(1.0)).otherwise(F.sqrt(h)))


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    return haversine_km(lon1, lat1, lon2, lat2) * 1000.0


def lon_metres(lat) -> Column:
    """Metres per degree of longitude; a degree of latitude has ``M_PER_DEGREE`` everywhere."""
    return F.lit(C.M_PER_DEGREE) * F.cos(F.radians(col(lat)))


def zoom_for(cell_m, lat, low: int = C.MIN_ZOOM, high: int = C.MAX_ZOOM) -> Column:
    """The smallest zoom whose pixels are no larger than a cell, else the largest zoom."""
    cell_m, lat = col(cell_m), col(lat)
    fits = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda z: F.lit(C.PIXEL_M) * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), z) <= cell_m)
    return F.coalesce(F.array_min(fits), F.lit(high))


def tile_floats(lon, lat, zoom) -> tuple[Column, Column]:
    """Fractional web-Mercator tile coordinates."""
    lon, lat, n = col(lon), F.radians(col(lat)), F.pow(F.lit(2.0), col(zoom))
    x = (lon + 180.0) / 360.0 * n
    y = (F.lit(1.0) - F.ln(F.tan(lat) + F.lit(1.0) / F.cos(lat)) / F.lit(3.141592653589793)) / 2.0 * n
    return x, y


def tile_of(lon, lat, zoom) -> tuple[Column, Column]:
    return tuple(v.cast("int") for v in tile_floats(lon, lat, zoom))


def decode_elevation(r, g, b) -> Column:
    return F.lit(-10000.0) + (col(r) * 65536 + col(g) * 256 + col(b)) * 0.1


def walking_kmh(slope) -> Column:
    return F.lit(C.TOP_SPEED_KMH) * F.exp(F.lit(-C.STEEPNESS) * F.abs(col(slope) + C.DOWNHILL_BIAS))


def padded_bbox(waypoints, padding: float | Column = C.PADDING) -> Column:
    """Struct (min_lat, min_lon, max_lat, max_lon) around an array of (lon, lat)."""
    points, padding = col(waypoints), col(padding)
    edge = {}
    for axis, values in (("lon", F.transform(points, lambda p: p["lon"])), ("lat", F.transform(points, lambda p: p["lat"]))):
        low, high = F.array_min(values), F.array_max(values)
        pad = F.greatest((high - low) * padding, F.lit(C.MIN_PAD_DEG))
        edge |= {f"min_{axis}": low - pad, f"max_{axis}": high + pad}
    return F.struct(*[edge[k].alias(k) for k in ("min_lat", "min_lon", "max_lat", "max_lon")])


def cell_size_m(bbox, budget=C.NODE_BUDGET) -> Column:
    """The cell size that keeps a box within the node budget, held to its limits."""
    bbox, budget = col(bbox), col(budget)
    height = F.abs(bbox["max_lat"] - bbox["min_lat"]) * C.M_PER_DEGREE
    width = F.abs(bbox["max_lon"] - bbox["min_lon"]) * lon_metres((bbox["min_lat"] + bbox["max_lat"]) / 2)
    size = F.sqrt(height * width / budget)
    return F.when(height * width <= 0, F.lit(C.MIN_CELL_M)).otherwise(F.greatest(F.lit(C.MIN_CELL_M), F.least(F.lit(C.MAX_CELL_M), size)))
