"""DuckDB SQL for the registered queries, from the same definitions.

Each query is a chain of named parts (``PARTS``); ``sql`` puts together what a
query needs. Geometry is tested pair by pair here, where the engine joins on
buckets, and distances are found by a recursive query.
"""

from __future__ import annotations

import re

from .. import config as C
from ..functions.places import ZOOM_BY_KIND
from . import fixtures as X
from .service import SMOKE_LAT, SMOKE_STEP

W = X.WIDTH


def d(x: float) -> str:
    """A number that DuckDB reads as a double."""
    return f"CAST('{x!r}' AS DOUBLE)"


def x_of(column: str) -> str:
    return f"({d(X.LON0)} + ({column}) * {d(X.LON_STEP)})"


def y_of(row: str) -> str:
    return f"({d(X.LAT0)} + ({row}) * {d(X.LAT_STEP)})"


def lon_m(lat: str) -> str:
    return f"({d(C.M_PER_DEGREE)} * cos(radians({lat})))"


def hav_km(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"(2 * {d(C.EARTH_KM)} * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


SCALE = 20
DIRS = ", ".join(f"({k}, {di}, {dj})" for k, (di, dj) in enumerate(C.DIRECTIONS))
_MEAN = f"(SELECT {d(X.LAT0)} + (R - 1) / 2.0 * {d(X.LAT_STEP)} FROM size)"


def seg_distance(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> tuple[str, str]:
    along = f"((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / nullif(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}), 0))"
    held = f"greatest(0.0, least(1.0, {along}))"
    ex, ey = f"({px} - ({ax} + {held} * ({bx} - {ax})))", f"({py} - ({ay} + {held} * ({by} - {ay})))"
    return f"sqrt({ex} * {ex} + {ey} * {ey})", along


def _inside(points: str, edges: str, key: str) -> str:
    """Keys of points inside any polygon, by the parity of crossings."""
    return f"""SELECT DISTINCT {key} FROM (
      SELECT {key}, x, y, gid, count(*) % 2 AS odd FROM {points} p JOIN {edges} e
        ON (e.ay > p.y) <> (e.by > p.y) AND p.x < (e.bx - e.ax) * (p.y - e.ay) / nullif(e.by - e.ay, 0) + e.ax
      GROUP BY {key}, x, y, gid) WHERE odd = 1"""


def _ends(nodes: str) -> str:
    return f"SELECT s.i, s.j, s.k FROM steps s SEMI JOIN {nodes} n ON s.i = n.i AND s.j = n.j UNION SELECT s.i, s.j, s.k FROM steps s SEMI JOIN {nodes} n ON s.ni = n.i AND s.nj = n.j"


def _beside(segments: str) -> str:
    mx = lon_m(_MEAN)
    dist, along = seg_distance("px", "py", "a_x", "a_y", "b_x", "b_y")
    return f"""SELECT i, j, k, min(metres) AS metres FROM (
      SELECT i, j, k, {dist} AS metres, {along} AS along FROM (
        SELECT i, j, k, x * {mx} AS px, y * {d(C.M_PER_DEGREE)} AS py, g.ax * {mx} AS a_x, g.ay * {d(C.M_PER_DEGREE)} AS a_y, g.bx * {mx} AS b_x, g.by * {d(C.M_PER_DEGREE)} AS b_y FROM samples, {segments} g))
      WHERE along >= 0 AND along <= 1 AND metres <= {C.BRIDGE_BUFFER_M} GROUP BY i, j, k"""


_PULL = f"(1.0 + {d(C.BRIDGE_CENTRING)} * least(1.0, metres / {d(C.BRIDGE_BUFFER_M)}))"


def _search(steps: str, start: str) -> str:
    """Least distances from one start, by a recursive query that keeps the best of each node."""
    return f"""dist(i, j, g) USING KEY (i, j) AS (
      SELECT i, j, CAST(0 AS DOUBLE) FROM {start}
      UNION
      SELECT s.ni, s.nj, min(t.g + s.cost) FROM dist t JOIN {steps} s ON s.i = t.i AND s.j = t.j LEFT JOIN recurring.dist o ON o.i = s.ni AND o.j = s.nj
      WHERE o.g IS NULL OR t.g + s.cost < o.g GROUP BY s.ni, s.nj)"""


def _half_plane(of: str, axis: str, limit: str, above: bool) -> str:
    """Rings (gid, seq, x, y) cut by one half-plane: of each vertex the cut before it, and itself if it is inside."""
    other = "y" if axis == "x" else "x"
    inside = f"({{0}}{axis} {'>=' if above else '<='} {limit})"
    cut = {axis: limit, other: f"p{other} + ({limit} - p{axis}) / ({axis} - p{axis}) * ({other} - p{other})"}
    return f"""SELECT gid, row_number() OVER (PARTITION BY gid ORDER BY seq, n) AS seq, x, y FROM (
      SELECT gid, seq, n, CASE n WHEN 0 THEN CASE WHEN {inside.format('p')} <> {inside.format('')} THEN {cut['x']} END ELSE CASE WHEN {inside.format('')} THEN x END END AS x,
        CASE n WHEN 0 THEN CASE WHEN {inside.format('p')} <> {inside.format('')} THEN {cut['y']} END ELSE CASE WHEN {inside.format('')} THEN y END END AS y
      FROM (SELECT *, coalesce(lag(x) OVER w, last_value(x) OVER v) AS px, coalesce(lag(y) OVER w, last_value(y) OVER v) AS py FROM {of}
        WINDOW w AS (PARTITION BY gid ORDER BY seq), v AS (PARTITION BY gid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), (VALUES (0), (1)) u(n)) WHERE x IS NOT NULL"""


_CLIP = {k: d(v) for k, v in {"min_lon": X.LON0, "max_lon": X.LON0 + 30 * X.LON_STEP, "min_lat": X.LAT0, "max_lat": X.LAT0 + 20 * X.LAT_STEP}.items()}

def _tile_x(lon: str) -> str:
    return f"(({lon} + 180.0) / 360.0 * {2**X.RASTER_ZOOM}.0::DOUBLE)"


def _tile_y(lat: str) -> str:
    return f"((1.0 - ln(tan(radians({lat})) + 1.0 / cos(radians({lat}))) / pi()) / 2.0 * {2**X.RASTER_ZOOM}.0::DOUBLE)"


PARTS = {
    "size": f"SELECT max(p_partkey) // {W} + 1 AS R FROM part",
    "nodes": f"SELECT CAST(p_partkey // {W} AS INTEGER) AS i, CAST(p_partkey % {W} AS INTEGER) AS j, {y_of(f'p_partkey // {W}')} AS lat, {x_of(f'p_partkey % {W}')} AS lon, p_retailprice + 0.5 * p_size AS elev FROM part",
    "dirs": f"SELECT * FROM (VALUES {DIRS}) t(k, di, dj)",
    "steps": f"""SELECT i, j, k, ni, nj, dist / 1000.0 / ({C.TOP_SPEED_KMH} * exp(-{C.STEEPNESS} * abs((target - elev) / dist + {d(C.DOWNHILL_BIAS)}))) * (1.0 + {C.CROSS_SLOPE_WEIGHT} * abs(coalesce((up - down) / (2.0 * side), 0.0))) AS cost
      FROM (SELECT a.i, a.j, k, n.i AS ni, n.j AS nj, a.elev, n.elev AS target, p.elev AS up, m.elev AS down,
        sqrt(pow(di * {d(X.LAT_STEP)} * {d(C.M_PER_DEGREE)}, 2) + pow(dj * {d(X.LON_STEP)} * {lon_m('a.lat')}, 2)) AS dist,
        sqrt(pow(dj * {d(X.LAT_STEP)} * {d(C.M_PER_DEGREE)}, 2) + pow(di * {d(X.LON_STEP)} * {lon_m('a.lat')}, 2)) AS side
        FROM nodes a CROSS JOIN dirs JOIN nodes n ON n.i = a.i + di AND n.j = a.j + dj LEFT JOIN nodes p ON p.i = a.i - dj AND p.j = a.j + di LEFT JOIN nodes m ON m.i = a.i + dj AND m.j = a.j - di)""",
    "samples": f"SELECT i, j, k, {x_of('j + (nj - j) * t')} AS x, {y_of('i + (ni - i) * t')} AS y FROM steps, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) u(t)",
    "diamonds": f"""SELECT * FROM (SELECT s_suppkey AS gid, CAST((s_suppkey * 7) % R AS DOUBLE) + {d(0.3)} AS r0, CAST((s_suppkey * 13) % {W} AS DOUBLE) + {d(0.3)} AS c0, {d(0.6)} + 0.5 * (s_nationkey % 3) AS radius, R FROM supplier, size)
      WHERE abs(r0 - 0) + abs(c0 - 0) > radius + 2 AND abs(r0 - (R - 1)) + abs(c0 - {W - 1}) > radius + 2""",
    "corners": f"SELECT gid, seq, {x_of('c0 + dc * radius')} AS x, {y_of('r0 + dr * radius')} AS y FROM diamonds, (VALUES (0, 1, 0), (1, 0, 1), (2, -1, 0), (3, 0, -1)) v(seq, dc, dr)",
    "water": "SELECT a.gid, a.seq, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM corners a JOIN corners b ON a.gid = b.gid AND b.seq = (a.seq + 1) % 4",
    "west_cut": _half_plane("corners", "x", _CLIP["min_lon"], True),
    "east_cut": _half_plane("west_cut", "x", _CLIP["max_lon"], False),
    "south_cut": _half_plane("east_cut", "y", _CLIP["min_lat"], True),
    "north_cut": _half_plane("south_cut", "y", _CLIP["max_lat"], False),
    "strip": f"SELECT seq, {x_of('c')} AS x, {y_of('size.R // 2 + v.r')} AS y FROM size, (VALUES (0, -1.5::DOUBLE, -0.7::DOUBLE), (1, {W}.5::DOUBLE, -0.7::DOUBLE), (2, {W}.5::DOUBLE, 0.7::DOUBLE), (3, -1.5::DOUBLE, 0.7::DOUBLE)) v(seq, c, r)",
    "barrier": "SELECT CAST(1000000001 AS BIGINT) AS gid, a.seq, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM strip a JOIN strip b ON b.seq = (a.seq + 1) % 4",
    "all_water": "SELECT * FROM water UNION ALL SELECT * FROM barrier",
    "points": "SELECT i, j, lon AS x, lat AS y FROM nodes",
    "wet": _inside("points", "water", "i, j"),
    "all_wet": _inside("points", "all_water", "i, j"),
    "barrier_wet": _inside("points", "barrier", "i, j"),
    "blocked": f"{_ends('wet')} UNION ({_inside('samples', 'water', 'i, j, k')})",
    "barrier_blocked": f"{_ends('barrier_wet')} UNION ({_inside('samples', 'barrier', 'i, j, k')})",
    "streams": f"SELECT {x_of('2 * n_nationkey + 0.5')} AS ax, {y_of('0')} AS ay, {x_of('2 * n_nationkey + 0.5')} AS bx, {y_of('R - 1')} AS by FROM nation, size WHERE n_nationkey % 5 = 0",
    "stream_nodes": f"SELECT DISTINCT i, j FROM points p, streams s WHERE {seg_distance('p.x', 'p.y', 's.ax', 's.ay', 's.bx', 's.by')[0]} <= {d(X.STREAM_DEG)}",
    "stream_steps": f"{_ends('stream_nodes')} UNION SELECT i, j, k FROM samples p, streams s WHERE {seg_distance('p.x', 'p.y', 's.ax', 's.ay', 's.bx', 's.by')[0]} <= {d(X.STREAM_DEG)}",
    "bridges": f"SELECT gid, {x_of(f'c0 - (radius + {d(0.7)})')} AS ax, {y_of('r0')} AS ay, {x_of(f'c0 + (radius + {d(0.7)})')} AS bx, {y_of('r0')} AS by FROM diamonds WHERE gid % 4 = 0",
    "beside": _beside("bridges"),
    "barrier_bridge": f"SELECT {x_of('30.1::DOUBLE')} AS ax, {y_of('R // 2 - 1.45::DOUBLE')} AS ay, {x_of('30.1::DOUBLE')} AS bx, {y_of('R // 2 + 1.45::DOUBLE')} AS by FROM size",
    "barrier_beside": _beside("barrier_bridge"),
    "streamed": f"SELECT s.* REPLACE (CASE WHEN z.i IS NOT NULL THEN cost * {C.STREAM_WEIGHT} ELSE cost END AS cost) FROM steps s LEFT JOIN stream_steps z ON s.i = z.i AND s.j = z.j AND s.k = z.k",
    "full_steps": f"""SELECT * FROM (SELECT s.i, s.j, s.k, s.ni, s.nj, CASE WHEN metres IS NOT NULL THEN t.cost * {_PULL} WHEN b.i IS NOT NULL THEN NULL ELSE s.cost END AS cost
      FROM streamed s JOIN steps t ON s.i = t.i AND s.j = t.j AND s.k = t.k LEFT JOIN blocked b ON s.i = b.i AND s.j = b.j AND s.k = b.k LEFT JOIN beside m ON s.i = m.i AND s.j = m.j AND s.k = m.k) WHERE cost IS NOT NULL""",
    "barrier_steps": f"""SELECT * FROM (SELECT s.i, s.j, s.k, s.ni, s.nj, CASE WHEN metres IS NOT NULL THEN s.cost * {_PULL} WHEN b.i IS NOT NULL THEN NULL ELSE s.cost END AS cost
      FROM steps s LEFT JOIN barrier_blocked b ON s.i = b.i AND s.j = b.j AND s.k = b.k LEFT JOIN barrier_beside m ON s.i = m.i AND s.j = m.j AND s.k = m.k) WHERE cost IS NOT NULL""",
    "corner": "SELECT 0 AS i, 0 AS j",
    "cgrid": "SELECT c_custkey, 166.0::DOUBLE + (c_custkey % 130) / 10.0::DOUBLE AS lon, -47.0::DOUBLE + (c_custkey % 120) / 10.0::DOUBLE AS lat, 5.0::DOUBLE + (c_custkey % 60) * 2.0::DOUBLE AS cell_m FROM customer",
    "zoomed": f"SELECT *, coalesce(list_min(list_filter(range({C.MIN_ZOOM}, {C.MAX_ZOOM + 1}), lambda z: {d(C.PIXEL_M)} * cos(radians(lat)) / pow(2.0, z) <= cell_m)), {C.MAX_ZOOM}) AS zoom FROM cgrid",
    # Waypoints of the fixture's requests, by row and column.
    "waypoint_cells": f"""SELECT CAST(r_regionkey AS VARCHAR) AS route_id, r_regionkey AS r, CAST(0 AS INTEGER) AS pos, 0 AS row_, r_regionkey * 2 AS col_ FROM region
      UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_regionkey, 1, R // 2, {X.MIDDLE_COLUMN} FROM region, size WHERE r_regionkey % 2 = 1
      UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_regionkey, CASE WHEN r_regionkey % 2 = 1 THEN 2 ELSE 1 END, R - 1, {W - 1} - r_regionkey FROM region, size""",
    "waypoints": f"SELECT route_id, pos, count(*) OVER (PARTITION BY route_id) AS n, {x_of('col_')} + {d(0.2)} * {d(X.LON_STEP)} AS lon, {y_of('row_')} + {d(0.2)} * {d(X.LAT_STEP)} AS lat, row_, col_ FROM waypoint_cells",
    "snapped": """SELECT route_id, pos, n, (SELECT min_by(i, (abs(l.lat - w.lat), i)) FROM (SELECT DISTINCT i, lat FROM nodes) l) AS i, (SELECT min_by(j, (abs(l.lon - w.lon), j)) FROM (SELECT DISTINCT j, lon FROM nodes) l) AS j FROM waypoints w""",
    "legs": "SELECT * FROM (SELECT route_id, pos + 1 AS leg, i AS si, j AS sj, lead(i) OVER w AS gi, lead(j) OVER w AS gj FROM snapped WINDOW w AS (PARTITION BY route_id ORDER BY pos)) WHERE gi IS NOT NULL",
    "tracks": "SELECT user_id, event_id, ts, 170.0::DOUBLE + (event_id * 37 % 1000) / 1000.0::DOUBLE AS lon, -42.0::DOUBLE + (event_id * 91 % 1000) / 1000.0::DOUBLE AS lat FROM events",
    "stepped": f"SELECT *, coalesce(1000.0::DOUBLE * {hav_km('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')}, 0.0) AS step_m FROM tracks WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "along": "SELECT *, sum(step_m) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS along_m FROM stepped",
    "osm_lines": """SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_suppkey % 11 <> 0 THEN ['river','stream','canal','drain','primary','motorway','path'][l_linenumber % 7 + 1] END AS fclass,
      CASE WHEN l_returnflag = 'R' THEN 'T' WHEN l_returnflag = 'N' THEN NULL ELSE 'F' END AS bridge FROM lineitem""",
    "ways": """SELECT fclass, bridge, CASE WHEN n3 THEN 2 ELSE 1 END AS n, CASE WHEN n3 THEN x + y + (x + 0.001::DOUBLE) + (y + 0.001::DOUBLE) ELSE x + y END AS total FROM (
      SELECT o.fclass, o.bridge, o.l_linenumber % 2 = 1 AS n3, 170.0::DOUBLE + (o.l_orderkey % 100) * 0.01::DOUBLE AS x, -41.0::DOUBLE - o.l_linenumber * 0.01::DOUBLE AS y FROM osm_lines o WHERE o.l_suppkey % 13 <> 0)""",
    "places": """SELECT 'q' || (k % 40) AS query, k AS c_custkey, CASE WHEN k % 6 = 0 THEN '' WHEN k % 7 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN k % 4 = 0 THEN 'Street ' || (k % 9) END AS street,
      CASE WHEN k % 8 = 0 THEN CAST(k % 50 AS VARCHAR) ELSE '' END AS housenumber, CASE WHEN k % 3 = 0 THEN n_name ELSE '' END AS district, CASE WHEN k % 42 <> 0 THEN n_name END AS city,
      CASE WHEN k % 5 = 0 THEN c_mktsegment END AS county, 'State' AS state, CASE WHEN k % 10 = 0 THEN 'nz' WHEN k % 10 = 1 THEN 'AU' WHEN k % 10 = 2 THEN '' END AS countrycode,
      CASE WHEN k % 13 <> 0 THEN ['peak','alpine_hut','yes','lake','','unlisted'][k % 6 + 1] END AS osm_value, CASE WHEN k % 2 = 0 THEN 'natural' END AS osm_key,
      160.0::DOUBLE + (k % 64) * 0.375::DOUBLE AS lon, -55.0::DOUBLE + (k % 96) * 0.25::DOUBLE AS lat, copy, k * 2 + copy AS src_rank
      FROM (SELECT *, c_custkey AS k FROM customer) JOIN nation ON c_nationkey = n_nationkey, (VALUES (0), (1)) v(copy) WHERE copy = 0 OR k % 5 = 0""",
    "labelled": """SELECT *, label || '|' || CAST(CAST(lon AS DECIMAL(28,4)) AS VARCHAR) || ',' || CAST(CAST(lat AS DECIMAL(28,4)) AS VARCHAR) AS place_key FROM (
      SELECT *, coalesce(nullif(name, ''), line, nullif(city, ''), nullif(county, ''), nullif(state, ''), '') AS label FROM (SELECT *, CASE WHEN nullif(street, '') IS NOT NULL THEN CASE WHEN nullif(housenumber, '') IS NOT NULL THEN housenumber || ' ' || street ELSE street END END AS line, coalesce(nullif(osm_value, ''), nullif(osm_key, '')) AS kind FROM places))""",
    "raster": f"SELECT {X.RASTER_X} + o_orderkey % {X.RASTER_WIDTH} AS gx, {X.RASTER_Y} + o_orderkey // {X.RASTER_WIDTH} AS gy, -10000.0::DOUBLE + (65536 + (130 + o_orderkey % 20) * 256 + o_orderkey % 256) * 0.1::DOUBLE AS elev FROM orders",
    "raster_areas": f"""SELECT CAST(r_regionkey AS VARCHAR) AS grid_id, south, west, {d(X.RASTER_CELL_M)} / {d(C.M_PER_DEGREE)} AS lat_step, {d(X.RASTER_CELL_M)} / {lon_m('(south + (south + 0.004::DOUBLE)) / 2')} AS lon_step FROM (
      SELECT r_regionkey, -41.004::DOUBLE - r_regionkey * 0.001::DOUBLE AS south, 174.0::DOUBLE + r_regionkey * 0.008::DOUBLE AS west FROM region)""",
    "raster_nodes": """SELECT grid_id, i, j, south + i * lat_step AS lat, west + j * lon_step AS lon FROM (
      SELECT *, unnest(range(0, CAST(trunc(((south + 0.004::DOUBLE) - south) / lat_step) AS BIGINT) + 1)) AS i FROM raster_areas) JOIN (
      SELECT grid_id AS own, unnest(range(0, CAST(trunc(((west + 0.01::DOUBLE) - west) / lon_step) AS BIGINT) + 1)) AS j FROM raster_areas) ON own = grid_id""",
    "needed_tiles": f"""SELECT DISTINCT tx, ty FROM (SELECT *, unnest(range(x0, x1 + 1)) AS tx FROM (
      SELECT CAST(floor({_tile_x('west')}) AS BIGINT) AS x0, CAST(floor({_tile_x('west + 0.01::DOUBLE')}) AS BIGINT) AS x1, CAST(floor({_tile_y('south + 0.004::DOUBLE')}) AS BIGINT) AS y0, CAST(floor({_tile_y('south')}) AS BIGINT) AS y1 FROM raster_areas)) a, LATERAL (SELECT unnest(range(a.y0, a.y1 + 1)) AS ty)""",
    "tile_elev": f"""SELECT n.grid_id, n.i, n.j, n.lat, CASE WHEN t.tx IS NOT NULL THEN coalesce(p.elev, 0.0) END AS elev FROM (
      SELECT *, greatest(x0, least(x1, CAST(round_even({_tile_x('lon')} * {C.TILE}.0::DOUBLE, 0) AS BIGINT))) AS px, greatest(y0, least(y1, CAST(round_even({_tile_y('lat')} * {C.TILE}.0::DOUBLE, 0) AS BIGINT))) AS py
      FROM raster_nodes, (SELECT min(tx) * {C.TILE} AS x0, max(tx) * {C.TILE} + {C.TILE - 1} AS x1, min(ty) * {C.TILE} AS y0, max(ty) * {C.TILE} + {C.TILE - 1} AS y1 FROM needed_tiles)) n
      LEFT JOIN needed_tiles t ON t.tx = px // {C.TILE} AND t.ty = py // {C.TILE} LEFT JOIN raster p ON p.gx = px AND p.gy = py""",
    "tile_steps": f"""SELECT grid_id, i, j, k, dist / 1000.0 / ({C.TOP_SPEED_KMH} * exp(-{C.STEEPNESS} * abs((target - elev) / dist + {d(C.DOWNHILL_BIAS)}))) * (1.0 + {C.CROSS_SLOPE_WEIGHT} * abs(coalesce((up - down) / (2.0 * side), 0.0))) AS cost
      FROM (SELECT a.grid_id, a.i, a.j, k, a.elev, n.elev AS target, p.elev AS up, m.elev AS down,
        sqrt(pow(di * r.lat_step * {d(C.M_PER_DEGREE)}, 2) + pow(dj * r.lon_step * {lon_m('a.lat')}, 2)) AS dist, sqrt(pow(dj * r.lat_step * {d(C.M_PER_DEGREE)}, 2) + pow(di * r.lon_step * {lon_m('a.lat')}, 2)) AS side
        FROM tile_elev a JOIN raster_areas r USING (grid_id) CROSS JOIN dirs JOIN tile_elev n ON n.grid_id = a.grid_id AND n.i = a.i + di AND n.j = a.j + dj LEFT JOIN tile_elev p ON p.grid_id = a.grid_id AND p.i = a.i - dj AND p.j = a.j + di LEFT JOIN tile_elev m ON m.grid_id = a.grid_id AND m.i = a.i + dj AND m.j = a.j - di)
      WHERE elev IS NOT NULL AND target IS NOT NULL""",
    "api_urls": "SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'api=key' || page_id || CASE WHEN page_id % 2 = 0 THEN '&pipeline=terrain-rgb' ELSE '' END AS url FROM pages",
}


def sql(final: str, search: str | None = None) -> str:
    """A statement with the parts that ``final`` names, directly or not, in order."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in PARTS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                need(PARTS[name])

    need(final + (search or ""))
    parts = [f"{name} AS MATERIALIZED ({PARTS[name]})" for name in PARTS if name in needed]
    return f"WITH RECURSIVE {', '.join([*parts, *([search] if search else [])])}\n{final}" if parts or search else final


def _corner_hours(steps: str) -> str:
    return sql(f"SELECT 'corner' AS route_id, round(g, 9) AS hours FROM dist, size WHERE i = R - 1 AND j = {W - 1}", _search(steps, "corner"))


_LEG_SEARCH = """reach(route_id, leg, i, j, g) USING KEY (route_id, leg, i, j) AS (
      SELECT route_id, leg, si, sj, CAST(0 AS DOUBLE) FROM legs
      UNION
      SELECT t.route_id, t.leg, s.ni, s.nj, min(t.g + s.cost) FROM reach t JOIN full_steps s ON s.i = t.i AND s.j = t.j LEFT JOIN recurring.reach o ON o.route_id = t.route_id AND o.leg = t.leg AND o.i = s.ni AND o.j = s.nj
      WHERE o.g IS NULL OR t.g + s.cost < o.g GROUP BY t.route_id, t.leg, s.ni, s.nj)"""

_PATH = f"""{_LEG_SEARCH},
    pred AS MATERIALIZED (SELECT t.route_id, t.leg, s.ni, s.nj, arg_min(s.i, (t.g + s.cost, s.i, s.j)) AS pi, arg_min(s.j, (t.g + s.cost, s.i, s.j)) AS pj FROM reach t JOIN full_steps s ON s.i = t.i AND s.j = t.j GROUP BY ALL),
    chase(route_id, leg, i, j, back) AS (
      SELECT l.route_id, l.leg, gi, gj, 0 FROM legs l JOIN reach r ON l.route_id = r.route_id AND l.leg = r.leg AND l.gi = r.i AND l.gj = r.j
      UNION ALL
      SELECT c.route_id, c.leg, p.pi, p.pj, back + 1 FROM chase c JOIN legs l ON c.route_id = l.route_id AND c.leg = l.leg AND NOT (c.i = l.si AND c.j = l.sj) JOIN pred p ON p.route_id = c.route_id AND p.leg = c.leg AND p.ni = c.i AND p.nj = c.j),
    path AS MATERIALIZED (SELECT c.route_id, c.leg, max(back) OVER (PARTITION BY c.route_id, c.leg) - back AS seq, c.i, c.j, n.lon, n.lat, n.elev, r.g FROM chase c JOIN nodes n ON c.i = n.i AND c.j = n.j JOIN reach r ON r.route_id = c.route_id AND r.leg = c.leg AND r.i = c.i AND r.j = c.j)"""

_SHORT = "(CASE WHEN {p} = 0 THEN 'Start' WHEN {p} = legs_n THEN 'End' ELSE 'Waypoint ' || ({p}) END)"
_LONG = "(CASE WHEN {p} = 0 THEN 'Start point' WHEN {p} = legs_n THEN 'End point' ELSE 'Waypoint ' || {p} END)"
_WATER = "' falls within a mapped water or snow/ice body — pick a point on dry land.'"
_IN_REGION = "(CASE WHEN nullif(countrycode, '') IS NOT NULL THEN upper(countrycode) = 'NZ' ELSE lat <= -33.0 AND lat >= -52.7 AND ((lon >= 165.5 AND lon <= 180) OR (lon >= -180 AND lon <= -175.0)) END)"
_ZOOM = "CASE WHEN nullif(housenumber, '') IS NOT NULL THEN 17 WHEN nullif(street, '') IS NOT NULL THEN 16 ELSE coalesce(CASE kind " + " ".join(f"WHEN '{k}' THEN {z}" for k, z in ZOOM_BY_KIND.items()) + " END, 13) END"
_BOX = {"ax": "min_lon", "ay": "min_lat"}
_B = {k: d(v) for k, v in {"min_lon": X.LON0, "max_lon": X.LON0 + 30 * X.LON_STEP, "min_lat": X.LAT0, "max_lat": X.LAT0 + 20 * X.LAT_STEP}.items()}
_T0 = f"greatest(0.0, CASE WHEN -(g.bx - g.ax) < 0 THEN (g.ax - {_B['min_lon']}) / -(g.bx - g.ax) ELSE 0 END, CASE WHEN (g.bx - g.ax) < 0 THEN ({_B['max_lon']} - g.ax) / (g.bx - g.ax) ELSE 0 END, CASE WHEN -(g.by - g.ay) < 0 THEN (g.ay - {_B['min_lat']}) / -(g.by - g.ay) ELSE 0 END, CASE WHEN (g.by - g.ay) < 0 THEN ({_B['max_lat']} - g.ay) / (g.by - g.ay) ELSE 0 END)"
_T1 = f"least(1.0, CASE WHEN -(g.bx - g.ax) > 0 THEN (g.ax - {_B['min_lon']}) / -(g.bx - g.ax) ELSE 1 END, CASE WHEN (g.bx - g.ax) > 0 THEN ({_B['max_lon']} - g.ax) / (g.bx - g.ax) ELSE 1 END, CASE WHEN -(g.by - g.ay) > 0 THEN (g.ay - {_B['min_lat']}) / -(g.by - g.ay) ELSE 1 END, CASE WHEN (g.by - g.ay) > 0 THEN ({_B['max_lat']} - g.ay) / (g.by - g.ay) ELSE 1 END)"
_KEPT = "list_filter([CASE WHEN nullif(name, '') IS NOT NULL THEN line END, CASE WHEN nullif(district, '') IS DISTINCT FROM nullif(name, '') THEN nullif(district, '') END, CASE WHEN nullif(city, '') IS DISTINCT FROM nullif(name, '') THEN nullif(city, '') END, CASE WHEN nullif(county, '') IS DISTINCT FROM nullif(name, '') THEN nullif(county, '') END, CASE WHEN nullif(state, '') IS DISTINCT FROM nullif(name, '') THEN nullif(state, '') END], lambda v: v IS NOT NULL)"
_ROLE = "CASE WHEN pos = 0 THEN 'start' WHEN pos = n - 1 THEN 'end' ELSE 'via' END"

ORACLE_SQL = {
    "terrain_grid": sql("SELECT i, j, round(lat, 9) AS lat, round(lon, 9) AS lon, elev FROM nodes"),
    "raster_grid": sql(f"""SELECT n.grid_id, CAST(n.i AS INTEGER) AS i, CAST(n.j AS INTEGER) AS j, round(lat, 9) AS lat, round(lon, 9) AS lon, round(p.elev, 1) AS elev FROM (
      SELECT *, greatest(x0, least(x1, CAST(round_even((lon + 180.0) / 360.0 * {2**X.RASTER_ZOOM * C.TILE}.0::DOUBLE, 0) AS BIGINT))) AS px,
        greatest(y0, least(y1, CAST(round_even((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * {2**X.RASTER_ZOOM * C.TILE}.0::DOUBLE, 0) AS BIGINT))) AS py
      FROM raster_nodes, (SELECT min(gx) AS x0, max(gx) AS x1, min(gy) AS y0, max(gy) AS y1 FROM raster)) n LEFT JOIN raster p ON p.gx = px AND p.gy = py"""),
    "tile_elevation": sql("SELECT grid_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(elev, 1) AS elev FROM tile_elev"),
    "raster_to_cost": sql("SELECT grid_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, round(cost, 9) AS cost FROM tile_steps"),
    "tile_source": sql(f"""SELECT CAST(tx AS INTEGER) AS tile_x, CAST(ty AS INTEGER) AS tile_y, CAST({C.TILE * C.TILE} AS BIGINT) AS n, round(least(min(elev), CASE WHEN count(elev) < {C.TILE * C.TILE} THEN 0.0 ELSE min(elev) END), 1) AS low, round(greatest(max(elev), CASE WHEN count(elev) < {C.TILE * C.TILE} THEN 0.0 ELSE max(elev) END), 1) AS high
      FROM range(CAST(floor({_tile_x(d(X.TILE_BOX['min_lon']))}) AS BIGINT), CAST(floor({_tile_x(d(X.TILE_BOX['max_lon']))}) AS BIGINT) + 1) a(tx), range(CAST(floor({_tile_y(d(X.TILE_BOX['max_lat']))}) AS BIGINT), CAST(floor({_tile_y(d(X.TILE_BOX['min_lat']))}) AS BIGINT) + 1) b(ty)
      LEFT JOIN raster ON gx // {C.TILE} = tx AND gy // {C.TILE} = ty GROUP BY tx, ty"""),
    "route_display": """SELECT o_orderkey, CAST(CAST(o_orderkey / 64.0::DOUBLE AS DECIMAL(28,2)) AS VARCHAR) || ' km' AS distance, CAST(CAST(floor(o_orderkey / 8.0::DOUBLE + 0.5) AS BIGINT) AS VARCHAR) || ' m' AS climb,
      'Longitude: ' || CAST(CAST(174.0::DOUBLE + o_orderkey / 2048.0::DOUBLE AS DECIMAL(28,5)) AS VARCHAR) || '° Latitude: ' || CAST(CAST(-41.0::DOUBLE - o_orderkey / 1024.0::DOUBLE AS DECIMAL(28,5)) AS VARCHAR) || '° ' AS place,
      CAST(greatest(1, least(2 + o_orderkey % 4, 1 + len(list_filter(range(1, 3 + o_orderkey % 4), lambda n: n * 40 < o_orderkey % 300)))) AS INTEGER) AS rank FROM orders""",
    "geojson_route": sql("""SELECT route_id, '{"type":"Feature","geometry":{"type":"LineString","coordinates":[' || string_agg('[' || CAST(round(lon, 7) AS VARCHAR) || ',' || CAST(round(lat, 7) AS VARCHAR) || ']', ',' ORDER BY leg, seq) || ']}}' AS feature,
      '[' || string_agg(CAST(round(elev, 1) AS VARCHAR), ',' ORDER BY leg, seq) || ']' AS elevations FROM path GROUP BY route_id""", _PATH),
    "gpx_export": sql("""SELECT route_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<gpx version="1.1" creator="fellway" xmlns="http://www.topografix.com/GPX/1/1">' || chr(10) || '  <trk>' || chr(10) || '    <name>Route ' || route_id || '</name>' || chr(10) || '    <trkseg>' || chr(10)
      || string_agg('      <trkpt lat="' || CAST(CAST(lat AS DECIMAL(28,7)) AS VARCHAR) || '" lon="' || CAST(CAST(lon AS DECIMAL(28,7)) AS VARCHAR) || '">' || chr(10) || '        <ele>' || CAST(CAST(elev AS DECIMAL(28,1)) AS VARCHAR) || '</ele>' || chr(10) || '      </trkpt>', chr(10) ORDER BY leg, seq)
      || chr(10) || '    </trkseg>' || chr(10) || '  </trk>' || chr(10) || '</gpx>' AS gpx FROM path GROUP BY route_id""", _PATH),
    "tile_index": sql("""SELECT c_custkey, CAST(zoom AS INTEGER) AS zoom, CAST(floor((lon + 180.0) / 360.0 * pow(2.0, zoom)) AS INTEGER) AS tile_x,
      CAST(floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * pow(2.0, zoom)) AS INTEGER) AS tile_y FROM zoomed"""),
    "zoom_pick": sql("SELECT CAST(zoom AS INTEGER) AS zoom, count(*) AS n FROM zoomed GROUP BY zoom"),
    "rgb_decode": sql("SELECT o_orderkey, round(-10000.0 + (65536 + (130 + o_orderkey % 20) * 256 + o_orderkey % 256) * 0.1::DOUBLE, 1) AS elev FROM orders"),
    "great_circle": sql(f"SELECT c_custkey, round({hav_km('lon', 'lat', '174.0::DOUBLE', '-41.0::DOUBLE')}, 6) AS km, round({lon_m('lat')}, 6) AS lon_m, round(6.0::DOUBLE * exp(-4.0::DOUBLE * abs((c_custkey % 21 - 10) / 20.0::DOUBLE + 0.05::DOUBLE)), 9) AS kmh FROM cgrid"),
    "directional_cost": sql("SELECT i, j, k, ni, nj, round(cost, 9) AS cost FROM steps"),
    "cross_slope": sql("SELECT k, count(*) AS n, round(sum(cost), 6) AS hours FROM steps GROUP BY k"),
    "water_mask": sql("SELECT i, j FROM wet"),
    "water_union": sql("SELECT i, count(*) AS wet FROM all_wet GROUP BY i"),
    "step_crossing": sql("SELECT i, j, k FROM blocked"),
    "stream_penalty": sql("SELECT i, j, k, round(cost, 9) AS cost FROM streamed"),
    "bridge_restore": sql("SELECT i, j, k, round(cost, 9) AS cost FROM full_steps"),
    "spatial_prefilter": sql(f"SELECT gid, count(*) AS n FROM points p JOIN (SELECT gid, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM water GROUP BY gid) b ON x BETWEEN x0 - {d(2 * X.LON_STEP)} AND x1 + {d(2 * X.LON_STEP)} AND y BETWEEN y0 - {d(2 * X.LON_STEP)} AND y1 + {d(2 * X.LON_STEP)} GROUP BY gid"),
    "nearest_snap": sql("SELECT route_id, pos, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM snapped"),
    "waypoints_in_water": sql(f"""SELECT route_id, min_by(CASE WHEN pos = 0 THEN 'Start point' WHEN pos = 2 THEN 'End point' ELSE 'Waypoint ' || pos END, pos) || ' falls within a mapped water or snow/ice body — pick a point on dry land.' AS error FROM (
      SELECT route_id, pos, x, y, gid, count(*) % 2 AS odd FROM (
        SELECT CAST(s_suppkey AS VARCHAR) AS route_id, pos, CASE pos WHEN 0 THEN {x_of('0.0::DOUBLE')} WHEN 1 THEN {x_of(f'CAST((s_suppkey * 13) % {W} AS DOUBLE) + 0.4::DOUBLE')} ELSE {x_of(f'CAST((s_suppkey * 5) % {W} AS DOUBLE) + 0.4::DOUBLE')} END AS x,
          CASE pos WHEN 0 THEN {y_of('0.0::DOUBLE')} WHEN 1 THEN {y_of('CAST((s_suppkey * 7) % R AS DOUBLE) + 0.5::DOUBLE')} ELSE {y_of('CAST((s_suppkey * 3) % R AS DOUBLE) + 0.5::DOUBLE')} END AS y FROM supplier, size, (VALUES (0), (1), (2)) v(pos)) p
      JOIN water e ON (e.ay > p.y) <> (e.by > p.y) AND p.x < (e.bx - e.ax) * (p.y - e.ay) / nullif(e.by - e.ay, 0) + e.ax GROUP BY ALL) WHERE odd = 1 GROUP BY route_id"""),
    "sssp_terrain": _corner_hours("steps"),
    "sssp_full": _corner_hours("full_steps"),
    "sssp_barrier": _corner_hours("barrier_steps"),
    "sssp_blocks": sql("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(g, 9) AS hours FROM dist", _search("steps", "corner")),
    "multi_leg_summary": sql("SELECT l.route_id, CAST(l.leg AS INTEGER) AS leg, round(g, 9) AS estimated_hours FROM legs l JOIN reach r ON l.route_id = r.route_id AND l.leg = r.leg AND l.gi = r.i AND l.gj = r.j", _LEG_SEARCH),
    "route_profile": sql("SELECT route_id, CAST(leg AS INTEGER) AS leg, CAST(seq AS INTEGER) AS seq, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(elev, 4) AS elev, round(g, 9) AS hours FROM path", _PATH),
    "route_summary": sql(f"""SELECT f.route_id, f.leg IS NULL AS ok, f.error, CASE WHEN f.leg IS NULL THEN round(km, 6) END AS distance_km, CASE WHEN f.leg IS NULL THEN round(hours, 9) END AS estimated_hours,
      CASE WHEN f.leg IS NULL THEN round(climb, 4) END AS climb_m, CASE WHEN f.leg IS NULL THEN n END AS n_points FROM (
        SELECT route_id, min(leg) FILTER (reason IS NOT NULL) AS leg, min_by(CASE WHEN legs_n = 1 THEN reason ELSE {_SHORT.format(p='leg - 1')} || ' → ' || {_SHORT.format(p='leg')} || ' failed: ' || reason END, leg) FILTER (reason IS NOT NULL) AS error FROM (
          SELECT l.*, CASE WHEN a.i IS NOT NULL THEN {_LONG.format(p='(leg - 1)')} || {_WATER} WHEN b.i IS NOT NULL THEN {_LONG.format(p='leg')} || {_WATER} WHEN r.g IS NULL THEN 'No path found between those two points.' END AS reason
          FROM (SELECT *, count(*) OVER (PARTITION BY route_id) AS legs_n FROM legs) l LEFT JOIN wet a ON a.i = si AND a.j = sj LEFT JOIN wet b ON b.i = gi AND b.j = gj LEFT JOIN (SELECT route_id, leg AS leg_, i, j, g FROM reach) r ON r.route_id = l.route_id AND r.leg_ = l.leg AND r.i = gi AND r.j = gj) GROUP BY route_id) f
      LEFT JOIN (SELECT route_id, sum(km) AS km, sum(hours) AS hours, sum(climb) AS climb, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT route_id, leg, coalesce(sum(km), 0.0) AS km, max(g) AS hours, coalesce(sum(greatest(rise, 0.0)), 0.0) AS climb, count(*) AS n FROM (
          SELECT *, {hav_km('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')} AS km, elev - lag(elev) OVER w AS rise FROM path WINDOW w AS (PARTITION BY route_id, leg ORDER BY seq)) GROUP BY route_id, leg) GROUP BY route_id) t ON t.route_id = f.route_id""", _PATH),
    "service_answers": """SELECT CAST(k AS VARCHAR) AS route_id, CASE WHEN m IN (2, 3, 5) THEN 400 ELSE 200 END AS status, m NOT IN (2, 3, 5) AS ok, CASE WHEN m = 6 THEN true END AS warm,
      CASE m WHEN 2 THEN 'End point falls within a mapped water or snow/ice body — pick a point on dry land.' WHEN 3 THEN 'No path found - most likely due to open ocean, or a detour larger than we can reach' WHEN 5 THEN 'Bad request: not a JSON object' END AS error,
      CASE WHEN m IN (0, 1, 7) THEN 0.3::DOUBLE WHEN m = 4 THEN 1.2::DOUBLE END AS padding, CASE WHEN m IN (0, 1, 4, 7) THEN true END AS whole FROM (SELECT s_suppkey AS k, s_suppkey % 8 AS m FROM supplier)""",
    "warm_up_route": f"""SELECT CAST(s_suppkey AS VARCHAR) AS request, CAST(n AS INTEGER) AS seq, CAST(n AS INTEGER) AS i, CAST(n AS INTEGER) AS j,
      round(coalesce((SELECT sum(sqrt(pow({d(SMOKE_STEP)} * {d(C.M_PER_DEGREE)}, 2) + pow({d(SMOKE_STEP)} * {lon_m(f'{d(SMOKE_LAT)} + r * {d(SMOKE_STEP)}')}, 2)) / 1000.0 / (6.0 * exp(-4.0 * 0.05::DOUBLE))) FROM range(0, n) u(r)), 0.0), 12) AS hours
      FROM supplier, range(0, 3) v(n) WHERE s_suppkey % 8 = 6""",
    "connectivity": sql("SELECT (c // 1000000) || ',' || (c % 1000000) AS component, count(*) AS n FROM comp GROUP BY c", """dry AS MATERIALIZED (SELECT i, j FROM nodes ANTI JOIN all_wet USING (i, j)),
      comp(i, j, c) USING KEY (i, j) AS (
        SELECT i, j, CAST(i AS BIGINT) * 1000000 + j FROM dry
        UNION
        SELECT n.i, n.j, min(t.c) FROM comp t JOIN dry n ON n.i BETWEEN t.i - 1 AND t.i + 1 AND n.j BETWEEN t.j - 1 AND t.j + 1 JOIN recurring.comp o ON o.i = n.i AND o.j = n.j WHERE t.c < o.c GROUP BY n.i, n.j)"""),
    "bbox_dynamic": sql("""SELECT route_id, round(min(lat) - greatest((max(lat) - min(lat)) * 0.3::DOUBLE, 0.01::DOUBLE), 9) AS min_lat, round(min(lon) - greatest((max(lon) - min(lon)) * 0.3::DOUBLE, 0.01::DOUBLE), 9) AS min_lon,
      round(max(lat) + greatest((max(lat) - min(lat)) * 0.3::DOUBLE, 0.01::DOUBLE), 9) AS max_lat, round(max(lon) + greatest((max(lon) - min(lon)) * 0.3::DOUBLE, 0.01::DOUBLE), 9) AS max_lon FROM waypoints GROUP BY route_id"""),
    "cell_budget": sql(f"""SELECT k AS o_orderkey, round(CASE WHEN h * w <= 0 THEN 10.0::DOUBLE ELSE greatest(10.0::DOUBLE, least(1000.0::DOUBLE, sqrt(h * w / (1000 * (1 + k % 2000))))) END, 6) AS cell_m FROM (
      SELECT o_orderkey AS k, abs(-41.0::DOUBLE - lo) * {d(C.M_PER_DEGREE)} AS h, abs(174.0::DOUBLE + o_orderkey % 11 / 3.0::DOUBLE - 174.0::DOUBLE) * {lon_m('(lo + -41.0::DOUBLE) / 2')} AS w FROM (SELECT o_orderkey, -41.0::DOUBLE - o_orderkey % 7 / 10.0::DOUBLE AS lo FROM orders))"""),
    "cumulative_distance": sql("SELECT user_id, event_id, round(along_m, 3) AS along_m FROM along"),
    "interpolate_along": sql("""SELECT user_id, share, round(CASE WHEN share >= 1 THEN lon ELSE lon0 + (lon - lon0) * part END, 7) AS lon, round(CASE WHEN share >= 1 THEN lat ELSE lat0 + (lat - lat0) * part END, 7) AS lat FROM (
      SELECT *, coalesce((share * total - from_m) / nullif(along_m - from_m, 0), 1.0) AS part FROM (
        SELECT *, lag(along_m) OVER w AS from_m, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, row_number() OVER w AS nth, count(*) OVER (PARTITION BY user_id) AS n, max(along_m) OVER (PARTITION BY user_id) AS total FROM along WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) v(share)
      WHERE nth > 1 AND total > 0 AND CASE WHEN share >= 1 THEN nth = n ELSE (nth = 2 OR share * total > from_m) AND (share * total <= along_m OR nth = n) END)"""),
    "track_bounds": sql("SELECT user_id, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM tracks GROUP BY user_id"),
    "etl_stream_filter": sql("SELECT fclass, count(*) AS n FROM osm_lines WHERE fclass IN ('river', 'stream', 'canal') GROUP BY fclass"),
    "etl_bridge_filter": sql("SELECT l_orderkey, l_linenumber, fclass FROM osm_lines WHERE bridge = 'T' AND (fclass IS NULL OR fclass NOT IN ('motorway', 'motorway_link', 'trunk', 'trunk_link'))"),
    "etl_layer_counts": sql("SELECT count(*) AS scanned, count(*) FILTER (fclass IN ('river', 'stream', 'canal')) AS streams, count(*) FILTER (bridge = 'T' AND (fclass IS NULL OR fclass NOT IN ('motorway', 'motorway_link', 'trunk', 'trunk_link'))) AS bridges FROM osm_lines"),
    "etl_multipart_explode": "SELECT p_partkey AS gid, CAST(n - 1 AS INTEGER) AS part, CAST(v - 1 AS INTEGER) AS seq, CAST(p_partkey + n * 10 + v AS DOUBLE) AS ax, CAST(p_partkey - v AS DOUBLE) AS ay, CAST(p_partkey + n * 10 + v + 1 AS DOUBLE) AS bx, CAST(p_partkey - v - 1 AS DOUBLE) AS by FROM part, range(1, 3) a(n), range(1, 4) b(v) WHERE v + 1 <= p_size % 4",
    "ocean_bbox_clip": sql(f"""SELECT gid, round(abs(sum((x - {d(X.LON0)}) * (y1 - {d(X.LAT0)}) - (x1 - {d(X.LON0)}) * (y - {d(X.LAT0)}))) / 2.0 / ({d(X.LON_STEP)} * {d(X.LAT_STEP)}), 6) AS cells FROM (
      SELECT gid, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1, count(*) OVER (PARTITION BY gid) AS n FROM north_cut WINDOW w AS (PARTITION BY gid ORDER BY seq)) WHERE n > 2 GROUP BY gid"""),
    "line_bbox_clip": sql(f"SELECT gid, round(h.ax + t0 * (h.bx - h.ax), 9) AS ax, round(h.ay + t0 * (h.by - h.ay), 9) AS ay, round(h.ax + t1 * (h.bx - h.ax), 9) AS bx, round(h.ay + t1 * (h.by - h.ay), 9) AS by FROM (SELECT g.*, {_T0} AS t0, {_T1} AS t1 FROM bridges g WHERE NOT (g.by = g.ay AND (g.ay < {_B['min_lat']} OR g.ay > {_B['max_lat']}))) h WHERE t0 <= t1"),
    "prepare_job": sql(f"""SELECT 'streams' AS layer, (SELECT count(*) FROM lineitem) AS scanned, CAST(sum(n) AS BIGINT) AS written, round(sum(total), 3) AS total FROM ways WHERE fclass IN ('river', 'stream', 'canal')
      UNION ALL SELECT 'bridges', (SELECT count(*) FROM lineitem), CAST(sum(n) AS BIGINT), round(sum(total), 3) FROM ways WHERE bridge = 'T' AND (fclass IS NULL OR fclass NOT IN ('motorway', 'motorway_link', 'trunk', 'trunk_link'))
      UNION ALL SELECT 'water', (SELECT count(*) FROM diamonds), count(*), round(sum(w.ax + w.by), 3) FROM water w
      UNION ALL SELECT 'ocean', (SELECT count(*) FROM nation), count(*) * 4, round(sum(2 * (x0 + x1) + 2 * (y0 + y0 + 1)), 3) FROM (SELECT x0, least(x0 + 3, 180.0) AS x1, y0 FROM (SELECT 178.05::DOUBLE + n_nationkey * 0.2::DOUBLE AS x0, -40.0::DOUBLE - n_nationkey * 0.1::DOUBLE AS y0 FROM nation) WHERE x0 <= 180)"""),
    "shape_layer": """SELECT CASE WHEN l_suppkey % 11 <> 0 THEN ['river','stream','canal','drain','primary','motorway','path'][l_linenumber % 7 + 1] END AS fclass, CASE WHEN l_returnflag = 'R' THEN 'T' WHEN l_returnflag = 'N' THEN NULL ELSE 'F' END AS bridge, count(*) AS n,
      CAST(sum(CASE WHEN l_linenumber % 2 = 1 THEN 3 ELSE 2 END) AS BIGINT) AS vertices, round(min(170.0::DOUBLE + (l_orderkey % 100) * 0.01::DOUBLE), 6) AS west, round(max(-41.0::DOUBLE - l_linenumber * 0.01::DOUBLE + CASE WHEN l_linenumber % 2 = 1 AND l_suppkey % 13 <> 0 THEN 0.001::DOUBLE ELSE 0 END), 6) AS north FROM lineitem GROUP BY 1, 2""",
    "place_dedupe_topk": sql(f"""SELECT query, c_custkey, label, place_key FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY src_rank) AS nth FROM (
      SELECT *, row_number() OVER (PARTITION BY query, place_key ORDER BY src_rank) AS copy_nth FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY src_rank) AS fetched FROM labelled)
      WHERE fetched <= 12 AND {_IN_REGION} AND label <> '') WHERE copy_nth = 1) WHERE nth <= 7"""),
    "place_labels": sql(f"SELECT c_custkey, label, array_to_string(list_filter({_KEPT}, lambda v, k: list_position({_KEPT}, v) = k)[1:3], ', ') AS detail, CASE WHEN kind IS NULL OR kind = 'yes' THEN '' ELSE replace(kind, '_', ' ') END AS kind_label FROM labelled WHERE copy = 0"),
    "kind_zoom": sql(f"SELECT {_ZOOM} AS zoom, count(*) AS n FROM labelled WHERE copy = 0 GROUP BY 1"),
    "redact_keys": sql("""SELECT page_id, regexp_replace(url, '([?&]api=)[^&\\s"'']+', '\\1***REDACTED***', 'g') AS redacted FROM api_urls"""),
    "proxy_path": "SELECT page_id, replace(url_encode(url_decode(replace(regexp_replace(url, '^https?://', ''), '+', '%2B') || '/a b%20c%2Bd/é')), '%2F', '/') AS path FROM pages",
    "tile_url_rewrite": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://other.example/x.png' ELSE 'https://own.example/proxy/tiles/' || page_id || '.png?pipeline=rgb' END AS url FROM pages",
    "key_stripping": sql("SELECT page_id, replace(replace(url, '?api=key' || page_id, ''), '&api=key' || page_id, '') AS url FROM api_urls"),
    "waypoint_roles": sql(f"SELECT route_id, pos, {_ROLE} AS role, CASE WHEN pos = 0 THEN 'Start' WHEN pos = n - 1 THEN 'End' ELSE 'Waypoint ' || pos END AS label, CASE WHEN pos = 0 THEN 'Start point' WHEN pos = n - 1 THEN 'End point' ELSE 'Waypoint ' || pos END AS name, CAST(CAST(lat AS DECIMAL(28,4)) AS VARCHAR) || '°, ' || CAST(CAST(lon AS DECIMAL(28,4)) AS VARCHAR) || '°' AS shown FROM waypoints"),
    "friendly_errors": "SELECT k AS c_custkey, CASE WHEN k % 3 = 0 THEN 'No path found between those two points.' ELSE (CASE k % 4 WHEN 0 THEN 'Start' ELSE 'Waypoint ' || (k % 4) END) || ' → ' || (CASE k % 4 WHEN 3 THEN 'End' ELSE 'Waypoint ' || (k % 4 + 1) END) || ' failed: reason ' || k END AS message FROM (SELECT c_custkey AS k FROM customer)",
    "durations": "SELECT o_orderkey, CAST(o_orderkey // 64 AS VARCHAR) || 'h ' || CAST(CAST(floor((o_orderkey % 64) / 64.0::DOUBLE * 60 + 0.5) AS BIGINT) AS VARCHAR) || 'm' AS shown FROM orders",
    "request_parse": "SELECT CAST(k AS VARCHAR) AS route_id, m = 3 AS warm, CASE WHEN m IN (0, 3, 5) THEN 200 ELSE 400 END AS status, CASE WHEN m IN (0, 5) THEN k END AS node_budget, CASE WHEN m IN (0, 5) THEN 3 END AS n_waypoints, CASE WHEN m IN (0, 5) THEN 170.5::DOUBLE + k % 5 END AS last_lon FROM (SELECT c_custkey AS k, c_custkey % 6 AS m FROM customer)",
    "area_layer": sql(f"""SELECT gid, n, total FROM (SELECT w.gid, count(*) AS n, round(sum(w.ax + w.by), 6) AS total, floor(min(w.ax) / {d(X.STORE_CELL)}) AS x0, floor(max(w.ax) / {d(X.STORE_CELL)}) AS x1, floor(min(w.ay) / {d(X.STORE_CELL)}) AS y0, floor(max(w.ay) / {d(X.STORE_CELL)}) AS y1 FROM water w GROUP BY w.gid)
      SEMI JOIN (SELECT floor(west / {d(X.STORE_CELL)}) AS a0, floor((west + 0.0004::DOUBLE) / {d(X.STORE_CELL)}) AS a1, floor(south / {d(X.STORE_CELL)}) AS b0, floor((south + 0.0004::DOUBLE) / {d(X.STORE_CELL)}) AS b1 FROM (SELECT {d(X.LAT0)} + n_nationkey * 0.001::DOUBLE AS south, {d(X.LON0)} + n_nationkey * 0.0005::DOUBLE AS west FROM nation)) ON x0 <= a1 AND x1 >= a0 AND y0 <= b1 AND y1 >= b0"""),
    "query_keys": "SELECT c_custkey, lower(c_name) AS key FROM customer",
    "http_requests": "SELECT k AS o_orderkey, CAST(k AS VARCHAR) AS x_order, CASE WHEN k % 4 = 2 THEN 'https://site2.example' ELSE 'https://site1.example' END AS origin, CASE WHEN k % 3 = 0 THEN 'POST' WHEN k % 5 = 0 THEN 'OPTIONS' ELSE 'GET' END AS method FROM (SELECT o_orderkey AS k FROM orders)",
    "cli_waypoints": "SELECT c_custkey, CAST(2 + c_custkey % 4 AS INTEGER) AS n, '174.0 -41.0;' || array_to_string(list_concat(list_transform(range(1, 1 + c_custkey % 4), lambda n: CAST(n * 0.5::DOUBLE + 170 AS VARCHAR) || ' -4' || n || '.25'), ['175.0 -41.0']), ';') AS points FROM customer",
    "response_bodies": """SELECT CAST(k AS VARCHAR) AS route_id, CASE WHEN k % 3 > 0 THEN 200 ELSE 400 END AS status, CASE WHEN k % 3 > 0 THEN '{"ok":true,"n_points":' || k || '}' ELSE '{"ok":false,"error":"no tile https://t.example/x.png?api=***REDACTED***&z=1"}' END AS body FROM (SELECT p_partkey AS k FROM part)""",
    "gpx_files": "SELECT count(DISTINCT user_id) AS tracks, count(*) AS points, max('<name>Track ' || user_id || '</name>') AS last FROM events",
    "route_points_sql": sql(f"""SELECT CAST(user_id AS VARCHAR) AS route_id, event_id AS seq, round(sum(km) OVER w, 6) AS along_km, round(CAST(sum(rise) OVER w AS DOUBLE), 6) AS climb_m FROM (
      SELECT user_id, event_id, coalesce({hav_km('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')}, 0.0) AS km, greatest(0, event_id % 100 - coalesce(lag(event_id % 100) OVER w, event_id % 100)) AS rise FROM tracks WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"""),
    "grid_counts": sql("SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'wet', count(*) FROM wet UNION ALL SELECT 'streams', count(*) FROM stream_nodes UNION ALL SELECT 'reached', count(*) FROM dist", _search("full_steps", "corner")),
    "debounce_sessions": "SELECT user_id AS session, count(*) AS n FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) > 3600000000 GROUP BY user_id",
    "latest_wins": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type",
    "waypoint_edits": f"""SELECT k AS c_custkey, array_to_string(list_concat(w[1:n - 1], [-1], w[n:n]), ',') AS added, array_to_string(list_filter(w, lambda v, p: p <> 2), ',') AS removed,
      array_to_string(list_concat(w[1:1], w[3:3], w[2:2], w[4:n]), ',') AS moved, array_to_string(w[2:n - 1], ',') AS vias, n >= {C.MAX_WAYPOINTS} AS full, n >= 3 AS ready
      FROM (SELECT k, w, len(w) AS n FROM (SELECT c_custkey AS k, list_transform(range(0, 4 + c_custkey % 4), lambda p: c_custkey * 10 + p) AS w FROM customer))""",
}
