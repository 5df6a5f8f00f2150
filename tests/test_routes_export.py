"""Routes, retries, profiles, exports, layers and requests."""

import json
import struct
import xml.etree.ElementTree as ET
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fellway.operators import export, grid, layers, profile, routes
from fellway.sources import dem, requests


def points(spark):
    rows = [("r", 1, 0, 174.0, -41.0, 10.0), ("r", 1, 1, 174.001, -41.0, 12.04), ("r", 2, 0, 174.001, -41.0, 12.0), ("r", 2, 1, 174.001, -41.002, 9.0)]
    return spark.createDataFrame(rows, "route_id string, leg int, seq int, lon double, lat double, elev double").withColumn("g", F.col("seq") * 0.5)


def test_statistics_count_joints_twice(spark):
    legs = routes.leg_statistics(points(spark))
    total = routes.route_statistics(legs).first()
    assert (total.n_points, total.estimated_hours) == (4, 1.0)
    assert abs(total.climb_m - 2.04) < 1e-9 and 0.3 < total.distance_km < 0.31


def test_snap_takes_the_nearest_and_the_lower(spark):
    axes = spark.createDataFrame([("g", 0.0, 0.0, 1.0, 1.0, 5, 4)], "grid_id string, lat0 double, lon0 double, lat_step double, lon_step double, rows int, cols int")
    rows = [(k, 1, "g", lon, lat) for k, (lon, lat) in enumerate([(-3.0, 9.0), (1.5, 2.5), (1.6, 2.4), (2.99, 0.0)])]
    got = routes.snapped(spark.createDataFrame(rows, "pos int, n int, grid_id string, lon double, lat double"), axes).orderBy("pos").collect()
    assert [(r.i, r.j) for r in got] == [(4, 0), (2, 1), (2, 2), (0, 3)]


def test_retries(spark):
    point = lambda x: (x, -41.0)
    frame = spark.createDataFrame([(n, [point(174.0), point(174.1)], 1000) for n in ("first", "second", "water", "never")], "route_id string, waypoints array<struct<lon:double,lat:double>>, node_budget bigint")
    seen, now = [], [0.0]

    def attempt(area):
        seen.append({r.route_id: r.bbox for r in area.collect()})
        ok = F.col("route_id").isin("first", "second") if len(seen) > 1 else F.col("route_id") == "first"
        return area.select("route_id", ok.alias("ok"), F.when(~ok, F.lit("why")).alias("error"), F.when(~ok, F.col("route_id") != "water").alias("retry_worthy"))

    diagnose = lambda area: area.select("route_id", F.lit(True).alias("connected"))
    got = {r.route_id: r for r in routes.route_with_retries(frame, attempt, diagnose, clock=lambda: now[0]).collect()}
    assert [sorted(s) for s in seen] == [["first", "never", "second", "water"], ["never", "second"], ["never"]]
    assert got["first"].padding_frac_used == 0.3 and got["second"].padding_frac_used == 0.6 and got["water"].error == "why"
    assert got["never"].error == "No path found - but paths are connected" and not got["never"].ok
    assert seen[1]["second"].max_lon > seen[0]["second"].max_lon

    def slow(area):
        now[0] += 100
        return attempt(area)

    seen.clear()
    routes.route_with_retries(frame, slow, diagnose, clock=lambda: now[0]).collect()
    assert len(seen) == 1


def test_leg_errors(spark):
    leg = lambda n, a, b: ("g", "r", n, n, 0, n + 1, 0, 1.5, 2.0, 3.0, 4.0, a, b)
    legs = spark.createDataFrame([leg(1, "Start point", "Waypoint 1"), leg(2, "Waypoint 1", "End point")], "grid_id string, route_id string, leg int, si int, sj int, gi int, gj int, a_lon double, a_lat double, b_lon double, b_lat double, a_label string, b_label string")
    done = spark.createDataFrame([("r", 1, 1.0, 1.0, 1.0, 2)], "route_id string, leg int, distance_km double, estimated_hours double, climb_m double, n_points bigint")
    dry = spark.createDataFrame([], "grid_id string, i int, j int")
    r = routes.route_results(legs, dry, done).first()
    assert (r.ok, r.retry_worthy, r.error) == (False, True, "Leg 2 ((1.5, 2.0) -> (3.0, 4.0)) failed: No path found between those two points.")
    r = routes.route_results(legs, spark.createDataFrame([("g", 2, 0)], "grid_id string, i int, j int"), done).first()
    assert not r.retry_worthy and r.error.startswith("Leg 1 (") and "Waypoint 1 falls within" in r.error


def test_profile(spark):
    got = {r.share: r for r in profile.positions_at(points(spark).filter("leg = 1"), ["route_id"], [0.0, 0.5, 1.0]).collect()}
    assert got[0.0].lon == 174.0 and abs(got[0.5].lon - 174.0005) < 1e-9 and got[1.0].lon == 174.001
    along = profile.cumulative_distance(points(spark), ["route_id", "leg"]).orderBy("leg", "seq").collect()
    assert along[0].along_m == 0 and along[2].along_m == 0 and 222 < along[3].along_m < 223


def test_geojson_and_gpx(spark):
    row = export.geojson(points(spark), ["route_id"]).select(F.to_json("route").alias("f"), "elevations_m").first()
    feature = json.loads(row.f)
    assert feature["geometry"]["coordinates"] == [[174.0, -41.0], [174.001, -41.0], [174.001, -41.0], [174.001, -41.002]]
    assert row.elevations_m == [10.0, 12.04, 12.0, 9.0]
    gpx = export.gpx(points(spark), ["route_id"], "A & <B>").first().gpx
    root = ET.fromstring(gpx.encode())
    space = {"g": "http://www.topografix.com/GPX/1/1"}
    assert root.find("g:trk/g:name", space).text == "A & <B>"
    assert [(p.get("lat"), p.get("lon"), p[0].text) for p in root.iter("{%s}trkpt" % space["g"])][1] == ("-41.0000000", "174.0010000", "12.0")
    plain = ET.fromstring(gpx.encode())
    ET.register_namespace("", space["g"])
    ET.indent(plain, "  ")
    assert ET.tostring(plain, encoding="unicode").split("\n")[1:] == gpx.split("\n")[2:]


def test_responses(spark):
    frame = spark.createDataFrame([("a", True, None, 1.5), ("b", False, "bad ?api=secret", None)], "route_id string, ok boolean, error string, distance_km double")
    got = {r.route_id: (r.status, json.loads(r.body)) for r in export.responses(frame).collect()}
    assert got == {"a": (200, {"ok": True, "distance_km": 1.5}), "b": (400, {"ok": False, "error": "bad ?api=***REDACTED***"})}


def test_layers(spark):
    lines = spark.createDataFrame([("river", "T"), (None, "T"), ("motorway", "T"), ("path", None), ("stream", "F")], "fclass string, bridge string")
    assert sorted(r.fclass for r in layers.stream_lines(lines).collect()) == ["river", "stream"]
    assert {r.fclass for r in layers.bridge_lines(lines).collect()} == {"river", None}
    assert tuple(layers.layer_counts(lines).first()) == (5, 2, 2)
    box = {"min_lon": 0.0, "max_lon": 1.0, "min_lat": 0.0, "max_lat": 1.0}
    segments = spark.createDataFrame([(1, -1.0, 0.5, 2.0, 0.5), (2, 2.0, 2.0, 3.0, 3.0), (3, 0.2, 0.2, 0.4, 0.4), (4, -1.0, 2.0, 2.0, 2.0)], "gid int, ax double, ay double, bx double, by double")
    got = {r.gid: tuple(r)[1:] for r in layers.clip_segments(segments, box).collect()}
    assert set(got) == {1, 3} and got[3] == (0.2, 0.2, 0.4, 0.4) and np.allclose(got[1], (0, 0.5, 1, 0.5))
    shapes = [(1, [(-1.0, -1.0), (2.0, -1.0), (2.0, 2.0), (-1.0, 2.0)]), (2, [(2.0, 2.0), (3.0, 2.0), (3.0, 3.0)]), (3, [(0.5, 0.5), (1.5, 0.5), (0.5, 1.5)]), (4, [])]
    cut = layers.clip_rings(spark.createDataFrame(shapes, "gid long, ring array<struct<x:double,y:double>>"), box)
    assert "Python" not in cut._jdf.queryExecution().toString() and "Arrow" not in cut._jdf.queryExecution().toString()
    rings = {r.gid: sorted((p.x, p.y) for p in r.ring) for r in cut.collect()}
    assert rings == {1: [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)], 3: [(0.5, 0.5), (0.5, 1.0), (1.0, 0.5), (1.0, 1.0), (1.0, 1.0)]}


def test_layers_are_written_once(spark, tmp_path):
    one, two = spark.createDataFrame([(1,)], "gid int"), spark.createDataFrame([(1,), (2,)], "gid int")
    export.write_layers({"water": one}, str(tmp_path))
    export.write_layers({"water": two}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/water").count() == 1
    export.write_layers({"water": two}, str(tmp_path), overwrite=True)
    assert spark.read.parquet(f"{tmp_path}/water").count() == 2


def test_requests(spark):
    good = '{"a":[1,2],"b":[3.5,4],"via":[[5,6]],"node_budget":9}'
    rows = [("good", good, False), ("list", "[1]", False), ("broken", "{", False), ("none", None, False), ("short", '{"a":[1],"b":[1,2]}', False), ("warm", '{"warm":true}', False), ("budget", '{"a":[1,2],"b":[1,2],"node_budget":"x"}', False), ("coded", "eyJhIjpbMSwyXSwiYiI6WzMsNF19", True), ("badcode", "*", True)]
    got = {r.route_id: r for r in requests.parsed_requests(spark.createDataFrame(rows, "route_id string, body string, is_base64 boolean")).collect()}
    assert {k for k, r in got.items() if r.status == 200} == {"good", "warm", "coded"}
    assert [tuple(p) for p in got["good"].waypoints] == [(1.0, 2.0), (5.0, 6.0), (3.5, 4.0)] and got["good"].node_budget == 9
    assert got["warm"].warm and got["warm"].waypoints is None and len(got["coded"].waypoints) == 2
    via = spark.createDataFrame([("175.6,-39.1;175.7,-39.2",)], "via string").select(requests.via_points().alias("v")).first().v
    assert [tuple(p) for p in via] == [(175.6, -39.1), (175.7, -39.2)]


def png(rgb, kind):
    height, width, _ = rgb.shape
    raw, before = b"", np.zeros((width, 3), int)
    for row in rgb.astype(int):
        left = np.vstack([np.zeros((1, 3), int), row[:-1]])
        corner = np.vstack([np.zeros((1, 3), int), before[:-1]])
        if kind == 4:
            p = left + before - corner
            a, b, c = abs(p - left), abs(p - before), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, before, corner))
        else:
            guess = {0: 0 * row, 1: left, 2: before, 3: (left + before) // 2}[kind]
        raw += bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        before = row
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    rgb = np.random.default_rng(kind).integers(0, 256, (9, 7, 3))
    assert (dem.decode_png(png(rgb, kind)) == rgb).all()


def test_tiles_to_elevations(spark, tmp_path):
    axes = grid.grid_axes(spark.createDataFrame([("g", (-41.01, 174.0, -41.0, 174.01), 100.0)], "grid_id string, bbox struct<min_lat:double,min_lon:double,max_lat:double,max_lon:double>, cell_m double"))
    tiles = dem.tiles_of(axes).collect()
    assert tiles
    for t in tiles:
        folder = tmp_path / str(t.zoom) / str(t.tile_x)
        folder.mkdir(parents=True, exist_ok=True)
        rgb = np.zeros((256, 256, 3), int)
        rgb[..., 0], rgb[..., 1] = 1, 134
        rgb[..., 2] = np.arange(256)[:, None]
        (folder / f"{t.tile_y}.png").write_bytes(png(rgb, 2))
    pixels = dem.read_tiles(spark, str(tmp_path))
    assert pixels.count() == len(tiles) * 65536
    nodes = grid.grid_nodes(axes)
    sampled = grid.sample_elevation(nodes, pixels).collect()
    assert len(sampled) == nodes.count() and all(-16.1 < r.elev < 9.6 for r in sampled)
    south = {r.i: r.lat for r in sampled}
    assert south[0] == min(south.values())
