"""The registered queries of the routing engine: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import geo, places, text
from ..operators import cost, export, grid, layers, metrics, paths, profile, routes, search, spatial
from ..operators.shared import shared_dir
from ..sources import dem
from ..sources import requests as requests_source
from ..sources.archives import read_shape_layer, with_fields
from ..sources.layers import read_areas, read_layer, write_by_cell
from . import fixtures as X
from . import prepare, service

#: Degrees per bucket for features as small as the fixture's.
DIGITS = 9


def hours(column: str = "cost"):
    return F.round(column, DIGITS).alias(column)


def terrain_grid(s: SparkSession, d: str) -> DataFrame:
    return X.nodes(s, d).select("i", "j", F.round("lat", DIGITS).alias("lat"), F.round("lon", DIGITS).alias("lon"), "elev")


def _points(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return X.table(s, d, "customer").select(k, (F.lit(166.0) + (k % 130) / 10.0).alias("lon"), (F.lit(-47.0) + (k % 120) / 10.0).alias("lat"), (F.lit(5.0) + (k % 60) * 2.0).alias("cell_m"))


def raster_grid(s: SparkSession, d: str) -> DataFrame:
    """Axes, nodes and half-even pixel sampling from a raster."""
    nodes = grid.grid_nodes(grid.grid_axes(X.raster_areas(s, d)))
    return grid.sample_elevation(nodes, X.raster(s, d)).select("grid_id", "i", "j", F.round("lat", DIGITS).alias("lat"), F.round("lon", DIGITS).alias("lon"), F.round("elev", 1).alias("elev"))


def _tile_nodes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(axes, nodes with elevations) of the raster's areas, from tiles that are written first."""
    axes = grid.grid_axes(X.raster_areas(s, d))
    return axes, grid.sample_elevation(grid.grid_nodes(axes), dem.needed_pixels(axes, X.tile_store(s, d)))


def tile_elevation(s: SparkSession, d: str) -> DataFrame:
    """Elevations from the tiles that each grid needs."""
    _, nodes = _tile_nodes(s, d)
    return nodes.select("grid_id", "i", "j", F.round("elev", 1).alias("elev"))


def tile_source(s: SparkSession, d: str) -> DataFrame:
    """The tiles of one box, by the data source: pixels, and the range of their elevations."""
    pixels = dem.box_pixels(s, X.tile_store(s, d), X.RASTER_ZOOM, X.TILE_BOX)
    tile = [F.floor(F.col(c) / C.TILE).cast("int").alias(t) for c, t in (("gx", "tile_x"), ("gy", "tile_y"))]
    return pixels.groupBy(*tile).agg(F.count("*").alias("n"), F.round(F.min("elev"), 1).alias("low"), F.round(F.max("elev"), 1).alias("high"))


def raster_to_cost(s: SparkSession, d: str) -> DataFrame:
    """From raster tiles to the steps of every grid and their hours."""
    axes, nodes = _tile_nodes(s, d)
    return cost.step_costs(nodes, axes).select("grid_id", "i", "j", "k", hours())


def tile_index(s: SparkSession, d: str) -> DataFrame:
    points = _points(s, d).withColumn("zoom", geo.zoom_for("cell_m", "lat"))
    x, y = geo.tile_of("lon", "lat", "zoom")
    return points.select("c_custkey", "zoom", x.alias("tile_x"), y.alias("tile_y"))


def zoom_pick(s: SparkSession, d: str) -> DataFrame:
    return _points(s, d).withColumn("zoom", geo.zoom_for("cell_m", "lat")).groupBy("zoom").agg(F.count("*").alias("n"))


def rgb_decode(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return X.table(s, d, "orders").select(k, F.round(geo.decode_elevation(F.lit(1), 130 + k % 20, k % 256), 1).alias("elev"))


def great_circle(s: SparkSession, d: str) -> DataFrame:
    return _points(s, d).select("c_custkey", F.round(geo.haversine_km("lon", "lat", F.lit(174.0), F.lit(-41.0)), 6).alias("km"), F.round(geo.lon_metres("lat"), 6).alias("lon_m"), F.round(geo.walking_kmh((F.col("c_custkey") % 21 - 10) / 20.0), 9).alias("kmh"))


def directional_cost(s: SparkSession, d: str) -> DataFrame:
    return cost.terrain_steps(X.nodes(s, d)).select("i", "j", "k", "ni", "nj", hours())


def cross_slope(s: SparkSession, d: str) -> DataFrame:
    """The same costs from column functions alone, summed by direction."""
    return cost.terrain_steps_sql(X.nodes(s, d)).groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("hours"))


def water_mask(s: SparkSession, d: str) -> DataFrame:
    return cost.water_nodes(X.nodes(s, d), X.water(s, d)).select("i", "j")


def water_union(s: SparkSession, d: str) -> DataFrame:
    """Nodes covered by the union of two layers, counted once."""
    both = layers.all_water(X.water(s, d), X.barrier(s, d).withColumn("gid", F.col("gid") + 1_000_000_000))
    return cost.water_nodes(X.nodes(s, d), both).groupBy("i").agg(F.count("*").alias("wet"))


def step_crossing(s: SparkSession, d: str) -> DataFrame:
    return cost.water_steps(X.nodes(s, d), X.axes(s, d), X.water(s, d)).select("i", "j", "k")


def stream_penalty(s: SparkSession, d: str) -> DataFrame:
    nodes = X.nodes(s, d)
    return cost.step_costs(nodes, X.axes(s, d), streams=X.streams(s, d), stream_buffer_deg=X.STREAM_DEG).select("i", "j", "k", hours())


def bridge_restore(s: SparkSession, d: str) -> DataFrame:
    return _full_steps(s, d).select("i", "j", "k", hours())


def _full_steps(s: SparkSession, d: str, of=cost.step_costs) -> DataFrame:
    return of(X.nodes(s, d), X.axes(s, d), X.water(s, d), X.streams(s, d), X.bridges(s, d), X.STREAM_DEG)


def spatial_prefilter(s: SparkSession, d: str) -> DataFrame:
    points = X.nodes(s, d).select("i", "j", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.near_boxes(points, X.water(s, d), 2 * X.LON_STEP).groupBy("gid").agg(F.count("*").alias("n"))


def _snapped(s: SparkSession, d: str) -> DataFrame:
    points = routes.waypoint_rows(X.requests(s, d)).withColumn("grid_id", F.lit(X.GRID))
    return routes.snapped(points, X.axes(s, d))


def nearest_snap(s: SparkSession, d: str) -> DataFrame:
    return _snapped(s, d).select("route_id", "pos", "i", "j")


def waypoints_in_water(s: SparkSession, d: str) -> DataFrame:
    """Routes over diamond centres: the first waypoint in water is named."""
    k = F.col("s_suppkey")
    n = X.rows_of(s, d)
    point = lambda r, c: F.struct(X.x_of(c).alias("lon"), X.y_of(r).alias("lat"))
    made = X.table(s, d, "supplier").select(k.cast("string").alias("route_id"), F.array(point(F.lit(0.0), F.lit(0.0)), point((k * 7) % n + 0.5, (k * 13) % X.WIDTH + 0.4), point((k * 3) % n + 0.5, (k * 5) % X.WIDTH + 0.4)).alias("waypoints"))
    return routes.blocked_waypoints(routes.waypoint_rows(made), X.water(s, d))


def _corner_leg(s: SparkSession, d: str) -> DataFrame:
    n = X.rows_of(s, d)
    return s.range(1).select(F.lit(X.GRID).alias("grid_id"), F.lit("corner").alias("route_id"), F.lit(1).alias("leg"), F.lit(0).alias("si"), F.lit(0).alias("sj"), F.lit(n - 1).alias("gi"), F.lit(X.WIDTH - 1).alias("gj"))


def _corner_hours(costs: DataFrame, s: SparkSession, d: str) -> DataFrame:
    return paths.leg_paths(costs, _corner_leg(s, d)).groupBy("route_id").agg(F.round(F.max("g"), DIGITS).alias("hours"))


def sssp_terrain(s: SparkSession, d: str) -> DataFrame:
    return _corner_hours(cost.cost_blocks(X.nodes(s, d)), s, d)


def sssp_full(s: SparkSession, d: str) -> DataFrame:
    return _corner_hours(_full_steps(s, d, cost.cost_blocks), s, d)


def sssp_barrier(s: SparkSession, d: str) -> DataFrame:
    """Unreachable but for one bridge."""
    return _corner_hours(cost.cost_blocks(X.nodes(s, d), X.axes(s, d), water=X.barrier(s, d), bridges=X.barrier_bridge(s, d)), s, d)


def sssp_blocks(s: SparkSession, d: str) -> DataFrame:
    """Distances from the corner to every node, square by square."""
    source = s.range(1).select(F.lit(X.GRID).alias("grid_id"), F.lit("corner").alias("route_id"), F.lit(1).alias("leg"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    return paths.distances(cost.cost_blocks(X.nodes(s, d)), source).select("i", "j", F.round("g", DIGITS).alias("hours"))


def _routed(s: SparkSession, d: str):
    legs = routes.legs_of(_snapped(s, d))
    points, statistics = routes.find_routes(X.nodes(s, d), _full_steps(s, d, cost.cost_blocks), legs)
    return legs, points, statistics


def multi_leg_summary(s: SparkSession, d: str) -> DataFrame:
    """Hours of every leg (least cost, so equal paths don't matter)."""
    _, _, statistics = _routed(s, d)
    return statistics.select("route_id", "leg", F.round("estimated_hours", DIGITS).alias("estimated_hours"))


def route_summary(s: SparkSession, d: str) -> DataFrame:
    legs, _, statistics = _routed(s, d)
    wet = cost.water_nodes(X.nodes(s, d), X.water(s, d))
    n = legs.groupBy("route_id").agg((F.max("leg") + 1).alias("n"))
    found = routes.route_results(legs, wet, statistics).join(n, "route_id")
    return found.select("route_id", "ok", text.friendly_error("error", "n").alias("error"), F.round("distance_km", 6).alias("distance_km"), F.round("estimated_hours", DIGITS).alias("estimated_hours"), F.round("climb_m", 4).alias("climb_m"), "n_points")


def route_profile(s: SparkSession, d: str) -> DataFrame:
    _, points, _ = _routed(s, d)
    return points.select("route_id", "leg", "seq", "i", "j", F.round("elev", 4).alias("elev"), F.round("g", DIGITS).alias("hours"))


def geojson_route(s: SparkSession, d: str) -> DataFrame:
    _, points, _ = _routed(s, d)
    short = points.withColumns({"lon": F.round("lon", 7), "lat": F.round("lat", 7), "elev": F.round("elev", 1)})
    return export.geojson(short, ["route_id"]).select("route_id", F.to_json("route").alias("feature"), F.to_json("elevations_m").alias("elevations"))


def gpx_export(s: SparkSession, d: str) -> DataFrame:
    _, points, _ = _routed(s, d)
    return export.gpx(points, ["route_id"], F.concat(F.lit("Route "), F.col("route_id")))


def service_answers(s: SparkSession, d: str) -> DataFrame:
    """Requests answered end to end: bad, warm, wet, cut off, routed at once or over a larger area."""
    found = service.answers(X.service_events(s, d), X.service_raster(s, d), X.service_water(s), max_seconds=float("inf"), block=cost.SIDE)
    said = F.from_json("body", "ok boolean, error string, warm boolean, padding_frac_used double, n_points bigint, elevations_m array<double>, gpx string")
    b = F.col("b")
    whole = (F.size(b["elevations_m"]) == b["n_points"]) & b["gpx"].startswith("<?xml") & (b["n_points"] > 1)
    return found.select("route_id", "status", said.alias("b")).select("route_id", "status", b["ok"].alias("ok"), b["warm"].alias("warm"), b["error"].alias("error"), b["padding_frac_used"].alias("padding"), whole.alias("whole"))


def warm_up_route(s: SparkSession, d: str) -> DataFrame:
    """The warm-up's path, for every warm request."""
    warm = requests_source.parsed_requests(X.service_events(s, d)).filter("warm").select(F.col("route_id").alias("request"))
    path = service.warm_up(s).select(F.lit(True).alias("warm"), "seq", "i", "j", F.round("g", 12).alias("hours"))
    return warm.withColumn("warm", F.lit(True)).join(path, "warm").drop("warm")


def connectivity(s: SparkSession, d: str) -> DataFrame:
    nodes = X.nodes(s, d)
    wet = cost.water_nodes(nodes, layers.all_water(X.water(s, d), X.barrier(s, d).withColumn("gid", F.col("gid") + 1_000_000_000)))
    return paths.walkable_components(nodes, wet, block=16).groupBy("component").agg(F.count("*").alias("n"))


def bbox_dynamic(s: SparkSession, d: str) -> DataFrame:
    box = geo.padded_bbox("waypoints", C.PADDING)
    return X.requests(s, d).select("route_id", box.alias("b")).select("route_id", *[F.round(f"b.{c}", DIGITS).alias(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")])


def cell_budget(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    box = F.struct(*[v.alias(n) for n, v in (("min_lat", F.lit(-41.0) - k % 7 / 10.0), ("min_lon", F.lit(174.0)), ("max_lat", F.lit(-41.0)), ("max_lon", F.lit(174.0) + k % 11 / 3.0))])
    return X.table(s, d, "orders").select(k, F.round(geo.cell_size_m(box, 1000 * (1 + k % 2000)), 6).alias("cell_m"))


def cumulative_distance(s: SparkSession, d: str) -> DataFrame:
    along = profile.cumulative_distance(X.tracks(s, d), ["user_id"], "event_id")
    return along.select("user_id", "event_id", F.round("along_m", 3).alias("along_m"))


def interpolate_along(s: SparkSession, d: str) -> DataFrame:
    found = profile.positions_at(X.tracks(s, d), ["user_id"], [0.0, 0.25, 0.5, 1.0], "event_id")
    return found.select("user_id", "share", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


def track_bounds(s: SparkSession, d: str) -> DataFrame:
    return profile.track_bounds(X.tracks(s, d), ["user_id"])


def etl_stream_filter(s: SparkSession, d: str) -> DataFrame:
    return layers.stream_lines(X.osm_lines(s, d)).groupBy("fclass").agg(F.count("*").alias("n"))


def etl_bridge_filter(s: SparkSession, d: str) -> DataFrame:
    return layers.bridge_lines(X.osm_lines(s, d)).select("l_orderkey", "l_linenumber", "fclass")


def etl_layer_counts(s: SparkSession, d: str) -> DataFrame:
    return layers.layer_counts(X.osm_lines(s, d))


def _multiparts(s: SparkSession, d: str) -> DataFrame:
    """A collection per part row: p_size mod 4 lines of two vertices each, and a polygon."""
    k = F.col("p_partkey")
    line = lambda n: F.struct(F.when(n == 3, F.lit("polygon")).otherwise(F.lit("line")).alias("kind"), F.transform(F.sequence(F.lit(1), F.col("p_size") % 4), lambda v: F.struct((k + n * 10 + v).cast("double").alias("x"), (k - v).cast("double").alias("y"))).alias("points"))
    made = X.table(s, d, "part").withColumn("parts", F.transform(F.sequence(F.lit(1), F.lit(3)), line))
    return made.filter("p_size % 4 > 0").select(k.alias("gid"), "parts")


def etl_multipart_explode(s: SparkSession, d: str) -> DataFrame:
    split = layers.split_parts(_multiparts(s, d), kinds=("line",))
    lines = split.filter(layers.usable_line("geometry.points")).select("gid", "part", F.col("geometry.points").alias("points"))
    return cost.line_segments(layers.line_vertices(lines)).select("gid", "part", "seq", "ax", "ay", "bx", "by")


BOX = {"min_lon": X.LON0, "max_lon": X.LON0 + 30 * X.LON_STEP, "min_lat": X.LAT0, "max_lat": X.LAT0 + 20 * X.LAT_STEP}


def ocean_bbox_clip(s: SparkSession, d: str) -> DataFrame:
    """Water that meets a box, cut to it: its area in cells."""
    edges = X.water(s, d)
    near = layers.in_box(spatial.boxes(edges), BOX).select("gid")
    rings = edges.join(near, "gid", "left_semi").groupBy("gid").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("ax").alias("x"), F.col("ay").alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    cut = layers.ring_edges(layers.clip_rings(rings, BOX))
    area = F.abs(F.sum((F.col("ax") - X.LON0) * (F.col("by") - X.LAT0) - (F.col("bx") - X.LON0) * (F.col("ay") - X.LAT0))) / 2.0 / (X.LON_STEP * X.LAT_STEP)
    return cut.groupBy("gid").agg(F.round(area, 6).alias("cells"))


def prepare_job(s: SparkSession, d: str) -> DataFrame:
    """From raw archives to the engine's layers: what each scanned and wrote, and the sum of its coordinates."""
    out = f"{shared_dir(s)}/layers-{uuid.uuid4().hex}"
    counts = prepare.prepare_layers(s, X.raw_archives(s, d), out)
    rows = [(name, n["scanned"], n["written"]) for name, n in sorted(counts.items())]
    tables = None
    for name, _, _ in rows:
        own = read_layer(s, out, name).agg(F.round(F.sum(F.col("ax") + F.col("by")), 3).alias("total")).select(F.lit(name).alias("layer"), "total")
        tables = own if tables is None else tables.unionByName(own)
    return s.createDataFrame(rows, "layer string, scanned bigint, written bigint").join(tables, "layer")


def shape_layer(s: SparkSession, d: str) -> DataFrame:
    """A shape layer read in parts by the records of its index: its fields, and the vertices of its lines."""
    path, layer = X.raw_archives(s, d)["streams"]
    features = with_fields(read_shape_layer(s, path, layer, part_records=1000), "fclass", "bridge")
    return features.groupBy("fclass", "bridge").agg(F.count("*").alias("n"), F.sum(F.size(F.col("parts")[0]["points"])).alias("vertices"), F.round(F.min("min_x"), 6).alias("west"), F.round(F.max("max_y"), 6).alias("north"))


def line_bbox_clip(s: SparkSession, d: str) -> DataFrame:
    cut = layers.clip_segments(X.bridges(s, d), BOX)
    return cut.select("gid", *[F.round(c, DIGITS).alias(c) for c in ("ax", "ay", "bx", "by")])


def place_dedupe_topk(s: SparkSession, d: str) -> DataFrame:
    return search.search_results(X.places(s, d)).select("query", "c_custkey", "label", "place_key")


def place_labels(s: SparkSession, d: str) -> DataFrame:
    return search.with_labels(X.places(s, d).filter("copy = 0")).select("c_custkey", "label", "detail", "kind_label")


def kind_zoom(s: SparkSession, d: str) -> DataFrame:
    return search.with_labels(X.places(s, d).filter("copy = 0")).groupBy("zoom").agg(F.count("*").alias("n"))


def redact_keys(s: SparkSession, d: str) -> DataFrame:
    return X.api_urls(s, d).select("page_id", text.redact_keys("url").alias("redacted"))


def proxy_path(s: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("/stage/proxy/"), F.regexp_replace("url", "^https?://", ""), F.lit("/a b%20c+d/é"))
    return X.table(s, d, "pages").select("page_id", text.proxy_path(raw).alias("path"))


def tile_url_rewrite(s: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    url = F.when(k % 3 == 0, F.lit("https://other.example/x.png")).otherwise(F.concat(F.lit("https://tiles.example/v1/tiles/"), k.cast("string"), F.lit(".png&pipeline=rgb&api=secret"), k.cast("string")))
    return X.table(s, d, "pages").select("page_id", text.rewrite_tile_url(url, "https://tiles.example", "https://own.example").alias("url"))


def key_stripping(s: SparkSession, d: str) -> DataFrame:
    return X.api_urls(s, d).select("page_id", text.strip_key("url", F.concat(F.lit("key"), F.col("page_id").cast("string"))).alias("url"))


def waypoint_roles(s: SparkSession, d: str) -> DataFrame:
    points = routes.waypoint_rows(X.requests(s, d))
    return points.select("route_id", "pos", text.role("pos", "n").alias("role"), text.short_label("pos", "n").alias("label"), text.waypoint_label("pos", "n").alias("name"), text.coordinates("lon", "lat").alias("shown"))


def friendly_errors(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    message = F.when(k % 3 == 0, F.lit("No path found between those two points.")).otherwise(F.concat(F.lit("Leg "), (k % 4 + 1).cast("string"), F.lit(" ((175.0, -41.0) -> (175.1, -41.2)) failed: reason "), k.cast("string")))
    return X.table(s, d, "customer").select("c_custkey", text.friendly_error(message, F.lit(5)).alias("message"))


def durations(s: SparkSession, d: str) -> DataFrame:
    return X.table(s, d, "orders").select("o_orderkey", text.duration(F.col("o_orderkey") / 64.0).alias("shown"))


def route_display(s: SparkSession, d: str) -> DataFrame:
    """Distance, climb, place and drop rank as they are shown."""
    k = F.col("o_orderkey")
    middles = F.transform(F.sequence(F.lit(1), (2 + k % 4).cast("int")), lambda n: n * 40.0)
    return X.table(s, d, "orders").select(
        k, text.distance_text(k / 64.0).alias("distance"), text.climb_text(k / 8.0).alias("climb"), text.point_text(F.lit(-41.0) - k / 1024.0, F.lit(174.0) + k / 2048.0).alias("place"), text.drop_rank(middles, k % 300, F.lit(4) + k % 4).cast("int").alias("rank")
    )


def request_parse(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    good = F.format_string('{"a":[174.5,-41.25],"b":[%s.5,-40.5],"via":[[175.0,-41.0]],"node_budget":%d}', (170 + k % 5).cast("string"), k)
    body = F.when(k % 6 == 1, F.lit('{"a":[1,2]}')).when(k % 6 == 2, F.lit("[1]")).when(k % 6 == 3, F.lit('{"warm":true}')).when(k % 6 == 4, F.lit('{"a":[1],"b":[1,2]}')).when(k % 6 == 5, F.base64(F.encode(good, "UTF-8"))).otherwise(good)
    parsed = requests_source.parsed_requests(X.table(s, d, "customer").select(k.cast("string").alias("route_id"), body.alias("body"), (k % 6 == 5).alias("is_base64")))
    return parsed.select("route_id", "warm", "status", "node_budget", F.size("waypoints").alias("n_waypoints"), F.element_at("waypoints", -1)["lon"].alias("last_lon"))


def area_layer(s: SparkSession, d: str) -> DataFrame:
    """A stored layer read for the areas of some requests: the features whose box touches their coarse cells."""
    path = f"{shared_dir(s)}/store-{uuid.uuid4().hex}"
    write_by_cell(X.water(s, d), path, "water", X.STORE_CELL)
    near = read_areas(read_layer(s, path, "water"), X.store_areas(s, d), X.STORE_CELL)
    return near.groupBy("gid").agg(F.count("*").alias("n"), F.round(F.sum(F.col("ax") + F.col("by")), 6).alias("total"))


def query_keys(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    typed = F.concat(F.repeat(F.lit(" "), (k % 3).cast("int")), F.when(k % 2 == 0, F.upper("c_name")).otherwise(F.initcap("c_name")), F.lit("  "))
    return X.table(s, d, "customer").select("c_custkey", typed.alias("query")).select("c_custkey", places.query_key().alias("key"))


def http_requests(s: SparkSession, d: str) -> DataFrame:
    """Header names in lower case, the allowed origin, and the method of either event version."""
    k = F.col("o_orderkey")
    origin = F.concat(F.lit("https://site"), (k % 4).cast("string"), F.lit(".example"))
    headers = F.create_map(F.lit("Origin"), origin, F.lit("X-Order"), k.cast("string"))
    events = X.table(s, d, "orders").select(k, headers.alias("h"), F.when(k % 3 == 0, F.lit("POST")).when(k % 3 == 1, F.lit("")).alias("method_v2"), F.when(k % 5 == 0, F.lit("OPTIONS")).alias("method_v1"))
    low = events.withColumn("h", text.lower_keys("h"))
    allowed = ["https://site1.example", "https://site2.example"]
    return low.select("o_orderkey", F.col("h")["x-order"].alias("x_order"), text.allowed_origin(F.col("h")["origin"], allowed).alias("origin"), requests_source.method().alias("method"))


def cli_waypoints(s: SparkSession, d: str) -> DataFrame:
    """Waypoints of command-line text: the start, the vias, the end."""
    k = F.col("c_custkey")
    via = F.array_join(F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.lit(" "), (n * 0.5 + 170).cast("string"), F.lit(", -4"), n.cast("string"), F.lit(".25 ")))), ";")
    end = lambda x: F.struct(F.lit(x).alias("lon"), F.lit(-41.0).alias("lat"))
    made = X.table(s, d, "customer").select(k, via.alias("text")).withColumns({"a": end(174.0), "b": end(175.0), "via": requests_source.via_points("text")})
    points = made.select("c_custkey", routes.all_waypoints().alias("w"))
    return points.select("c_custkey", F.size("w").alias("n"), F.array_join(F.transform("w", lambda p: F.concat(p["lon"].cast("string"), F.lit(" "), p["lat"].cast("string"))), ";").alias("points"))


def response_bodies(s: SparkSession, d: str) -> DataFrame:
    """Results as responses: status, and a body whose error shows no key."""
    k = F.col("p_partkey")
    ok = k % 3 > 0
    error = F.when(~ok, F.concat(F.lit("no tile https://t.example/x.png?api=key"), k.cast("string"), F.lit("&z=1")))
    return export.responses(X.table(s, d, "part").select(k.cast("string").alias("route_id"), ok.alias("ok"), error.alias("error"), F.when(ok, k).alias("n_points")))


def gpx_files(s: SparkSession, d: str) -> DataFrame:
    """Tracks written as GPX text and read back: tracks, points, and the last track's name."""
    path = f"{shared_dir(s)}/gpx-{uuid.uuid4().hex}"
    points = X.tracks(s, d).select("user_id", F.lit(1).alias("leg"), F.col("event_id").alias("seq"), "lon", "lat", (F.col("event_id") % 100).alias("elev"))
    export.write_gpx(export.gpx(points, ["user_id"], F.concat(F.lit("Track "), F.col("user_id").cast("string"))), path)
    line = F.trim("value")
    return s.read.text(path).agg(F.count_if(line == "<trk>").alias("tracks"), F.count_if(line.startswith("<trkpt ")).alias("points"), F.max(F.when(line.startswith("<name>"), line)).alias("last"))


def route_points_sql(s: SparkSession, d: str) -> DataFrame:
    """The table function in SQL: the distance and climb so far of every point of every track."""
    points = X.tracks(s, d).select(F.col("user_id").cast("string").alias("route_id"), F.col("event_id").alias("seq"), "lon", "lat", (F.col("event_id") % 100).cast("double").alias("elev"))
    profile.register_route_points(s)
    points.createOrReplaceTempView("fellway_track_points")
    found = s.sql("SELECT * FROM route_points(TABLE(fellway_track_points) PARTITION BY route_id ORDER BY seq)")
    return found.select("route_id", "seq", F.round("along_km", 6).alias("along_km"), F.round("climb_m", 6).alias("climb_m"))


def grid_counts(s: SparkSession, d: str) -> DataFrame:
    """What the grid job observes while it runs: nodes, wet and stream nodes, and nodes reached from the corner."""
    nodes, wet = X.nodes(s, d), cost.water_nodes(X.nodes(s, d), X.water(s, d))
    zone = spatial.within_distance(nodes.select("i", "j", F.col("lon").alias("x"), F.col("lat").alias("y")), X.streams(s, d), X.STREAM_DEG, ["i", "j"])
    source = s.range(1).select(F.lit(X.GRID).alias("grid_id"), F.lit("corner").alias("route_id"), F.lit(1).alias("leg"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    reached = paths.distances(_full_steps(s, d, cost.cost_blocks), source)
    counts = metrics.observed_counts({"nodes": nodes, "wet": wet, "streams": zone, "reached": reached})
    return s.createDataFrame(sorted(counts.items()), "what string, n bigint")


def debounce_sessions(s: SparkSession, d: str) -> DataFrame:
    keys = X.table(s, d, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return search.debounced(keys, gap_ms=3_600_000).groupBy("session").agg(F.count("*").alias("n"))


def latest_wins(s: SparkSession, d: str) -> DataFrame:
    return X.table(s, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def waypoint_edits(s: SparkSession, d: str) -> DataFrame:
    """Insert before the end, drop the second, move the first via to the front of the vias."""
    k = F.col("c_custkey")
    w = F.transform(F.sequence(F.lit(0), (3 + k % 4).cast("int")), lambda p: k * 10 + p)
    n = F.size("w")
    return X.table(s, d, "customer").select(k, w.alias("w")).select(
        "c_custkey", F.array_join(F.array_insert("w", n, F.lit(-1).cast("bigint")), ",").alias("added"), F.array_join(F.filter("w", lambda v, p: p != 1), ",").alias("removed"),
        F.array_join(F.concat(F.slice("w", 1, 1), F.slice("w", 3, 1), F.slice("w", 2, 1), F.slice("w", 4, n)), ",").alias("moved"), F.array_join(F.slice("w", 2, n - 2), ",").alias("vias"), (n >= C.MAX_WAYPOINTS).alias("full"), (n >= 3).alias("ready"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        terrain_grid, raster_grid, tile_elevation, tile_source, raster_to_cost, route_display, tile_index, zoom_pick, rgb_decode, great_circle, directional_cost, cross_slope, water_mask, water_union, step_crossing, stream_penalty, bridge_restore, spatial_prefilter,
        nearest_snap, waypoints_in_water, sssp_terrain, sssp_full, sssp_barrier, sssp_blocks, multi_leg_summary, route_summary, route_profile, geojson_route, gpx_export, service_answers, warm_up_route, connectivity, bbox_dynamic,
        cell_budget, cumulative_distance, interpolate_along, track_bounds, etl_stream_filter, etl_bridge_filter, etl_layer_counts, etl_multipart_explode, ocean_bbox_clip, line_bbox_clip, prepare_job, shape_layer,
        place_dedupe_topk, place_labels, kind_zoom, redact_keys, proxy_path, tile_url_rewrite, key_stripping, waypoint_roles, friendly_errors, durations, request_parse, area_layer, query_keys, http_requests, cli_waypoints, response_bodies, gpx_files, route_points_sql, grid_counts, debounce_sessions, latest_wins, waypoint_edits,
    )
}
