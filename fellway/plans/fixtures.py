"""Terrain, features, requests and places derived from the driver's tables.

The same definitions stand in the oracle's SQL, so both sides start from equal
numbers.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.geo import decode_elevation
from ..operators.grid import grid_axes
from ..operators.layers import ring_edges
from ..operators.shared import shared_dir
from ..sources.archives import write_archives
from ..sources.dem import tiles_of, write_tiles

WIDTH, CELL_M, LAT0, LON0 = 50, 25.0, -41.0, 175.0
LAT_STEP = CELL_M / C.M_PER_DEGREE
LON_STEP = CELL_M / (C.M_PER_DEGREE * math.cos(math.radians(LAT0)))
GRID = "fixture"
#: The stream corridor of the fixture: 0.6 of a cell of longitude, in degrees.
STREAM_DEG = 0.6 * LON_STEP
MIDDLE_COLUMN = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] // WIDTH + 1


def x_of(column):
    return F.lit(LON0) + column * F.lit(LON_STEP)


def y_of(row):
    return F.lit(LAT0) + row * F.lit(LAT_STEP)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j = F.expr(f"p_partkey div {WIDTH}").cast("int"), (F.col("p_partkey") % WIDTH).cast("int")
    return table(spark, sf_dir, "part").select(
        F.lit(GRID).alias("grid_id"), i.alias("i"), j.alias("j"), y_of(i).alias("lat"), x_of(j).alias("lon"), F.lit(LAT_STEP).alias("lat_step"), F.lit(LON_STEP).alias("lon_step"), (F.col("p_retailprice") + 0.5 * F.col("p_size")).alias("elev")
    )


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").agg((F.expr(f"max(p_partkey) div {WIDTH}") + 1).cast("int").alias("rows")).select(
        F.lit(GRID).alias("grid_id"), F.lit(LAT0).alias("lat0"), F.lit(LON0).alias("lon0"), F.lit(LAT_STEP).alias("lat_step"), F.lit(LON_STEP).alias("lon_step"), "rows", F.lit(WIDTH).alias("cols")
    )


def diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, r0, c0, radius): water around suppliers, away from start and goal."""
    n = rows_of(spark, sf_dir)
    k = F.col("s_suppkey")
    made = table(spark, sf_dir, "supplier").select(k.alias("gid"), ((k * 7) % n + 0.3).alias("r0"), ((k * 13) % WIDTH + 0.3).alias("c0"), (F.lit(0.6) + 0.5 * (F.col("s_nationkey") % 3)).alias("radius"))
    far = lambda r, c: F.abs(F.col("r0") - r) + F.abs(F.col("c0") - c) > F.col("radius") + 2
    return made.filter(far(0, 0) & far(n - 1, WIDTH - 1))


def water(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda dc, dr: F.struct(x_of(F.col("c0") + dc * F.col("radius")).alias("x"), y_of(F.col("r0") + dr * F.col("radius")).alias("y"))
    rings = diamonds(spark, sf_dir).select("gid", F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1)).alias("ring"))
    return ring_edges(rings)


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = rows_of(spark, sf_dir)
    x = x_of(2 * F.col("n_nationkey") + 0.5)
    return table(spark, sf_dir, "nation").filter("n_nationkey % 5 = 0").select(F.col("n_nationkey").cast("long").alias("gid"), x.alias("ax"), y_of(F.lit(0)).alias("ay"), x.alias("bx"), y_of(F.lit(n - 1)).alias("by"))


def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    reach = F.col("radius") + 0.7
    y = y_of(F.col("r0"))
    return diamonds(spark, sf_dir).filter("gid % 4 = 0").select("gid", x_of(F.col("c0") - reach).alias("ax"), y.alias("ay"), x_of(F.col("c0") + reach).alias("bx"), y.alias("by"))


def barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strip of water across the whole grid."""
    m = rows_of(spark, sf_dir) // 2
    corners = [(-1.5, m - 0.7), (WIDTH + 0.5, m - 0.7), (WIDTH + 0.5, m + 0.7), (-1.5, m + 0.7)]
    ring = F.array(*[F.struct(x_of(F.lit(c)).alias("x"), y_of(F.lit(r)).alias("y")) for c, r in corners])
    return ring_edges(spark.range(1).select(F.lit(1).cast("long").alias("gid"), ring.alias("ring")))


def barrier_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rows_of(spark, sf_dir) // 2
    x = x_of(F.lit(30.1))
    return spark.range(1).select(F.lit(1).cast("long").alias("gid"), x.alias("ax"), y_of(F.lit(m - 1.45)).alias("ay"), x.alias("bx"), y_of(F.lit(m + 1.45)).alias("by"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One route per region: even ones straight to the goal, odd ones by way of the middle; start columns differ."""
    n = rows_of(spark, sf_dir)
    point = lambda r, c: F.struct((x_of(c) + 0.2 * F.lit(LON_STEP)).alias("lon"), (y_of(r) + 0.2 * F.lit(LAT_STEP)).alias("lat"))
    k = F.col("r_regionkey")
    start, goal, middle = point(F.lit(0), k * 2), point(F.lit(n - 1), F.lit(WIDTH - 1) - k), point(F.lit(n // 2), F.lit(MIDDLE_COLUMN))
    return table(spark, sf_dir, "region").select(k.cast("string").alias("route_id"), F.when(k % 2 == 0, F.array(start, goal)).otherwise(F.array(start, middle, goal)).alias("waypoints"), F.lit(C.NODE_BUDGET).cast("long").alias("node_budget"))


def osm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["river", "stream", "canal", "drain", "primary", "motorway", "path"]))
    flag = F.col("l_returnflag")
    fclass = F.element_at(kinds, (F.col("l_linenumber") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.when(F.col("l_suppkey") % 11 != 0, fclass).alias("fclass"), F.when(flag == "R", F.lit("T")).when(flag == "N", F.lit(None)).otherwise(F.lit("F")).alias("bridge")
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places from customers; every fifth appears twice, some lack a name, a code or a kind."""
    k = F.col("c_custkey")
    kinds = F.array(*map(F.lit, ["peak", "alpine_hut", "yes", "lake", "", "unlisted"]))
    base = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("q"), (k % 40).cast("string")).alias("query"), k.alias("c_custkey"),
        F.when(k % 6 == 0, F.lit("")).when(k % 7 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("name"),
        F.when(k % 4 == 0, F.concat(F.lit("Street "), (k % 9).cast("string"))).alias("street"),
        F.when(k % 8 == 0, (k % 50).cast("string")).otherwise(F.lit("")).alias("housenumber"),
        F.when(k % 3 == 0, F.col("n_name")).otherwise(F.lit("")).alias("district"), F.when(k % 42 == 0, F.lit(None)).otherwise(F.col("n_name")).alias("city"),
        F.when(k % 5 == 0, F.col("c_mktsegment")).alias("county"), F.lit("State").alias("state"),
        F.when(k % 10 == 0, F.lit("nz")).when(k % 10 == 1, F.lit("AU")).when(k % 10 == 2, F.lit("")).alias("countrycode"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(F.element_at(kinds, (k % 6 + 1).cast("int"))).alias("osm_value"), F.when(k % 2 == 0, F.lit("natural")).alias("osm_key"),
        (F.lit(160.0) + (k % 64) * 0.375).alias("lon"), (F.lit(-55.0) + (k % 96) * 0.25).alias("lat"),
    )
    twice = base.select("*", F.explode(F.when(k % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return twice.withColumn("src_rank", k * 2 + F.col("copy"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User tracks from events, in order of time."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.lit(170.0) + (F.col("event_id") * 37 % 1000) / 1000.0).alias("lon"), (F.lit(-42.0) + (F.col("event_id") * 91 % 1000) / 1000.0).alias("lat"))


def api_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    mark = F.when(F.instr(url, "?") > 0, F.lit("&")).otherwise(F.lit("?"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(url, mark, F.lit("api=key"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, F.lit("&pipeline=terrain-rgb")).otherwise(F.lit(""))).alias("url"))


#: The raster of the fixture: rows of RASTER_WIDTH pixels at one zoom, from a corner on.
RASTER_ZOOM, RASTER_WIDTH, RASTER_CELL_M, RASTER_X, RASTER_Y = 13, 256, 20.0, 2062320, 1315800


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zoom, gx, gy, elev): a pixel per order."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.lit(RASTER_ZOOM).alias("zoom"), (F.lit(RASTER_X) + k % RASTER_WIDTH).alias("gx"), (F.lit(RASTER_Y) + F.expr(f"o_orderkey div {RASTER_WIDTH}")).alias("gy"), decode_elevation(F.lit(1), 130 + k % 20, k % 256).alias("elev")
    )


#: A box over a part of the raster, of a few tiles.
TILE_BOX = {"min_lat": -41.01, "min_lon": 174.0, "max_lat": -41.0, "max_lon": 174.03}


def raster_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zoom, gx, gy, r, g, b): the same pixels as colours."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.lit(RASTER_ZOOM).alias("zoom"), (F.lit(RASTER_X) + k % RASTER_WIDTH).alias("gx"), (F.lit(RASTER_Y) + F.expr(f"o_orderkey div {RASTER_WIDTH}")).alias("gy"), F.lit(1).alias("r"), (130 + k % 20).cast("int").alias("g"), (k % 256).cast("int").alias("b")
    )


def tile_store(spark: SparkSession, sf_dir: str) -> str:
    """Writes the raster, and what its areas need beyond it, as tiles; returns the path of their files."""
    path = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}/{{z}}/{{x}}/{{y}}.png"
    none = F.lit(None).cast("int")
    empty = tiles_of(grid_axes(raster_areas(spark, sf_dir))).select("zoom", (F.col("tile_x") * C.TILE).cast("long").alias("gx"), (F.col("tile_y") * C.TILE).cast("long").alias("gy"), none.alias("r"), none.alias("g"), none.alias("b")).distinct()
    write_tiles(raster_colours(spark, sf_dir).unionByName(empty), path).count()
    return path


def raster_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid_id, bbox, cell_m): a small box per region, side by side over the raster."""
    k = F.col("r_regionkey")
    west, south = F.lit(174.0) + k * 0.008, F.lit(-41.004) - k * 0.001
    box = F.struct(south.alias("min_lat"), west.alias("min_lon"), (south + 0.004).alias("max_lat"), (west + 0.01).alias("max_lon"))
    return table(spark, sf_dir, "region").select(k.cast("string").alias("grid_id"), box.alias("bbox"), F.lit(RASTER_CELL_M).alias("cell_m"))


#: Coarse cells of the fixture's stored layer, in degrees.
STORE_CELL = 0.003


def store_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bbox): a small area per nation, in steps along the grid's diagonal."""
    k = F.col("n_nationkey")
    south, west = F.lit(LAT0) + k * 0.001, F.lit(LON0) + k * 0.0005
    return table(spark, sf_dir, "nation").select(F.struct(south.alias("min_lat"), west.alias("min_lon"), (south + 0.0004).alias("max_lat"), (west + 0.0004).alias("max_lon")).alias("bbox"))


#: Archives that each raw layer is dealt to at least, and about how many features one holds at most, as one task writes it.
ARCHIVES, ARCHIVE_FEATURES = 4, 100_000


def raw_archives(spark: SparkSession, sf_dir: str) -> dict[str, tuple[str, str]]:
    """Writes ways, waters and oceans as shape layers in zip archives; returns what ``prepare_layers`` takes."""
    base = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    x, y = F.lit(170.0) + (k % 100) * 0.01, F.lit(-41.0) - n * 0.01
    far = F.when(F.col("l_suppkey") % 13 == 0, F.lit(0.0)).otherwise(F.lit(0.001))
    line = F.when(n % 2 == 1, F.array(point(x, y), point(x + far, y), point(x + far, y + far))).otherwise(F.array(point(x, y), point(x + far, y)))
    ways = osm_lines(spark, sf_dir)
    closed = lambda corners: F.array(F.array(*corners, corners[0]))
    corner = lambda dc, dr: point(x_of(F.col("c0") + dc * F.col("radius")), y_of(F.col("r0") + dr * F.col("radius")))
    lake = closed([corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1)])
    lakes = diamonds(spark, sf_dir).withColumn("fclass", F.lit("lake"))
    west, south = F.lit(178.05) + F.col("gid") * 0.2, F.lit(-40.0) - F.col("gid") * 0.1
    sea = closed([point(west, south), point(west + 3, south), point(west + 3, south + 1), point(west, south + 1)])
    oceans = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("gid"), F.lit("ocean").alias("fclass"))

    def dealt(df: DataFrame, key: Column) -> DataFrame:
        """Rows brought to their archives before they have shapes: a shape is much larger than what it is made from.

        A stated number of partitions, which Spark does not merge for the sake of the small rows.
        """
        n = max(ARCHIVES, math.ceil(df.count() / ARCHIVE_FEATURES))
        named = df.withColumn("archive", F.concat(F.lit("part"), F.pmod(F.xxhash64(key), F.lit(n)).cast("string")))
        return named.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "archive").sortWithinPartitions("archive")

    own = F.col("gid")
    for name, df, key, gid, parts, kind, fields in (("ways", ways, k, k * 8 + n, F.array(line), 3, ["fclass", "bridge"]), ("lakes", lakes, own, own, lake, 5, ["fclass"]), ("oceans", oceans, own, own, sea, 5, ["fclass"])):
        write_archives(dealt(df, key).withColumns({"gid": gid, "parts": parts}), f"{base}/{name}", name, kind, fields).count()
    return {"streams": (f"{base}/ways", "ways"), "bridges": (f"{base}/ways", "ways"), "water": (f"{base}/lakes", "lakes"), "ocean": (f"{base}/oceans", "oceans")}


#: Where the service's requests lie, and the edges of its waters there, in degrees east and north.
SERVICE_LON, SERVICE_LAT = 175.0, -41.0
LAKE, MOAT, ISLE, WALL = (0.018, -0.002, 0.022, 0.002), (0.052, -0.008, 0.068, 0.008), (0.057, -0.003, 0.063, 0.003), (0.104, -0.025, 0.106, 0.025)
SERVICE_BUDGET = 300


def service_water(spark: SparkSession) -> DataFrame:
    """A lake, a moat around an isle, and a wall that a small area can't get around."""
    corners = lambda b: [(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])]
    rows = []
    for gid, box in ((1, LAKE), (2, MOAT), (2, ISLE), (3, WALL)):
        points = [(SERVICE_LON + x, SERVICE_LAT + y) for x, y in corners(box)]
        rows += [(gid, *points[k], *points[(k + 1) % 4]) for k in range(4)]
    return spark.createDataFrame(rows, "gid bigint, ax double, ay double, bx double, by double")


def service_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of every zoom to the south-east of all requests, whose grids so lie level at the raster's corner."""
    k = F.col("o_orderkey")
    zoom = (F.lit(C.MIN_ZOOM) + k % (C.MAX_ZOOM - C.MIN_ZOOM + 1)).cast("int")
    n, nth = F.pow(F.lit(2.0), zoom) * C.TILE, F.expr(f"o_orderkey div {C.MAX_ZOOM - C.MIN_ZOOM + 1}")
    corner = lambda share: F.floor(n * share).cast("long")
    return table(spark, sf_dir, "orders").select(zoom.alias("zoom"), (corner(0.99) + nth % 64).alias("gx"), (corner(0.64) + F.floor(nth / 64)).alias("gy"), (F.lit(5.0) + k % 3).alias("elev"))


def service_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per supplier: eight kinds in turn, of which some are bad, warm, wet, cut off, or need a larger area."""
    k = F.col("s_suppkey")
    at = lambda x, y: f"[{SERVICE_LON + x!r},{SERVICE_LAT + y!r}]"
    body = lambda a, b, via="": F.lit(f'{{"a":{at(*a)},"b":{at(*b)}{via},"node_budget":{SERVICE_BUDGET}}}')
    near = body((0.0, 0.0), (0.01, 0.005))
    bodies = [
        near, body((0.0, 0.0), (0.01, 0.0), f',"via":[{at(0.005, 0.005)}]'), body((0.0, 0.0), (0.02, 0.0)), body((0.045, 0.0), (0.06, 0.0)),
        body((0.1, -0.01), (0.11, 0.01)), F.lit("[]"), F.lit('{"warm":true}'), F.base64(F.encode(near, "UTF-8")),
    ]
    text = F.element_at(F.array(*bodies), (k % 8 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(k.cast("string").alias("route_id"), text.alias("body"), (k % 8 == 7).alias("is_base64"))
