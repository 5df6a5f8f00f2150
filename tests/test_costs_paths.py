"""Costs and paths: forms agree, properties hold, hand-made cases."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fellway import config as C
from fellway.operators import cost, paths, spatial
from fellway.plans import fixtures as X

SF = "/root/testdata/sf0.001"


def grid(spark, elev, lat0=-41.0, step=0.0001):
    rows = [("g", i, j, lat0 + i * step, 174.0 + j * step, step, step, float(e)) for i, line in enumerate(elev) for j, e in enumerate(line)]
    nodes = spark.createDataFrame(rows, "grid_id string, i int, j int, lat double, lon double, lat_step double, lon_step double, elev double")
    axes = spark.createDataFrame([("g", lat0, 174.0, step, step, len(elev), len(elev[0]))], "grid_id string, lat0 double, lon0 double, lat_step double, lon_step double, rows int, cols int")
    return nodes, axes


def test_flat_smoke_route(spark):
    nodes, _ = grid(spark, [[0.0] * 3] * 3)
    legs = spark.createDataFrame([("g", "r", 1, 0, 0, 2, 2), ("g", "same", 1, 1, 1, 1, 1), ("g", "off", 1, 0, 0, 9, 9)], "grid_id string, route_id string, leg int, si int, sj int, gi int, gj int")
    got = paths.leg_paths(cost.terrain_steps(nodes), legs).collect()
    route = sorted((r for r in got if r.route_id == "r"), key=lambda r: r.seq)
    assert [(r.i, r.j) for r in route] == [(0, 0), (1, 1), (2, 2)]
    assert [(r.i, r.j, r.g) for r in got if r.route_id == "same"] == [(1, 1, 0.0)]
    assert not [r for r in got if r.route_id == "off"]
    flat = 6 * math.exp(-0.2)
    lon_m = [0.0001 * C.M_PER_DEGREE * math.cos(math.radians(-41.0 + k * 0.0001)) for k in (0, 1)]
    expected = sum(math.hypot(0.0001 * C.M_PER_DEGREE, m) / 1000 / flat for m in lon_m)
    assert abs(route[-1].g - expected) < 1e-12


def test_stencil_forms_agree(spark):
    rng = random.Random(4)
    nodes, _ = grid(spark, [[rng.uniform(0, 3) for _ in range(11)] for _ in range(9)])
    key = lambda df: {(r.i, r.j, r.k): (r.ni, r.nj, round(r.cost, 12)) for r in df.collect()}
    a, b, c = key(cost.terrain_steps(nodes)), key(cost.terrain_steps(nodes, block=4)), key(cost.terrain_steps_sql(nodes))
    assert a == b == c and len(a) > 1000
    assert all(v[2] > 0 for v in a.values())


def test_a_hole_in_the_grid(spark):
    nodes, _ = grid(spark, [[0.0] * 4] * 4)
    steps = cost.terrain_steps(nodes.filter("NOT (i = 1 AND j = 1)")).collect()
    assert all((r.i, r.j) != (1, 1) and (r.ni, r.nj) != (1, 1) for r in steps)


def ring(spark, gid, points):
    n = len(points)
    return spark.createDataFrame([(gid, *points[k], *points[(k + 1) % n]) for k in range(n)], "gid bigint, ax double, ay double, bx double, by double")


def test_containment_with_hole_and_union(spark):
    outer = ring(spark, 1, [(0.0, 0.0), (0.05, 0.0), (0.05, 0.05), (0.0, 0.05)])
    hole = ring(spark, 1, [(0.02, 0.02), (0.03, 0.02), (0.03, 0.03), (0.02, 0.03)])
    other = ring(spark, 2, [(0.024, 0.024), (0.06, 0.024), (0.06, 0.026), (0.024, 0.026)])
    points = spark.createDataFrame([("in", 0.01, 0.011), ("hole", 0.021, 0.025), ("both", 0.041, 0.0251), ("island", 0.0251, 0.0252), ("out", 0.07, 0.01)], "name string, x double, y double")
    got = {r.name for r in spatial.contained(points, outer.union(hole).union(other), ["name"]).collect()}
    assert got == {"in", "both", "island"}


def test_containment_against_brute_force(spark):
    rng = random.Random(7)
    rings = []
    for gid in range(6):
        cx, cy = rng.uniform(0, 0.1), rng.uniform(0, 0.1)
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(7))
        rings.append((gid, [(cx + 0.03 * math.cos(a), cy + 0.03 * math.sin(a)) for a in angles]))
    edges = [(gid, *p[k], *p[(k + 1) % len(p)]) for gid, p in rings for k in range(len(p))]
    points = [(n, rng.uniform(-0.05, 0.15), rng.uniform(-0.05, 0.15)) for n in range(400)]

    def inside(x, y, gid):
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for g, ax, ay, bx, by in edges if g == gid) % 2

    frame = spark.createDataFrame(points, "n int, x double, y double")
    got = {r.n for r in spatial.contained(frame, spark.createDataFrame(edges, "gid bigint, ax double, ay double, bx double, by double"), ["n"]).collect()}
    assert got == {n for n, x, y in points if any(inside(x, y, g) for g, _ in rings)}


@pytest.fixture(scope="module")
def strip(spark):
    """A flat 9 x 9 grid with a strip of water across row 4."""
    nodes, axes = grid(spark, [[0.0] * 9] * 9)
    y = lambda r: -41.0 + r * 0.0001
    water = ring(spark, 1, [(173.999, y(3.3)), (174.002, y(3.3)), (174.002, y(4.7)), (173.999, y(4.7))])
    return nodes, axes, water


def test_water_blocks_until_a_bridge(spark, strip):
    nodes, axes, water = strip
    legs = spark.createDataFrame([("g", "r", 1, 0, 4, 8, 4)], "grid_id string, route_id string, leg int, si int, sj int, gi int, gj int")
    dry = cost.step_costs(nodes, axes, water=water)
    assert paths.leg_paths(dry, legs).count() == 0
    x, y = 174.0 + 4.1 * 0.0001, lambda r: -41.0 + r * 0.0001
    bridge = spark.createDataFrame([(5, x, y(2.5), x, y(5.5)), (6, x, y(1), x, y(1))], "gid bigint, ax double, ay double, bx double, by double")
    crossed = cost.step_costs(nodes, axes, water=water, bridges=bridge)
    assert paths.leg_paths(crossed, legs).count() > 0
    beside = {(r.i, r.j, r.k): r.cost for r in crossed.collect()}
    plain = {(r.i, r.j, r.k): r.cost for r in cost.terrain_steps(nodes).collect()}
    wet = {(r.i, r.j, r.k) for r in cost.water_steps(nodes, axes, water).collect()}
    for key, value in beside.items():
        assert plain[key] - 1e-15 <= value <= plain[key] * 1.4 + 1e-15
        if key in wet:
            assert key in {k for k in beside if beside[k] >= plain[k]}
    assert not wet <= set(beside)


def test_streams_then_bridges(spark):
    nodes, axes = grid(spark, [[0.0] * 9] * 9)
    x, y = 174.0 + 4.5 * 0.0001, lambda r: -41.0 + r * 0.0001
    stream = spark.createDataFrame([(x, y(-2), x, y(11))], "ax double, ay double, bx double, by double")
    buffer_deg = 0.00006
    plain = {(r.i, r.j, r.k): r.cost for r in cost.terrain_steps(nodes).collect()}
    priced = {(r.i, r.j, r.k): r.cost for r in cost.step_costs(nodes, axes, streams=stream, stream_buffer_deg=buffer_deg).collect()}
    ratio = {k: round(priced[k] / plain[k], 9) for k in plain}
    assert set(ratio.values()) == {1.0, 1.5}
    east = C.DIRECTIONS.index((0, 1))
    assert ratio[4, 4, east] == 1.5 and ratio[4, 0, east] == 1.0
    bridge = spark.createDataFrame([(1, 174.0 + 3 * 0.0001, y(4), 174.0 + 6 * 0.0001, y(4))], "gid bigint, ax double, ay double, bx double, by double")
    crossed = {(r.i, r.j, r.k): r.cost for r in cost.step_costs(nodes, axes, streams=stream, bridges=bridge, stream_buffer_deg=buffer_deg).collect()}
    assert round(crossed[4, 4, east] / plain[4, 4, east], 9) == 1.0


def test_search_forms_agree(spark):
    rng = random.Random(11)
    nodes, _ = grid(spark, [[rng.uniform(0, 3) for _ in range(12)] for _ in range(14)])
    steps = cost.terrain_steps(nodes).filter("NOT (i BETWEEN 5 AND 7 AND j < 9) AND NOT (ni BETWEEN 5 AND 7 AND nj < 9)")
    source = spark.createDataFrame([("g", 0, 0)], "grid_id string, i int, j int")
    value = lambda df: {(r.i, r.j): round(r.g, 12) for r in df.collect()}
    relaxed = value(paths.relaxed_distances(steps, source))
    legs_of = source.selectExpr("grid_id", "'r' AS route_id", "1 AS leg", "i", "j")
    assert value(paths.block_distances(steps, legs_of, block=4)) == relaxed
    for side in (1, 4, 5, 20):
        assert value(paths.distances(steps, legs_of, side)) == relaxed
    goals = [("g", str(k), 1, 0, 0, i, j) for k, (i, j) in enumerate(sorted(relaxed)[::17])]
    legs = spark.createDataFrame(goals, "grid_id string, route_id string, leg int, si int, sj int, gi int, gj int")
    found = paths.leg_paths(steps, legs).collect()
    # Squares of any size, and rounds over blocks where no grid may have an overlay.
    for size in (1, 3, 4, 7):
        assert sorted(paths.leg_paths(steps, legs, side=size).collect()) == sorted(found)
    for size in (4, 64):
        assert sorted(paths.leg_paths(steps, legs, most_squares=0, block=size).collect()) == sorted(found)
    edge = {(r.i, r.j, r.ni, r.nj): r.cost for r in steps.collect()}
    for _, route, _, _, _, i, j in goals:
        own = sorted((r for r in found if r.route_id == route), key=lambda r: r.seq)
        assert (own[0].i, own[0].j) == (0, 0) and (own[-1].i, own[-1].j) == (i, j)
        assert abs(sum(edge[a.i, a.j, b.i, b.j] for a, b in zip(own, own[1:])) - relaxed[i, j]) < 1e-12


def test_equally_cheap_paths_are_the_same_in_both_forms(spark):
    flat, _ = grid(spark, [[0.0] * 11] * 9)
    steps = cost.terrain_steps(flat).withColumn("cost", F.lit(1.0))
    legs = spark.createDataFrame([("g", str(k), 1, 0, 0, 8, k) for k in range(11)] + [("g", "same", 1, 3, 3, 3, 3)], "grid_id string, route_id string, leg int, si int, sj int, gi int, gj int")
    whole = sorted(paths.leg_paths(steps, legs).collect())
    assert sorted(paths.leg_paths(steps, legs, most_squares=0, block=4).collect()) == whole
    for side in (2, 5):
        assert sorted(paths.leg_paths(steps, legs, side=side).collect()) == whole
    assert [(r.i, r.j) for r in whole if r.route_id == "same"] == [(3, 3)]


def test_components(spark):
    picture = ["..#....", "..#.##.", "###.#..", "....#.#", ".####.#", ".......", "#######", "......."]
    nodes, _ = grid(spark, [[0.0] * 7] * 8)
    wet = spark.createDataFrame([("g", i, j) for i, line in enumerate(picture) for j, c in enumerate(line) if c == "#"], "grid_id string, i int, j int")
    got = {(r.i, r.j): r.component for r in paths.walkable_components(nodes, wet, block=3).collect()}
    assert len(got) == sum(line.count(".") for line in picture)
    assert len(set(got.values())) == 3
    assert {got[0, 0], got[1, 1]} == {"0,0"} and {got[0, 3], got[5, 6], got[3, 0]} == {"0,3"} and got[7, 6] == "7,0"


def test_known_fixture_hours(spark):
    steps = cost.terrain_steps(X.nodes(spark, SF))
    leg = spark.createDataFrame([(X.GRID, "r", 1, 0, 0, 3, 49)], "grid_id string, route_id string, leg int, si int, sj int, gi int, gj int")
    assert abs(paths.leg_paths(steps, leg).agg(F.max("g")).first()[0] - 0.318621764) < 1e-6


def test_unsettled_labels_raise(spark):
    east = C.DIRECTIONS.index((0, 1))
    steps = spark.createDataFrame([("g", 0, j, east, 0, j + 1, 1.0) for j in range(12)], "grid_id string, i int, j int, k int, ni int, nj int, cost double")
    source = spark.createDataFrame([("g", "r", 1, 0, 0)], "grid_id string, route_id string, leg int, i int, j int")
    with pytest.raises(RuntimeError):
        paths.block_distances(steps, source, block=4, rounds=1)


def test_cover_of_large_and_small_polygons(spark):
    rng = random.Random(12)
    edges = []

    def add(gid, points):
        edges.extend((gid, *points[k], *points[(k + 1) % len(points)]) for k in range(len(points)))

    # A jagged coast that reaches over hundreds of cells, with a hole and an island in it, and small lakes.
    coast = [(x / 50, 0.2 * math.sin(x / 7) + rng.uniform(0, 0.3)) for x in range(0, 200)]
    add(1, [*coast, (4.0, -3.0), (0.0, -3.0)])
    add(1, [(1.0, -1.0), (2.0, -1.0), (2.0, -2.0), (1.0, -2.0)])
    add(1, [(1.4, -1.4), (1.6, -1.4), (1.6, -1.6), (1.4, -1.6)])
    for gid in range(2, 40):
        x, y, r = rng.uniform(-1, 5), rng.uniform(-4, 1), rng.uniform(0.001, 0.05)
        add(gid, [(x + r, y), (x, y + r), (x - r, y), (x, y - r)])
    points = [(n, rng.uniform(-1, 5), rng.uniform(-4, 1)) for n in range(3000)] + [(3000 + k, e[1] + 0.001, e[2]) for k, e in enumerate(edges)]
    frame = spark.createDataFrame(edges, "gid bigint, ax double, ay double, bx double, by double").repartition(7)
    by_gid = {}
    for gid, *e in edges:
        by_gid.setdefault(gid, []).append(e)

    def inside(x, y):
        return any(sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for ax, ay, bx, by in own) % 2 for own in by_gid.values())

    want = {n for n, x, y in points if inside(x, y)}
    places = spark.createDataFrame(points, "n int, x double, y double")
    for size in (0.02, 0.3, 10.0):
        assert {r.n for r in spatial.contained(places, frame, ["n"], size).collect()} == want
    cells = spatial.cover(frame, 0.02)
    wide = cells.filter("level > 0").count()
    assert 0 < wide < 4000 and cells.agg(F.max(F.size("edges"))).first()[0] < 20


def test_dyadic_intervals():
    for a in range(-9, 9):
        for b in range(a, 30):
            assert sorted(x for level, k in spatial.dyadic(a, b) for x in range(k << level, (k + 1) << level)) == list(range(a, b))


def test_distances_in_bands(spark):
    """A task searches one row of squares at a time, and rounds between the rows give the distances of a whole search, around a wall too."""
    rng = random.Random(5)
    nodes, _ = grid(spark, [[rng.uniform(0, 3) for _ in range(12)] for _ in range(14)])
    steps = cost.terrain_steps(nodes).filter("NOT (i BETWEEN 5 AND 7 AND j < 9) AND NOT (ni BETWEEN 5 AND 7 AND nj < 9)")
    source = spark.createDataFrame([("g", 2, 1)], "grid_id string, i int, j int")
    sources = source.selectExpr("grid_id", "'r' AS route_id", "1 AS leg", "i", "j").unionByName(source.selectExpr("grid_id", "'s' AS route_id", "2 AS leg", "12 AS i", "10 AS j"))
    got = paths.distances(steps, sources, 4, band_squares=1).collect()
    for route, start in (("r", source), ("s", source.selectExpr("grid_id", "12 AS i", "10 AS j"))):
        relaxed = {(r.i, r.j): round(r.g, 12) for r in paths.relaxed_distances(steps, start).collect()}
        assert {(r.i, r.j): round(r.g, 12) for r in got if r.route_id == route} == relaxed


def test_squares_hold_their_costs_once():
    side, n = 32, 200
    part = np.random.default_rng(0).uniform(1, 2, (len(C.DIRECTIONS), side * side)).tobytes()
    tracemalloc.start()
    field = paths.Squares(np.arange(n), np.zeros(n, np.int64), [part] * n, side)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert field.cost.nbytes == n * len(part) and peak < 2.5 * n * len(part)


def test_paths_by_tiles_are_those_of_a_whole_search(spark):
    """A task holds one tile of squares, however long the grid and the path, which winds around walls and comes back to tiles it left."""
    rng = random.Random(8)
    nodes, _ = grid(spark, [[rng.randint(0, 2) * 1.0 for _ in range(9)] for _ in range(26)])
    walls = "((i BETWEEN 6 AND 8 AND j < 7) OR (i BETWEEN 14 AND 16 AND j > 1))"
    steps = cost.terrain_steps(nodes).filter(f"NOT {walls} AND NOT {walls.replace('i B', 'ni B').replace('j ', 'nj ')}")
    legs = spark.createDataFrame([("g", "down", 1, 0, 0, 25, 8), ("g", "up", 2, 25, 8, 0, 0), ("g", "near", 1, 5, 0, 9, 0), ("g", "wall", 1, 0, 0, 7, 1)], "grid_id string, route_id string, leg int, si int, sj int, gi int, gj int")
    whole = sorted(paths.leg_paths(steps, legs).collect())
    assert sorted({r.route_id for r in whole}) == ["down", "near", "up"]
    assert sorted(paths.leg_paths(steps, legs, most_squares=4, side=2).collect()) == whole
    # A tile's costs are held once, and its width follows the narrow grid, so that long grids take few rounds.
    side = 32
    part = np.random.default_rng(0).uniform(1, 2, (len(C.DIRECTIONS), side * side)).tobytes()
    none = np.zeros(0, np.int64)
    tracemalloc.start()
    tile = paths.Tile(np.arange(128), np.zeros(128, np.int64), [part] * 128, side, none, none)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tile.cost.nbytes < 1.2 * 128 * len(part) and peak < 2.5 * 128 * len(part)


def test_a_task_of_the_search_holds_one_tile(spark):
    """Searching and tracing a tile of the greatest size takes little beyond its costs, so a worker's memory does not follow the grid."""
    side, n = cost.SIDE, paths.TILE_SQUARES // 2
    part = np.random.default_rng(1).uniform(1, 2, (len(C.DIRECTIONS), side * side)).tobytes()
    bi, bj = np.repeat(np.arange(n, dtype=np.int32), 2), np.tile(np.arange(2, dtype=np.int32), n)
    squares = pa.table({"bi": bi, "bj": bj, "cost": pa.array([part] * (2 * n), pa.binary())})
    goal = (n * side - 1) << 32 | 2 * side - 1
    label = {"grid_id": "g", "route_id": "r", "leg": pa.array([1], pa.int32()), "goal": [goal], "ti": pa.array([0], pa.int32()), "tj": pa.array([0], pa.int32()), "node": [0], "g": [0.0], "pred": [-1], "most": pa.array([None], pa.float64())}
    labels = pa.table({c: v if isinstance(v, (list, pa.Array)) else [v] for c, v in label.items()})
    asked = pa.concat_tables([labels.append_column("asked", [[False]]), labels.set_column(6, "node", [[goal]]).append_column("asked", [[True]])])
    tiles = paths.Tiles(n * side, 2 * side, side)
    tracemalloc.start()
    found, traced = tiles.search(squares, labels), tiles.trace(squares, asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert goal in found.column("node").to_pylist()
    assert traced.column("crossings").to_pylist()[0][0]["before"] == -1
    assert peak < 3 * 2 * n * len(part)
