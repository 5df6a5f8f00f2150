"""Directional step costs: terrain, streams, water and bridges, in that order.

A step table has one row per (grid_id, i, j, k); a blocked or off-grid step has no
row, so no infinite or missing cost ever enters a sum. The terrain stencil works
on blocks of nodes with a halo of two cells: only border nodes are sent twice, and
each block is computed as whole arrays.

Features are dealt to the blocks they reach and meet the nodes there (a cogroup), so
neither steps nor the samples between their ends are ever shuffled. All places that
are looked at, nodes and samples, lie on a lattice of quarters of a cell; a feature
marks the part of that lattice it reaches, once for all 16 directions.

``cost_blocks`` returns the costs packed, one row per square of ``SIDE`` nodes, which
is what paths are searched over; ``step_costs`` returns them as rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.geo import lon_metres
from . import spatial
from .shared import shuffled

#: Nodes along a block's side, along a packed square's side, and the reach of the longest step.
BLOCK, SIDE, HALO = 128, 32, 2
STEP_KEY = ["grid_id", "i", "j", "k"]
STEPS = "grid_id string, i int, j int, k int, ni int, nj int, cost double, wet boolean"
_STEPS = pa.schema([("grid_id", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("k", pa.int32()), ("ni", pa.int32()), ("nj", pa.int32()), ("cost", pa.float64()), ("wet", pa.bool_())])
#: The places of the lattice in a cell, and the moves of a step's samples on it.
QUARTERS = 4
SQUARES = "grid_id string, bi int, bj int, cost binary"
_SQUARES = pa.schema([("grid_id", pa.string()), ("bi", pa.int32()), ("bj", pa.int32()), ("cost", pa.binary())])


def with_halo(nodes: DataFrame, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """Nodes under every block (bi, bj) that needs them: their own, and those within the halo."""
    reach = lambda c: F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-halo, 0, halo)]), lambda d: F.floor((F.col(c) + d) / block).cast("int")))
    return nodes.select("*", F.explode(reach("i")).alias("bi")).select("*", F.explode(reach("j")).alias("bj"))


def _terrain(table: pa.Table, block: int) -> np.ndarray:
    """Hours of the steps of a block by direction, row and column; infinite where there is none."""
    column = lambda c: table.column(c).to_numpy()
    bi, bj = int(column("bi")[0]), int(column("bj")[0])
    i, j = column("i") - bi * block + HALO, column("j") - bj * block + HALO
    size = block + 2 * HALO
    elev, lat = np.full((size, size), np.nan), np.full(size, np.nan)
    elev[i, j] = column("elev")
    lat[i] = column("lat")
    lat_step, lon_step = column("lat_step")[0], column("lon_step")[0]
    lat_m = lat_step * C.M_PER_DEGREE
    lon_m = (lon_step * C.M_PER_DEGREE * np.cos(np.radians(lat[HALO : HALO + block])))[:, None]

    def at(di: int, dj: int) -> np.ndarray:
        return elev[HALO + di : HALO + di + block, HALO + dj : HALO + dj + block]

    def length(di: int, dj: int) -> np.ndarray:
        return np.sqrt((di * lat_m) ** 2 + (dj * lon_m) ** 2)

    out, here = np.empty((len(C.DIRECTIONS), block, block)), at(0, 0)
    for k, (di, dj) in enumerate(C.DIRECTIONS):
        distance = length(di, dj)
        with np.errstate(invalid="ignore"):
            slope = (at(di, dj) - here) / distance
            hours = distance / 1000.0 / (C.TOP_SPEED_KMH * np.exp(-C.STEEPNESS * np.abs(slope + C.DOWNHILL_BIAS)))
            # The ground to either side of the step; a missing side means no penalty.
            across = np.nan_to_num((at(-dj, di) - at(dj, -di)) / (2.0 * length(-dj, di)), nan=0.0)
            out[k] = hours * (1.0 + C.CROSS_SLOPE_WEIGHT * np.abs(across))
    out[np.isnan(out)] = np.inf
    return out


class Lattice:
    """The quarter-cell places of a block and its halo, and what features make of them."""

    def __init__(self, nodes: pa.Table, features: pa.Table, block: int):
        first = {c: t.column(c)[0].as_py() for t, names in ((nodes, ("bi", "bj", "lat_step", "lon_step")), (features, ("lat0", "lon0", "lon_m"))) for c in names}
        self.block, self.lon_m = block, first["lon_m"]
        n = QUARTERS * (block + 2 * HALO)
        quarters = np.arange(n) / QUARTERS - HALO
        self.y = first["lat0"] + (first["bi"] * block + quarters) * first["lat_step"]
        self.x = first["lon0"] + (first["bj"] * block + quarters) * first["lon_step"]
        self.wet, self.zone = np.zeros((n, n), bool), np.zeros((n, n), bool)
        self.metres = np.full((n, n), np.inf)

    def water(self, cells: list[dict]) -> None:
        for c in cells:
            size = c["size"]
            rows = np.flatnonzero(np.floor(self.y / size) == c["cy"])
            cols = np.flatnonzero(np.floor(self.x / size).astype(np.int64) >> c["level"] == c["cx"])
            edges = [(e["ax"], e["ay"], e["bx"], e["by"]) for e in c["edges"]]
            if not c["odd"] and not c["turns"]:
                # Nothing is inside above, below or to the right of all edges.
                y, x = self.y[rows], self.x[cols]
                rows = rows[(y >= min(min(e[1], e[3]) for e in edges)) & (y <= max(max(e[1], e[3]) for e in edges))]
                cols = cols[x <= max(max(e[0], e[2]) for e in edges)]
            if not len(rows) or not len(cols):
                continue
            y, x = self.y[rows], self.x[cols]
            odd = np.zeros((len(rows), len(cols)), bool)
            odd ^= (((np.array(c["turns"])[:, None] > y).sum(axis=0) + c["odd"]) % 2 == 1)[:, None]
            for ax, ay, bx, by in edges:
                spans = np.flatnonzero((ay > y) != (by > y))
                if len(spans):
                    odd[spans] ^= x < ((bx - ax) * ((y[spans] - ay) / (by - ay)) + ax)[:, None]
            self.wet[np.ix_(rows, cols)] |= odd

    def _near(self, e: dict, pad_x: float, pad_y: float) -> tuple[slice, slice]:
        """The part of the lattice in a segment's padded box."""
        part = lambda at, a, b, pad: slice(int(np.searchsorted(at, min(a, b) - pad, "left")), int(np.searchsorted(at, max(a, b) + pad, "right")))
        return part(self.y, e["ay"], e["by"], pad_y), part(self.x, e["ax"], e["bx"], pad_x)

    def streams(self, segments: list[dict], buffer_deg: float) -> None:
        for e in segments:
            rows, cols = self._near(e, buffer_deg, buffer_deg)
            self.zone[rows, cols] |= _distance(self.x[cols], self.y[rows], **e)[0] <= buffer_deg

    def bridges(self, segments: list[dict]) -> None:
        mx, my = self.lon_m, C.M_PER_DEGREE
        for e in segments:
            rows, cols = self._near(e, C.BRIDGE_BUFFER_M / mx * 1.5, C.BRIDGE_BUFFER_M / my * 1.5)
            d, along = _distance(self.x[cols] * mx, self.y[rows] * my, e["ax"] * mx, e["ay"] * my, e["bx"] * mx, e["by"] * my)
            beside = (along >= 0) & (along <= 1) & (d <= C.BRIDGE_BUFFER_M)
            self.metres[rows, cols] = np.where(beside, np.minimum(d, self.metres[rows, cols]), self.metres[rows, cols])

    def _moved(self, of: np.ndarray, di: float, dj: float) -> np.ndarray:
        a, b = (int(QUARTERS * (HALO + d)) for d in (di, dj))
        span = QUARTERS * self.block
        return of[a : a + span : QUARTERS, b : b + span : QUARTERS]

    def at_ends(self, of: np.ndarray, di: int, dj: int) -> np.ndarray:
        return self._moved(of, 0, 0) | self._moved(of, di, dj)

    def sampled(self, of: np.ndarray, di: int, dj: int) -> list[np.ndarray]:
        return [self._moved(of, di * t, dj * t) for t in C.SAMPLES]


def _distance(x: np.ndarray, y: np.ndarray, ax: float, ay: float, bx: float, by: float) -> tuple[np.ndarray, np.ndarray]:
    """As ``spatial.segment_distance``, for a lattice of columns and rows."""
    x, y, dx, dy = x[None, :], y[:, None], bx - ax, by - ay
    square = dx * dx + dy * dy
    along = ((x - ax) * dx + (y - ay) * dy) / square if square else np.full((y.shape[0], x.shape[1]), np.nan)
    held = np.maximum(0.0, np.minimum(1.0, along)) if square else 0.0
    ex, ey = x - (ax + held * dx), y - (ay + held * dy)
    return np.sqrt(ex * ex + ey * ey), along


def _priced(nodes: pa.Table, features: pa.Table | None, block: int, buffer_deg: float) -> tuple[np.ndarray, np.ndarray]:
    """(final costs, wet steps) of a block: terrain, then streams, then water, then bridges."""
    cost = _terrain(nodes, block)
    wet = np.zeros(cost.shape, bool)
    if features is None or not features.num_rows:
        return cost, wet
    lattice, rows = Lattice(nodes, features, block), features.to_pylist()
    lattice.water([r for r in rows if r["kind"] == "water"])
    # A segment reaches a block through several buckets.
    once = lambda kind: [dict(zip(("ax", "ay", "bx", "by"), e)) for e in sorted({tuple(r["edges"][0][c] for c in ("ax", "ay", "bx", "by")) for r in rows if r["kind"] == kind})]
    lattice.streams(once("streams"), buffer_deg)
    lattice.bridges(once("bridges"))
    for k, (di, dj) in enumerate(C.DIRECTIONS):
        zone = np.logical_or.reduce([lattice.at_ends(lattice.zone, di, dj), *lattice.sampled(lattice.zone, di, dj)])
        wet[k] = np.logical_or.reduce([lattice.at_ends(lattice.wet, di, dj), *lattice.sampled(lattice.wet, di, dj)])
        metres = np.minimum.reduce(lattice.sampled(lattice.metres, di, dj))
        beside = metres < np.inf
        pull = 1.0 + C.BRIDGE_CENTRING * np.minimum(1.0, np.where(beside, metres, 0.0) / C.BRIDGE_BUFFER_M)
        wet[k] &= np.isfinite(cost[k])
        cost[k] = np.where(beside, cost[k] * pull, np.where(wet[k], np.inf, np.where(zone, cost[k] * C.STREAM_WEIGHT, cost[k])))
    return cost, wet


def _as_steps(grid_id: str, i0: int, j0: int, cost: np.ndarray, wet: np.ndarray | None = None) -> pa.Table:
    """Rows of the steps that have a cost, or are wet."""
    di, dj = (np.array(d) for d in zip(*C.DIRECTIONS))
    k, r, c = np.nonzero(np.isfinite(cost) if wet is None else np.isfinite(cost) | wet)
    i, j = r + i0, c + j0
    own = wet[k, r, c] if wet is not None else np.zeros(len(k), bool)
    return pa.table([pa.array([grid_id] * len(k), pa.string()), *(x.astype(np.int32) for x in (i, j, k, i + di[k], j + dj[k])), cost[k, r, c], own], schema=_STEPS)


def side_of(block: int) -> int:
    """The side of the packed squares that a block is cut into."""
    return SIDE if block % SIDE == 0 else block


def _as_squares(grid_id: str, bi: int, bj: int, cost: np.ndarray) -> pa.Table:
    block, side, rows = cost.shape[1], side_of(cost.shape[1]), []
    n = block // side
    for a in range(n):
        for b in range(n):
            part = cost[:, a * side : (a + 1) * side, b * side : (b + 1) * side]
            if np.isfinite(part).any():
                rows.append((grid_id, bi * n + a, bj * n + b, part.tobytes()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, _SQUARES.types)], schema=_SQUARES)


def _features(axes: DataFrame, water: DataFrame | None, streams: DataFrame | None, bridges: DataFrame | None, buffer_deg: float, block: int) -> DataFrame:
    """(grid_id, bi, bj, lat0, lon0, lon_m, kind, size, level, cx, cy, odd, turns, edges): what reaches each block of the grids.

    Blocks are listed under the buckets of about their own size that they and their
    halo touch, features under those they reach. They meet by shuffles, as a few small rows
    of grids make many blocks. Each feature tells the origin of its block's grid, so nodes need not.
    """
    span = axes.agg(F.max(F.greatest("lat_step", "lon_step"))).first()[0]
    size = float((span or 1.0) * block)
    rows = axes.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / block).cast("int"))).alias("bi"))
    blocks = rows.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("cols") - 1) / block).cast("int"))).alias("bj"))

    def buckets(origin: str, step: str, at: str):
        low = F.col(origin) + (F.col(at) * block - HALO) * F.col(step)
        return spatial._cells(low, low + (block + 2 * HALO) * F.col(step), size)

    keys, origin, found = ["grid_id", "bi", "bj"], ["lat0", "lon0", "lon_m"], []
    # Metres are taken at each grid's mean latitude.
    lon_m = lon_metres(F.col("lat0") + (F.col("rows") - 1) / 2 * F.col("lat_step")).alias("lon_m")
    blocks = blocks.select(F.col("grid_id").cast("string"), "bi", "bj", "lat0", "lon0", lon_m, F.explode(buckets("lat0", "lat_step", "bi")).alias("cy"), buckets("lon0", "lon_step", "bj").alias("xs"))
    blocks = blocks.select(*keys, *origin, "cy", F.explode("xs").alias("cx"))
    if water is not None:
        cells, wide = spatial.covered(water, size)
        own = [*keys, *origin, F.lit("water").alias("kind"), F.lit(size).alias("size"), "level"]
        found.append(blocks.join(shuffled(cells.filter("level = 0")), ["cx", "cy"]).select(*own, "cx", "cy", "odd", "turns", "edges"))
        if wide:
            once = spatial.in_wide_cells(blocks, cells, wide).dropDuplicates([*keys, "gid", "level", "cy", "wx"])
            none = [F.lit(True).alias("odd"), F.array().cast("array<double>").alias("turns"), F.array().cast(f"array<{spatial._EDGE}>").alias("edges")]
            found.append(once.select(*own, F.col("wx").alias("cx"), "cy", *none))
    for kind, segments, pad in (("streams", streams, buffer_deg), ("bridges", bridges, C.BRIDGE_BUFFER_M / C.M_PER_DEGREE * 6)):
        if segments is not None:
            listed = (
                segments.select(F.struct("ax", "ay", "bx", "by").alias("e"))
                .select("e", F.explode(spatial._cells(F.least("e.ax", "e.bx") - pad, F.greatest("e.ax", "e.bx") + pad, size)).alias("cx"))
                .select("e", "cx", F.explode(spatial._cells(F.least("e.ay", "e.by") - pad, F.greatest("e.ay", "e.by") + pad, size)).alias("cy"))
            )
            none = F.array().cast("array<double>").alias("turns")
            found.append(blocks.join(shuffled(listed), ["cx", "cy"]).select(*keys, *origin, F.lit(kind).alias("kind"), F.lit(size).alias("size"), F.lit(0).alias("level"), "cx", "cy", F.lit(False).alias("odd"), none, F.array("e").alias("edges")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _by_block(nodes: DataFrame, axes: DataFrame | None, water: DataFrame | None, streams: DataFrame | None, bridges: DataFrame | None, buffer_deg: float | None, block: int, made, ddl: str) -> DataFrame:
    """``made(grid_id, bi, bj, costs, wet)`` of every block."""
    buffer_deg = buffer_deg or C.stream_buffer_deg(C.REGION_LAT)
    slim = nodes.filter("elev IS NOT NULL").select(F.col("grid_id").cast("string"), F.col("i").cast("int"), F.col("j").cast("int"), *(F.col(c).cast("double") for c in ("lat", "lat_step", "lon_step", "elev")))
    name = lambda t: (t.column("grid_id")[0].as_py(), t.column("bi")[0].as_py(), t.column("bj")[0].as_py())
    if water is None and streams is None and bridges is None:
        return with_halo(slim, block).groupBy("grid_id", "bi", "bj").applyInArrow(lambda t: made(*name(t), *_priced(t, None, block, buffer_deg)), ddl)
    if bridges is not None:
        bridges = bridges.filter(~((F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))))
    features = _features(axes, water, streams, bridges, buffer_deg, block)
    none = made("", 0, 0, np.full((len(C.DIRECTIONS), block, block), np.inf), np.zeros((len(C.DIRECTIONS), block, block), bool)).slice(0, 0)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return made(*name(left), *_priced(left, right, block, buffer_deg)) if left.num_rows else none

    key = ["grid_id", "bi", "bj"]
    return with_halo(slim, block).groupBy(*key).cogroup(features.groupBy(*key)).applyInArrow(meet, ddl)


def terrain_steps(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Hours of every step between nodes (grid_id, i, j, lat, lat_step, lon_step, elev)."""
    return step_costs(nodes, block=block)


def terrain_steps_sql(nodes: DataFrame) -> DataFrame:
    """The same costs by one scatter and one gather, in column functions alone."""
    dirs = [F.struct(F.lit(k).alias("k"), F.lit(di).alias("di"), F.lit(dj).alias("dj")) for k, (di, dj) in enumerate(C.DIRECTIONS)]
    sent = nodes.select("grid_id", "i", "j", "elev", F.explode(F.array(*dirs)).alias("d"))
    around = sent.groupBy("grid_id", (F.col("i") - F.col("d.di")).alias("i"), (F.col("j") - F.col("d.dj")).alias("j")).agg(F.map_from_entries(F.collect_list(F.struct("d.k", "elev"))).alias("e"))
    index = {d: k for k, d in enumerate(C.DIRECTIONS)}
    side = {k: (index[(-dj, di)], index[(dj, -di)]) for k, (di, dj) in enumerate(C.DIRECTIONS)}
    turned = [F.struct(F.lit(k).alias("k"), F.lit(di).alias("di"), F.lit(dj).alias("dj"), F.lit(side[k][0]).alias("p"), F.lit(side[k][1]).alias("m")) for k, (di, dj) in enumerate(C.DIRECTIONS)]
    each = nodes.join(around, ["grid_id", "i", "j"]).select("*", F.explode(F.array(*turned)).alias("d"))
    lat_m, lon_m = F.col("lat_step") * C.M_PER_DEGREE, F.col("lon_step") * lon_metres("lat")
    length = lambda di, dj: F.sqrt(F.pow(di * lat_m, F.lit(2.0)) + F.pow(dj * lon_m, F.lit(2.0)))
    e = lambda k: F.try_element_at("e", k)
    di, dj = F.col("d.di"), F.col("d.dj")
    each = each.withColumns({"distance": length(di, dj), "side": length(-dj, di) * 2.0, "target": e(F.col("d.k")), "across": F.coalesce(e(F.col("d.p")) - e(F.col("d.m")), F.lit(0.0))})
    slope = (F.col("target") - F.col("elev")) / F.col("distance")
    hours = F.col("distance") / 1000.0 / (C.TOP_SPEED_KMH * F.exp(-C.STEEPNESS * F.abs(slope + C.DOWNHILL_BIAS)))
    cost = hours * (1.0 + C.CROSS_SLOPE_WEIGHT * F.abs(F.col("across") / F.col("side")))
    return each.filter("target IS NOT NULL").select("grid_id", "i", "j", F.col("d.k").alias("k"), (F.col("i") + di).alias("ni"), (F.col("j") + dj).alias("nj"), cost.alias("cost"))


def water_nodes(nodes: DataFrame, water: DataFrame, size: float | None = None) -> DataFrame:
    """(grid_id, i, j) of nodes inside any water polygon."""
    points = nodes.select("grid_id", "i", "j", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.contained(points, water, ["grid_id", "i", "j"], size)


def water_steps(nodes: DataFrame, axes: DataFrame, water: DataFrame, block: int = BLOCK) -> DataFrame:
    """Keys of steps with an end or a sample in water."""
    made = lambda g, bi, bj, cost, wet: _as_steps(g, bi * block, bj * block, cost, wet)
    return _by_block(nodes, axes, water, None, None, None, block, made, STEPS).filter("wet").select(*STEP_KEY)


def step_costs(nodes: DataFrame, axes: DataFrame | None = None, water: DataFrame | None = None, streams: DataFrame | None = None, bridges: DataFrame | None = None, stream_buffer_deg: float | None = None, block: int = BLOCK) -> DataFrame:
    """Steps (grid_id, i, j, k, ni, nj, cost) with their final cost.

    Terrain, then streams (x 1.5), then water (no step), then bridges: a step
    beside a bridge gets its terrain cost back, with a pull to the centre line,
    whatever streams and water made of it. Of a step its ends and three samples are
    looked at, for a bridge the samples alone, and not those beyond a bridge's ends.

    ``axes`` has one row per grid with its origin, steps and size; terrain needs none.
    """
    made = lambda g, bi, bj, cost, wet: _as_steps(g, bi * block, bj * block, cost)
    return _by_block(nodes, axes, water, streams, bridges, stream_buffer_deg, block, made, STEPS).drop("wet")


def cost_blocks(nodes: DataFrame, axes: DataFrame | None = None, water: DataFrame | None = None, streams: DataFrame | None = None, bridges: DataFrame | None = None, stream_buffer_deg: float | None = None, block: int = BLOCK) -> DataFrame:
    """The costs of ``step_costs`` packed: (grid_id, bi, bj, cost), one row for each square of ``side_of(block)`` nodes.

    ``cost`` holds doubles by direction, row and column, infinite where there is no step.
    """
    made = lambda g, bi, bj, cost, wet: _as_squares(g, bi, bj, cost)
    return _by_block(nodes, axes, water, streams, bridges, stream_buffer_deg, block, made, SQUARES)


def packed_steps(steps: DataFrame, side: int = SIDE) -> DataFrame:
    """Step rows as the squares of ``cost_blocks``."""

    def pack(table: pa.Table) -> pa.Table:
        bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        i, j, k, cost = (table.column(c).to_numpy() for c in ("i", "j", "k", "cost"))
        out = np.full((len(C.DIRECTIONS), side, side), np.inf)
        out[k, i - bi * side, j - bj * side] = cost
        return pa.table([pa.array([x], t) for x, t in zip((table.column("grid_id")[0].as_py(), bi, bj, out.tobytes()), _SQUARES.types)], schema=_SQUARES)

    at = lambda c: F.floor(F.col(c) / side).cast("int")
    slim = steps.select(F.col("grid_id").cast("string"), "i", "j", "k", "cost", at("i").alias("bi"), at("j").alias("bj"))
    return slim.groupBy("grid_id", "bi", "bj").applyInArrow(pack, SQUARES)


def unpacked_steps(squares: DataFrame, side: int = SIDE) -> DataFrame:
    """The rows of ``step_costs`` from packed squares."""

    def unpack(batches):
        for batch in batches:
            for grid_id, bi, bj, cost in zip(*(batch.column(c).to_pylist() for c in ("grid_id", "bi", "bj", "cost"))):
                yield from _as_steps(grid_id, bi * side, bj * side, np.frombuffer(cost).reshape(-1, side, side)).to_batches()

    return squares.mapInArrow(unpack, STEPS).drop("wet")


def line_segments(vertices: DataFrame) -> DataFrame:
    """Consecutive vertices (gid, part, seq, x, y) as segments; repeated vertices make none."""
    order = Window.partitionBy("gid", "part").orderBy("seq")
    ends = vertices.select("gid", "part", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(order).alias("bx"), F.lead("y").over(order).alias("by"))
    return ends.filter(F.col("bx").isNotNull() & ~((F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))))
