"""Preparing the engine's layers from raw archives: read, filter, cut to the region, split, write, count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import layers
from ..operators.export import write_layers
from ..sources.archives import read_shape_layer, with_fields
from ..sources.files import exists


def line_layer(features: DataFrame) -> DataFrame:
    """(gid, part, seq, ax, ay, bx, by) of usable lines, each part for itself."""
    named = features.withColumn("gid", F.xxhash64("archive", "member", "gid"))
    split = layers.split_parts(named.select("gid", "parts"), kinds=("line",))
    lines = split.select("gid", "part", F.col("geometry.points").alias("points")).filter(layers.usable_line())
    return layers.line_edges(lines)


def polygon_layer(features: DataFrame, box: dict[str, float] | None = None) -> DataFrame:
    """(gid, seq, ax, ay, bx, by) of all rings of the polygons; with a box, those that meet it, cut to it.

    A feature's rings share its gid, so holes are told by the parity of crossings.
    """
    if box:
        features = layers.in_box(features, box)
    named = features.withColumn("gid", F.xxhash64("archive", "member", "gid"))
    split = layers.split_parts(named.select("gid", "parts"), kinds=("polygon",))
    points = F.col("geometry.points")
    # The format repeats a ring's first point as its last.
    closed = (F.size(points) > 1) & (points[0] == F.element_at(points, -1))
    rings = split.select("gid", F.when(closed, F.slice(points, 1, F.size(points) - 1)).otherwise(points).alias("ring"))
    return layers.ring_edges(layers.clip_rings(rings, box) if box else rings)


def prepare_layers(spark: SparkSession, archives: dict[str, tuple[str, str]], out: str, region: dict[str, float] | None = None, overwrite: bool = False) -> dict[str, dict[str, int]]:
    """Writes the tables water, ocean, streams and bridges under ``out`` and returns what each scanned and wrote.

    ``archives`` names for each layer the path of its zip archives and the start of
    its file names. Ocean polygons are cut to the region. Counts are observed while
    the tables are written; a table that is there already is left alone unless
    ``overwrite``, and then has no counts.
    """
    counted: dict[str, tuple[Observation, Observation]] = {}
    made: dict[str, DataFrame] = {}
    # Layers of one source share what is copied out of its archives.
    read = {source: read_shape_layer(spark, *source) for source in dict.fromkeys(archives.values())}
    for name, source in archives.items():
        counted[name] = Observation(f"{name} scanned"), Observation(f"{name} written")
        features = read[source].observe(counted[name][0], F.count("*").alias("n"))
        if name == "streams":
            table = line_layer(layers.stream_lines(with_fields(features, "fclass")))
        elif name == "bridges":
            table = line_layer(layers.bridge_lines(with_fields(features, "fclass", "bridge")))
        elif name == "ocean":
            table = polygon_layer(features, region or C.REGION)
        else:
            table = polygon_layer(features)
        made[name] = table.observe(counted[name][1], F.count("*").alias("n"))
    new = {name for name in made if overwrite or not exists(f"{out}/{name}")}
    write_layers({name: made[name] for name in made if name in new}, out, overwrite)
    return {name: {"scanned": counted[name][0].get["n"], "written": counted[name][1].get["n"]} for name in new}
