"""Feature layers as tables.

A layer that areas are read from is stored by coarse cells (``write_by_cell``): a table
partitioned by the cells that each feature's box touches, with the box beside each
edge. ``read_areas`` joins it with the cells of the areas, so Spark prunes partitions by
what the areas turn out to be (dynamic partition pruning); no other file is opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Degrees of a coarse cell of a stored layer.
CELL_DEG = 0.5


def write_by_cell(edges: DataFrame, path: str, name: str, cell_deg: float = CELL_DEG) -> None:
    """Stores edges (gid, seq, ax, ay, bx, by): a feature whole under every coarse cell that its box touches."""
    at = lambda c: F.floor(F.col(c) / cell_deg).cast("int")
    box = edges.groupBy("gid").agg(*[f(g(a, b)).alias(n) for n, f, g, a, b in (("min_x", F.min, F.least, "ax", "bx"), ("min_y", F.min, F.least, "ay", "by"), ("max_x", F.max, F.greatest, "ax", "bx"), ("max_y", F.max, F.greatest, "ay", "by"))])
    listed = box.select("*", F.explode(F.sequence(at("min_x"), at("max_x"))).alias("cell_x")).select("*", F.explode(F.sequence(at("min_y"), at("max_y"))).alias("cell_y"))
    edges.join(listed, "gid").repartition("cell_x", "cell_y").write.mode("overwrite").partitionBy("cell_x", "cell_y").parquet(f"{path}/{name}")


def read_areas(layer: DataFrame, areas: DataFrame, cell_deg: float = CELL_DEG) -> DataFrame:
    """(gid, seq, ax, ay, bx, by) of the stored features whose box touches a coarse cell of an area (bbox)."""
    b, at = F.col("bbox"), lambda v: F.floor(v / cell_deg).cast("int")
    columns = areas.select(b.alias("bbox"), F.explode(F.sequence(at(b["min_lon"]), at(b["max_lon"]))).alias("cell_x"))
    cells = columns.select("cell_x", F.explode(F.sequence(at(b["min_lat"]), at(b["max_lat"]))).alias("cell_y")).distinct()
    # Cells of the globe: a filter on the areas' side is what makes Spark prune by it.
    most = int(360 / cell_deg) + 1
    cells = cells.filter(F.col("cell_x").between(-most, most) & F.col("cell_y").between(-most, most))
    near = layer.join(cells, ["cell_x", "cell_y"], "left_semi")
    return near.dropDuplicates(["gid", "seq"]).select("gid", "seq", "ax", "ay", "bx", "by")


def read_layer(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One layer that ``write_layers`` wrote."""
    return spark.read.parquet(f"{path}/{name}")
