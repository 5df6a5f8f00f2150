"""A stored layer is pruned by what the areas turn out to be."""

import random

from pyspark.sql import functions as F

from fellway.sources.layers import read_areas, read_layer, write_by_cell


def edges_of(spark, boxes):
    rows = []
    for gid, (x, y, w) in enumerate(boxes):
        points = [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
        rows += [(gid, k, *points[k], *points[(k + 1) % 4]) for k in range(4)]
    return spark.createDataFrame(rows, "gid bigint, seq int, ax double, ay double, bx double, by double")


def test_only_cells_of_the_areas_are_read(spark, tmp_path):
    rng = random.Random(2)
    boxes = [(rng.uniform(-5, 5), rng.uniform(-5, 5), rng.choice([0.01, 0.2, 3.0])) for _ in range(200)]
    write_by_cell(edges_of(spark, boxes), str(tmp_path), "water", 1.0)
    areas = [(-41.0, 0.0, -40.0, 0.0), (0.2, 0.3, 0.4, 0.6), (-3.7, 2.2, -2.1, 2.4)]
    asked = spark.createDataFrame([(a,) for a in areas], "bbox struct<min_lat:double,min_lon:double,max_lat:double,max_lon:double>")
    asked.write.parquet(f"{tmp_path}/areas")
    near = read_areas(read_layer(spark, str(tmp_path), "water"), spark.read.parquet(f"{tmp_path}/areas"), 1.0)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    cell = lambda v: int(v // 1)
    touch = lambda b, a: cell(b[0]) <= cell(a[3]) and cell(b[0] + b[2]) >= cell(a[1]) and cell(b[1]) <= cell(a[2]) and cell(b[1] + b[2]) >= cell(a[0])
    want = {gid for gid, b in enumerate(boxes) if any(touch(b, a) for a in areas)}
    got = near.groupBy("gid").agg(F.count("*").alias("n")).collect()
    assert {r.gid for r in got} == want and {r.n for r in got} == {4} and len(want) < len(boxes)
