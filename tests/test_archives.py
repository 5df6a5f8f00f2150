"""Shape layers written by the test into zip archives, and the preparation job over them."""

import time
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fellway.operators import cost, layers
from fellway.operators.shared import shared_dir
from fellway.plans import fixtures
from fellway.plans.prepare import line_layer, prepare_layers
from fellway.sources import archives
from fellway.sources.archives import read_shape_layer, shape_files
from fellway.sources.layers import read_layer


def archive(path, layers, without=()):
    with zipfile.ZipFile(path, "w") as z:
        for name, (kind, features, names, rows) in layers.items():
            for ending, content in shape_files(kind, features, names, rows, width=12).items():
                if ending not in without:
                    z.writestr(f"data/{name}{ending}", content)


LINE, SQUARE = [(174.0, -41.0), (174.1, -41.0), (174.2, -41.1)], [(179.0, -41.0), (181.0, -41.0), (181.0, -40.0), (179.0, -40.0), (179.0, -41.0)]
HOLE = [(179.2, -40.8), (179.4, -40.8), (179.4, -40.6), (179.2, -40.8)]


@pytest.fixture
def raw(tmp_path):
    archive(tmp_path / "a.zip", {
        "ways_1": (3, [[LINE], [LINE, LINE[:2]], [LINE], []], ["fclass", "name"], [["river", "Ōtāk"], ["canal", None], ["drain", None], ["stream", None]]),
        "roads_1": (3, [[LINE], [LINE], [LINE]], ["fclass", "bridge"], [["path", "T"], ["motorway", "T"], [None, "F"]]),
        "water_1": (5, [[SQUARE, HOLE]], ["fclass"], [["wäter"]]),
    })
    return str(tmp_path)


def test_features_and_fields(spark, raw):
    rows = sorted(read_shape_layer(spark, raw, "ways").collect(), key=lambda r: r.gid)
    assert [r.attributes["fclass"] for r in rows] == ["river", "canal", "drain", "stream"] and rows[1].attributes["name"] is None
    assert [len(r.parts) for r in rows] == [1, 2, 1, 0] and rows[3].min_x is None
    assert [(p.x, p.y) for p in rows[0].parts[0].points] == LINE and (rows[0].min_x, rows[0].max_y) == (174.0, -41.0)
    assert read_shape_layer(spark, raw, "water").first().attributes["fclass"] == "wäter"


def test_a_missing_layer_is_an_error(spark, raw):
    with pytest.raises(Exception, match="no shape file of layer rails"):
        read_shape_layer(spark, raw, "rails").collect()


def test_preparation_job(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    wanted = {"streams": (raw, "ways"), "bridges": (raw, "roads"), "water": (raw, "water"), "ocean": (raw, "water")}
    counts = prepare_layers(spark, wanted, out)
    assert counts == {"streams": {"scanned": 4, "written": 5}, "bridges": {"scanned": 3, "written": 2}, "water": {"scanned": 1, "written": 7}, "ocean": {"scanned": 1, "written": 7}}
    ocean = read_layer(spark, out, "ocean").collect()
    assert max(r.ax for r in ocean) == 180.0 and len({r.gid for r in ocean}) == 1
    assert read_layer(spark, out, "streams").count() == 5
    assert prepare_layers(spark, wanted, out) == {}
    assert prepare_layers(spark, {"bridges": (raw, "roads")}, out, overwrite=True) == {"bridges": {"scanned": 3, "written": 2}}


def test_parts_of_a_layer_make_the_whole(spark, tmp_path):
    lines = [[[(float(k), float(n)) for n in range(2 + k % 5)] for _ in range(k % 3)] for k in range(57)]
    for name in ("a", "b"):
        archive(tmp_path / f"{name}.zip", {"ways_1": (3, lines, ["fclass"], [[f"{name}{k}"] for k in range(57)]), "ways_2": (3, lines[:3], ["fclass"], [[None]] * 3)})
    key = lambda df: sorted((r.archive, r.member, r.gid, str(r.attributes), str(r.parts)) for r in df.collect())
    whole, parts = (read_shape_layer(spark, str(tmp_path), "ways", n) for n in (1000, 7))
    assert key(whole) == key(parts) and len(key(whole)) == 2 * 60
    assert parts.select(F.spark_partition_id()).distinct().count() > 1


def test_incomplete_layers_are_errors(spark, tmp_path):
    for without, what in ((".dbf", "attribute table"), (".shx", "index")):
        folder = tmp_path / without
        folder.mkdir()
        archive(folder / "a.zip", {"ways_1": (3, [[LINE]], ["fclass"], [["river"]])}, without=(without,))
        with pytest.raises(Exception, match=what):
            read_shape_layer(spark, str(folder), "ways").collect()


def test_writing_grows_with_the_layer():
    """Ten times the lines take about ten times the time, and the index still finds every record."""
    made = lambda n: shape_files(3, [[LINE]] * n, ["fclass"], [["river"]] * n)
    seconds = []
    for n in (20_000, 200_000):
        began = time.process_time()
        files = made(n)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 30 * seconds[0]
    places = np.frombuffer(files[".shx"], ">i4", offset=100).reshape(-1, 2)[:, 0].astype(np.int64) * 2
    assert len(places) == 200_000 and places[0] == 100 and (np.diff(places) == (len(files[".shp"]) - 100) // 200_000).all()


def test_archives_are_bounded(spark, tmp_path, monkeypatch):
    """More lines go to more archives, with the same rows in all."""
    monkeypatch.setattr(fixtures, "ARCHIVE_FEATURES", 1000)
    monkeypatch.setattr(fixtures, "shared_dir", lambda _: str(tmp_path))
    path, layer = fixtures.raw_archives(spark, "/root/testdata/sf0.001")["streams"]
    sizes = [r["count"] for r in read_shape_layer(spark, path, layer).groupBy("archive").count().collect()]
    assert len(sizes) > fixtures.ARCHIVES and max(sizes) < 2000
    assert sum(sizes) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def unpacked(spark):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    return {f for ending in ("shp", "shx", "dbf") for f in folder.rglob(f"*.{ending}")}


def test_members_are_not_unpacked_on_disk(spark, raw, tmp_path):
    """The job leaves no copy of a member that memory holds, and one copy of a larger one, whatever reads it."""
    wanted, before = {"streams": (raw, "roads"), "bridges": (raw, "roads")}, unpacked(spark)
    prepare_layers(spark, wanted, str(tmp_path / "small"))
    assert unpacked(spark) == before
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(archives, "WHOLE_BYTES", 0)
        counts = prepare_layers(spark, wanted, str(tmp_path / "large"))
    assert len(unpacked(spark) - before) == 3 and counts["bridges"] == {"scanned": 3, "written": 2}


def test_copied_members_give_the_same_features(spark, tmp_path, monkeypatch):
    """Lines of several parts, null shapes, and an index whose records lie in another order, far from each other."""
    lines = [[[(float(k), float(n)) for n in range(2 + (k + m) % 5)] for m in range(k % 4)] for k in range(41)]
    files = shape_files(3, lines, ["fclass", "bridge"], [[f"{k}é", "T" if k % 2 else None] for k in range(41)])
    index = np.frombuffer(files[".shx"], ">i4", offset=100).reshape(-1, 2)
    order = np.random.default_rng(1).permutation(41)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for ending, content in (files | {".shx": files[".shx"][:100] + index[order].tobytes()}).items():
            z.writestr(f"data/ways_1{ending}", content)
    key = lambda df: sorted((r.gid, str(r.attributes), str([[(p.kind, [(q.x, q.y) for q in p.points]) for p in r.parts], r.min_x, r.max_y])) for r in df.collect())
    whole = key(read_shape_layer(spark, str(tmp_path), "ways"))
    assert [eval(shape)[0] for _, _, shape in whole] == [[("line", part) for part in lines[k]] for k in order] and whole[3][1] == str({"fclass": "3é", "bridge": "T"})
    monkeypatch.setattr(archives, "WHOLE_BYTES", 0)
    assert key(read_shape_layer(spark, str(tmp_path), "ways", 7)) == whole == key(read_shape_layer(spark, str(tmp_path), "ways", 1))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for ending, content in (files | {".shp": files[".shp"][:-9]}).items():
            z.writestr(f"data/ways_1{ending}", content)
    for most in (0, 1 << 20):
        monkeypatch.setattr(archives, "WHOLE_BYTES", most)
        with pytest.raises(Exception, match="beyond the end of its file"):
            read_shape_layer(spark, str(tmp_path), "ways").collect()


def test_lines_become_edges_without_a_shuffle(spark, raw, tmp_path):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    features = read_shape_layer(spark, raw, "ways")
    made = line_layer(features)
    assert plan(made).count("Exchange") == plan(features).count("Exchange")
    lines = spark.createDataFrame([(1, 0, [(0.0, 0.0), (1.0, 0.0), (1.0, 0.0), (0.0, 2.0)]), (1, 1, [(5.0, 5.0), (5.0, 6.0)]), (2, 0, [(1.0, 1.0)]), (3, 0, [])], "gid int, part int, points array<struct<x:double,y:double>>")
    assert sorted(layers.line_edges(lines).collect()) == sorted(cost.line_segments(layers.line_vertices(lines)).collect()) and layers.line_edges(lines).count() == 3


def test_shapes_are_made_where_their_archive_is_written(spark, tmp_path, monkeypatch):
    """What is brought to an archive are the columns that its shapes are made from."""
    monkeypatch.setattr(fixtures, "shared_dir", lambda _: str(tmp_path))
    plans = []
    write = fixtures.write_archives
    monkeypatch.setattr(fixtures, "write_archives", lambda df, *rest: plans.append(write(df, *rest)) or plans[-1])
    fixtures.raw_archives(spark, "/root/testdata/sf0.001")
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString().split("Exchange")
        assert len(plan) == 2 and "array(" in plan[0] and "array(" not in plan[1] and "Sort" not in plan[0].split("array(")[0]
