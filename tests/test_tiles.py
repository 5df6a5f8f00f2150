"""Tiles are planned: only needed files are opened, and a missing one ends the read without its key."""

import numpy as np
import pytest

from fellway.operators import grid
from fellway.sources import dem

BOX = {"min_lat": -41.02, "min_lon": 174.0, "max_lat": -41.0, "max_lon": 174.05}


@pytest.fixture
def store(spark, tmp_path):
    axes = grid.grid_axes(spark.createDataFrame([("g", tuple(BOX[c] for c in ("min_lat", "min_lon", "max_lat", "max_lon")), 20.0)], "grid_id string, bbox struct<min_lat:double,min_lon:double,max_lat:double,max_lon:double>, cell_m double"))
    tiles = [(t.zoom, t.tile_x, t.tile_y) for t in dem.tiles_of(axes).collect()]
    path = f"{tmp_path}/tiles?api=secret/{{z}}/{{x}}/{{y}}.png"
    rows = [(z, x * 256 + n, y * 256 + 7, 1, 134, 170 + n) for z, x, y in tiles for n in range(5)]
    written = dem.write_tiles(spark.createDataFrame(rows, "zoom int, gx bigint, gy bigint, r int, g int, b int"), path).collect()
    assert sorted((t.zoom, t.tile_x, t.tile_y) for t in written) == sorted(tiles) and len(tiles) > 1
    # Tiles beside them that no read may open.
    for z, x, y in tiles:
        for a, b in ((x - 5, y), (x + 5, y), (x, y + 5)):
            beside = tmp_path / "tiles?api=secret" / str(z) / str(a)
            beside.mkdir(exist_ok=True)
            (beside / f"{b}.png").write_bytes(b"no image")
    return axes, tiles, path


def test_only_needed_tiles_are_opened(spark, store):
    axes, tiles, path = store
    pixels = dem.needed_pixels(axes, path)
    assert pixels.count() == len(tiles) * 65536
    zoom = tiles[0][0]
    box = dem.box_pixels(spark, path, zoom, BOX)
    assert box.rdd.getNumPartitions() == len(tiles)
    assert sorted(map(tuple, box.filter("elev <> 0").collect())) == sorted(map(tuple, pixels.filter("elev <> 0").collect()))
    assert pixels.filter("elev <> 0").count() == 5 * len(tiles)


def test_a_missing_tile_ends_the_read(spark, store, tmp_path):
    axes, tiles, path = store
    z, x, y = tiles[0]
    (tmp_path / "tiles?api=secret" / str(z) / str(x) / f"{y}.png").unlink()
    for read in (dem.needed_pixels(axes, path), dem.box_pixels(spark, path, z, BOX)):
        with pytest.raises(Exception, match=r"REDACTED") as error:
            read.count()
        assert "secret" not in str(error.value).replace("spark", "")


@pytest.mark.parametrize("kinds", [(0, 1, 2), (4, 3, 0, 1, 2, 4, 3)])
def test_mixed_filters(kinds):
    rng = np.random.default_rng(3)
    kinds = np.array([kinds[k % len(kinds)] for k in range(20)])
    lines = rng.integers(0, 256, (20, 9, 3)).astype(np.int32)
    out = np.zeros((21, 10, 3), int)
    for r in range(20):
        for c in range(9):
            a, b, e = out[r + 1, c], out[r, c + 1], out[r, c]
            p = a + b - e
            nearest = [min(((abs(int(p[k]) - int(v)), n, int(v)) for n, v in enumerate((a[k], b[k], e[k]))))[2] for k in range(3)]
            guess = [np.zeros(3, int), a, b, (a + b) // 2, np.array(nearest)][kinds[r]]
            out[r + 1, c + 1] = (lines[r, c] + guess) & 255
    assert (dem._unfiltered(kinds, lines) == out[1:, 1:]).all()
    rgb = rng.integers(0, 256, (5, 6, 3))
    assert (dem.decode_png(dem.encode_png(rgb.astype(np.uint8))) == rgb).all()
