"""Scalar functions against values worked out by hand."""

import math

from pyspark.sql import functions as F

from fellway.functions import geo, places, text


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_raster_functions(spark):
    r = one(
        spark,
        sea=geo.decode_elevation(F.lit(1), F.lit(134), F.lit(160)),
        fine=geo.zoom_for(F.lit(1.0), F.lit(-41.0)),
        coarse=geo.zoom_for(F.lit(5000.0), F.lit(-41.0)),
        middle=geo.zoom_for(F.lit(10.0), F.lit(-41.0)),
        x=geo.tile_of(F.lit(0.0), F.lit(0.0), F.lit(1))[0],
        y=geo.tile_of(F.lit(174.0), F.lit(-41.0), F.lit(10))[1],
    )
    assert abs(r.sea) < 1e-9 and (r.fine, r.coarse, r.x) == (15, 10, 1)
    assert 156543.03392 * math.cos(math.radians(41)) / 2**r.middle <= 10 < 156543.03392 * math.cos(math.radians(41)) / 2 ** (r.middle - 1)
    lat = math.radians(-41.0)
    assert r.y == int((1 - math.log(math.tan(lat) + 1 / math.cos(lat)) / math.pi) / 2 * 1024)


def test_distances_and_speed(spark):
    r = one(spark, km=geo.haversine_km(F.lit(174.0), F.lit(-41.0), F.lit(174.0), F.lit(-42.0)), none=geo.haversine_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)), top=geo.walking_kmh(F.lit(-0.05)), flat=geo.walking_kmh(F.lit(0.0)))
    assert abs(r.km - 6371 * math.radians(1)) < 1e-9 and r.none is None
    assert r.top == 6.0 and abs(r.flat - 6 * math.exp(-0.2)) < 1e-12


def test_boxes_and_cells(spark):
    points = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((174.0, -41.0), (174.1, -41.5))])
    box = geo.padded_bbox(points, 0.3)
    r = one(spark, b=box, tiny=geo.padded_bbox(F.slice(points, 1, 1), 0.3), cell=geo.cell_size_m(box, F.lit(100_000)), none=geo.cell_size_m(F.struct(*[F.lit(1.0).alias(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")])))
    assert [round(v, 6) for v in r.b] == [-41.65, 173.97, -40.85, 174.13]
    assert [round(v, 6) for v in r.tiny] == [-41.01, 173.99, -40.99, 174.01]
    assert 100 < r.cell < 1000 and r.none == 10.0


def test_messages(spark):
    leg = "Leg 2 ((1.0, 2.0) -> (3.0, 4.0)) failed: No path\nfound"
    r = one(
        spark,
        leg=text.friendly_error(F.lit(leg), F.lit(3)),
        other=text.friendly_error(F.lit("Legless"), F.lit(3)),
        none=text.friendly_error(F.lit(None).cast("string"), F.lit(3)),
        keys=text.redact_keys(F.lit("a?api=k1&x=1 b&api=k'2 api=left")),
        time=text.duration(F.lit(1.9999)),
        place=text.coordinates(F.lit(174.12345), F.lit(-41.5)),
        origin=text.allowed_origin(F.lit("https://b"), ["https://a", "https://b"]),
        unknown=text.allowed_origin(F.lit("x"), ["https://a"]),
        anyone=text.allowed_origin(F.lit("x"), []),
        heads=text.lower_keys(F.create_map(F.lit("Content-Type"), F.lit("a"))),
    )
    assert r.leg == "Waypoint 1 → End failed: No path\nfound" and r.other == "Legless" and r.none is None
    assert r["keys"] == "a?api=***REDACTED***&x=1 b&api=***REDACTED***'2 api=left"
    assert r.time == "1h 60m" and r.place == "-41.5000°, 174.1235°"
    assert (r.origin, r.unknown, r.anyone, r.heads) == ("https://b", "https://a", "*", {"content-type": "a"})


def test_urls(spark):
    r = one(
        spark,
        plain=text.proxy_path(F.lit("/x/proxy/a/b c%2Fd+e/proxy/z")),
        none=text.proxy_path(F.lit("/x/y")),
        url=text.proxy_url("https://t", F.lit("/proxy/a"), F.lit("q=1"), F.lit("k y")),
        bare=text.proxy_url("https://t", F.lit("/proxy/a"), F.lit(None).cast("string"), F.lit("k")),
        moved=text.rewrite_tile_url(F.lit("https://t/v1/tiles/1.png&pipeline=rgb&api=s"), "https://t", "https://own"),
        kept=text.rewrite_tile_url(F.lit("https://other/1.png&pipeline=rgb"), "https://t", "https://own"),
        bodies=text.strip_key(F.lit("u?api=k y&v&api=k%20y"), F.lit("k y")),
    )
    assert r.plain == "a/b%20c/d%2Be/proxy/z" and r.none is None
    assert r.url == "https://t/a?q=1&api=k%20y" and r.bare == "https://t/a?api=k"
    assert r.moved == "https://own/proxy/tiles/1.png?pipeline=rgb" and r.kept == "https://other/1.png&pipeline=rgb"
    assert r.bodies == "u&v"


def test_places(spark):
    fields = "name street housenumber city county state district countrycode osm_key osm_value".split()
    rows = [
        {"name": "Hut", "street": "Road", "housenumber": "5", "district": "Hut", "city": "Town", "county": "Town", "state": "S", "osm_value": "alpine_hut", "lon": 170.0, "lat": -43.0},
        {"name": "", "street": "Road", "housenumber": "", "countrycode": "nz", "osm_value": "yes", "lon": 0.0, "lat": 0.0},
        {"city": "", "state": "S", "countrycode": "AU", "osm_key": "natural", "osm_value": "", "lon": 170.0, "lat": -43.0},
        {"name": "Isles", "lon": -176.5, "lat": -44.0, "osm_value": "island"},
        {"name": "Sea", "lon": None, "lat": -44.0},
    ]
    frame = spark.createDataFrame([tuple(r.get(f) for f in [*fields, "lon", "lat"]) for r in rows], ", ".join(f"{f} string" for f in fields) + ", lon double, lat double")
    got = frame.select(places.in_region(), places.primary_label(), places.secondary_label(), places.kind_label(), places.zoom_for_place()).collect()
    assert [tuple(r) for r in got] == [
        (True, "Hut", "5 Road, Town, S", "alpine hut", 17),
        (True, "Road", "", "", 16),
        (False, "S", "S", "natural", 13),
        (True, "Isles", "", "island", 9),
        (False, "Sea", "", "", 13),
    ]
