"""Place features: the region test, labels, keys and zooms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .text import fixed

# The zoom to settle on by kind of place.
ZOOM_BY_KIND = {
    "country": 5, "state": 6, "region": 6, "county": 8, "island": 9, "archipelago": 8,
    "city": 11, "borough": 12, "town": 12, "village": 13, "hamlet": 14,
    "suburb": 13, "neighbourhood": 14, "quarter": 14, "locality": 14,
    "farm": 14, "isolated_dwelling": 15,
    "national_park": 9, "protected_area": 10, "nature_reserve": 11, "forest": 10,
    "peak": 13, "volcano": 13, "ridge": 12, "valley": 12, "glacier": 12, "saddle": 14,
    "lake": 11, "bay": 11, "river": 10, "stream": 12, "beach": 13, "cape": 13,
    "hut": 15, "alpine_hut": 15, "wilderness_hut": 15, "camp_site": 15,
    "trailhead": 15, "viewpoint": 15, "parking": 16, "information": 15,
}


def said(name: str) -> Column:
    """A property, null if missing or empty."""
    return F.nullif(F.col(name), F.lit(""))


def in_region(code: str = "countrycode", lon: str = "lon", lat: str = "lat") -> Column:
    """By country code where there is one, else by a box that is split at the antimeridian."""
    lon, lat = F.col(lon), F.col(lat)
    inside = (lat <= -33.0) & (lat >= -52.7) & (((lon >= 165.5) & (lon <= 180)) | ((lon >= -180) & (lon <= -175.0)))
    return F.when(said(code).isNotNull(), F.upper(F.col(code)) == "NZ").otherwise(F.coalesce(inside, F.lit(False)))


def street_line() -> Column:
    return F.when(said("street").isNotNull(), F.concat_ws(" ", said("housenumber"), said("street")))


def primary_label() -> Column:
    return F.coalesce(said("name"), street_line(), said("city"), said("county"), said("state"), F.lit(""))


def secondary_label() -> Column:
    """Street (of named places), district, city, county, state: the first three different from the name."""
    name = said("name")
    street = F.when(name.isNotNull(), street_line())
    rest = F.filter(F.array(*map(said, ("district", "city", "county", "state"))), lambda v: v.isNotNull() & ~v.eqNullSafe(name))
    parts = F.array_distinct(F.concat(F.array_compact(F.array(street)), rest))
    return F.array_join(F.slice(parts, 1, 3), ", ")


def kind() -> Column:
    return F.coalesce(said("osm_value"), said("osm_key"))


def kind_label() -> Column:
    return F.when(kind().isNull() | (kind() == "yes"), F.lit("")).otherwise(F.replace(kind(), F.lit("_"), F.lit(" ")))


def zoom_for_place() -> Column:
    table = F.create_map(*[F.lit(x) for pair in ZOOM_BY_KIND.items() for x in pair])
    return (
        F.when(said("housenumber").isNotNull(), F.lit(C.HOUSE_ZOOM))
        .when(said("street").isNotNull(), F.lit(C.STREET_ZOOM))
        .otherwise(F.coalesce(F.try_element_at(table, F.coalesce(kind(), F.lit(""))), F.lit(C.DEFAULT_ZOOM)))
    )


def place_key() -> Column:
    return F.concat(primary_label(), F.lit("|"), fixed("lon", 4), F.lit(","), fixed("lat", 4))


def query_key(query: str = "query") -> Column:
    return F.lower(F.trim(F.col(query)))
