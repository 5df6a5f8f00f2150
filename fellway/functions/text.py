"""Labels, messages, redaction and URL rewriting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

# The patterns of keys in URLs and of messages about a leg.
KEY_PATTERN = r"""([?&]api=)[^&\s"']+"""
_LEG = r"(?s)^Leg (\d+) \(.+\) failed: (.+)$"


def fixed(x, digits: int) -> Column:
    """Fixed decimals; a decimal cast rounds halves up on the shortest decimal form."""
    return F.col(x).cast(f"decimal(28,{digits})").cast("string") if isinstance(x, str) else x.cast(f"decimal(28,{digits})").cast("string")


def redact_keys(text) -> Column:
    return F.regexp_replace(col(text), KEY_PATTERN, "$1***REDACTED***")


def strip_key(text, key) -> Column:
    """A response text without the key, plain or URL-encoded."""
    text, key = col(text), col(key)
    for value in (key, url_quote(key)):
        for mark in ("?api=", "&api="):
            text = F.replace(text, F.concat(F.lit(mark), value), F.lit(""))
    return text


def url_quote(text) -> Column:
    """Percent-encoding of everything but unreserved characters (and ``/`` is decided by the caller)."""
    return F.replace(F.replace(F.replace(F.url_encode(col(text)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def proxy_path(raw_path) -> Column:
    """What follows the first ``/proxy/``, decoded and encoded again; null without it."""
    raw = col(raw_path)
    at = F.instr(raw, "/proxy/")
    rest = F.when(at > 0, F.substring(raw, at + len("/proxy/"), F.length(raw)))
    # Form decoding would turn a plus into a blank.
    decoded = F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))
    return F.replace(url_quote(decoded), F.lit("%2F"), F.lit("/"))


def proxy_url(base: str, raw_path, query, key) -> Column:
    query = F.coalesce(col(query), F.lit(""))
    return F.concat(F.lit(f"{base}/"), proxy_path(raw_path), F.lit("?"), query, F.when(query != "", F.lit("&")).otherwise(F.lit("")), F.lit("api="), F.replace(url_quote(key), F.lit("%2F"), F.lit("/")))


def rewrite_tile_url(url, origin: str, proxy: str) -> Column:
    """Tile URLs of one origin go through the proxy, without their key."""
    url = col(url)
    fixed_url = F.regexp_replace(url, r"\.png&pipeline=", ".png?pipeline=")
    path = F.regexp_replace(F.parse_url(fixed_url, F.lit("PATH")), "^/v1/", "")
    parts = F.filter(F.split(F.coalesce(F.parse_url(fixed_url, F.lit("QUERY")), F.lit("")), "&"), lambda p: (p != "") & ~p.startswith("api=") & (p != "api"))
    query = F.array_join(parts, "&")
    return F.when(url.startswith(origin), F.concat(F.lit(f"{proxy}/proxy/"), F.regexp_replace(path, "^/", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))).otherwise(url)


def role(pos, n) -> Column:
    pos, n = col(pos), col(n)
    return F.when(pos == 0, F.lit("start")).when(pos == n - 1, F.lit("end")).otherwise(F.lit("via"))


def short_label(pos, n) -> Column:
    pos = col(pos)
    return F.when(pos == 0, F.lit("Start")).when(pos == col(n) - 1, F.lit("End")).otherwise(F.concat(F.lit("Waypoint "), pos.cast("string")))


def waypoint_label(pos, n) -> Column:
    pos = col(pos)
    return F.when(pos == 0, F.lit("Start point")).when(pos == col(n) - 1, F.lit("End point")).otherwise(F.concat(F.lit("Waypoint "), pos.cast("string")))


def water_error(label) -> Column:
    # Fixed value: the sentence that callers see.
    return F.concat(col(label), F.lit(" falls within a mapped water or snow/ice body — pick a point on dry land."))


def friendly_error(message, n) -> Column:
    """``Leg N (…) failed: …`` with the names of the leg's ends; other messages as they are."""
    message, n = col(message), col(n)
    leg = F.regexp_extract(message, _LEG, 1)
    at = F.when(leg != "", leg.cast("int")) - 1
    return F.when(leg == "", message).otherwise(F.concat(short_label(at, n), F.lit(" → "), short_label(at + 1, n), F.lit(" failed: "), F.regexp_extract(message, _LEG, 2)))


def coordinates(lon, lat) -> Column:
    return F.concat(fixed(lat, 4), F.lit("°, "), fixed(lon, 4), F.lit("°"))


def duration(hours) -> Column:
    """Hours and minutes; minutes round half up and may read 60."""
    hours = col(hours)
    return F.concat(F.floor(hours).cast("string"), F.lit("h "), F.floor((hours - F.floor(hours)) * 60 + 0.5).cast("string"), F.lit("m"))


def lower_keys(headers) -> Column:
    return F.transform_keys(col(headers), lambda k, v: F.lower(k))


def allowed_origin(origin, allowed: list[str]) -> Column:
    """The caller's origin if it is allowed, else the first allowed one, else any."""
    listed = F.array(*map(F.lit, allowed)) if allowed else F.array().cast("array<string>")
    return F.when(F.array_contains(listed, col(origin)), col(origin)).otherwise(F.lit(allowed[0] if allowed else "*"))


def point_text(lat, lon) -> Column:
    """A place in degrees with five decimals, as the map shows it."""
    return F.concat(F.lit("Longitude: "), fixed(lon, 5), F.lit("° Latitude: "), fixed(lat, 5), F.lit("° "))


def distance_text(km) -> Column:
    return F.concat(fixed(km, 2), F.lit(" km"))


def climb_text(metres) -> Column:
    """Whole metres, halves up."""
    return F.concat(F.floor(col(metres) + 0.5).cast("string"), F.lit(" m"))


def drop_rank(middles, y, waypoints) -> Column:
    """The place that a dragged waypoint lands on: behind the other rows whose middle it has passed, between start and end."""
    passed = F.size(F.filter(col(middles), lambda m: m < col(y)))
    return F.greatest(F.lit(1), F.least(col(waypoints) - 2, passed + 1))
