"""Place search after fetching: region, labels, duplicates, the first few."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import places
from .layers import first_rows


def with_labels(features: DataFrame) -> DataFrame:
    return features.withColumns({"label": places.primary_label(), "detail": places.secondary_label(), "kind_label": places.kind_label(), "zoom": places.zoom_for_place(), "place_key": places.place_key()})


def search_results(features: DataFrame, shown: int = C.SHOWN, fetched: int = C.FETCHED) -> DataFrame:
    """The first distinct places of each query (query, src_rank, properties), in source order."""
    found = first_rows(features.filter(F.length("query") >= C.MIN_CHARS), ["query"], "src_rank", fetched)
    kept = with_labels(found.filter(places.in_region())).filter(F.col("label") != "")
    unique = first_rows(kept, ["query", "place_key"], "src_rank")
    return first_rows(unique, ["query"], "src_rank", shown)


def debounced(keys: DataFrame, gap_ms: int = C.DEBOUNCE_MS) -> DataFrame:
    """Inputs (session, ts) that no other input of the session follows within the gap."""
    nxt = F.lead("ts").over(Window.partitionBy("session").orderBy("ts", "event_id"))
    wait = (F.unix_micros(nxt) - F.unix_micros("ts")) / 1000
    return keys.withColumn("_wait", wait).filter(F.col("_wait").isNull() | (F.col("_wait") > gap_ms)).drop("_wait")
