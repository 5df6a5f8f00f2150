"""Counts that are observed while a job runs, without a pass of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame, and what will have counted its rows once an action has run over it."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("n")), seen


def observed_counts(frames: dict[str, DataFrame]) -> dict[str, int]:
    """Runs every frame to its end, writing nothing, and returns the rows that were observed."""
    out = {}
    for name, df in frames.items():
        watched, seen = observed(df, name)
        watched.write.format("noop").mode("overwrite").save()
        out[name] = seen.get["n"]
    return out
