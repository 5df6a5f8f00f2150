"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in local mode alone a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shuffled(df: DataFrame) -> DataFrame:
    """A table that is joined by a shuffle: its files may be few and small where its rows, once unpacked for a broadcast, are not."""
    return df.hint("merge")


#: Rows of a table that are sent whole to every task at most.
FEW_ROWS = 10_000


def met(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most so many rows, to be joined with: sent whole only if these are few."""
    return df if rows <= FEW_ROWS else shuffled(df)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: written to the shared folder and read back; the files survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
