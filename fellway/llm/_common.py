"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a Python worker at once; whole texts can be long, so few.
ARROW_ROWS = 1000


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch can hold: texts may be far longer than usual."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Read from ``spark.checkpoint.dir``; a local folder is used only in local mode
    where the setting is absent (tests), and elsewhere its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it back.

    The files survive lost executors, and later passes read only the columns
    they need.
    """
    spark = session(df)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: str = "text"):
    """UTF-8 length of a text, 0 for null."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


class Generations(dict):
    """A bounded cache: the newest two generations of entries are kept.

    ``self[key]`` computes a missing entry with ``make``; once ``limit`` entries
    have been added the older generation is let go, so memory stays bounded and
    frequent keys survive.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self._make, self._limit, self._old = make, limit, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value
