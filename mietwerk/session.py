"""Session settings the library is designed for; all can be overridden by the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "mietwerk", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=SETTINGS | settings).getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share; only a session on this machine alone may lack it."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(place or 'file:///tmp/mietwerk-checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def by_shuffle(df: DataFrame) -> DataFrame:
    """For joins with a table of as many rows as the input.

    Spark takes tables for as small as their Parquet files, and for smaller yet if few columns are read; packed
    columns of millions of rows would be broadcast, which means gathered by the driver.
    """
    return df.hint("merge")


def counted(df: DataFrame, *conditions: str, name: str = "table") -> tuple[DataFrame, list[int]]:
    """The table written as by `written`, and how many of its rows meet each condition, told while they are written."""
    told = Observation()
    marked = df.observe(told, *[F.count_if(F.expr(c)).alias(f"n{i}") for i, c in enumerate(conditions)])
    out = written(marked, name)
    return out, [told.get[f"n{i}"] for i in range(len(conditions))]


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The table written to a shared folder and read again, so that what follows doesn't compute it once more."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
