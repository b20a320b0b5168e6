"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where a session on one machine names no ``spark.checkpoint.dir``, as in local tests.
FALLBACK = "/tmp/spanloom-shared"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a cluster it must be named, since executors would write each to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or FALLBACK


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet and read again: later plans start from the file, also after executors are lost."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
