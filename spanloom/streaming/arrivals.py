"""Files that keep arriving in a table's folder, taken once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def arriving(spark: SparkSession, path: str, files_at_a_time: int = 1000) -> DataFrame:
    """A stream of the Parquet files at ``path``, with the schema that they have now.

    ``path`` may be a folder or one file. It goes to Spark as a pattern, since the plain path of a
    file stream must be a folder.
    """
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).parquet(f"{parent}/{{{name}}}")


def append_new(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Appends all that the checkpoint hasn't seen to a Parquet table, waits for the end, and returns how many rows were read.

    Spark's file sink and checkpoint make each row stand once, also when a run breaks and is started again.
    """
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p.numInputRows for p in query.recentProgress)
