"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bed(df: DataFrame, path: str, columns: list[str]) -> None:
    """BED without header; columns in the given order."""
    df.select(*columns).write.mode("overwrite").option("sep", "\t").option("header", False).csv(path)


def table(df: DataFrame, path: str, separator: str = "\t") -> None:
    df.write.mode("overwrite").option("sep", separator).option("header", True).csv(path)


def partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Parquet by partition; a second run replaces the partitions that it writes and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def with_matrix_entry(matrix: DataFrame, entries: DataFrame) -> DataFrame:
    """A long square matrix (a, b, metric, value) with entries added or replaced."""
    keys = ["a", "b", "metric"]
    return matrix.join(entries.select(*keys), keys, "left_anti").unionByName(entries)


def square(matrix: DataFrame, metric: str, names: list[str]) -> DataFrame:
    """One metric of a long matrix as a square table."""
    return matrix.filter(F.col("metric") == metric).groupBy("a").pivot("b", names).agg(F.first("value"))
