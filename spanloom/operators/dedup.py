"""Duplicates, merges and set operations on tables of scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_best(df: DataFrame, keys: list[str], score: str, tie: str, ascending: bool = False) -> DataFrame:
    """The row with the best score of each key; ties by ``tie``, nulls last."""
    order = F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last()
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie))).filter("_r = 1").drop("_r")


def label_of(label: str, how: str, tie: str = "zero") -> Column:
    """The label of duplicates: any, proportion, or consensus with ties to zero, half or one."""
    share = F.avg(F.col(label).cast("double"))
    if how == "any":
        return F.max(F.col(label).cast("double"))
    if how == "proportion":
        return share
    return F.when(share > 0.5, 1.0).when(share < 0.5, 0.0).otherwise({"zero": 0.0, "half": 0.5, "one": 1.0}[tie])


def merged_duplicates(df: DataFrame, keys: list[str], label: str, scores: list[str], how: str = "any", score: str = "min", tie: str = "zero") -> DataFrame:
    agg = {"min": F.min, "max": F.max, "mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5))}[score]
    return df.groupBy(*keys).agg(label_of(label, how, tie).alias(label), *[agg(c).alias(c) for c in scores])


def outer_merge(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of tables with one row a key each; raises where keys repeat."""
    for t in tables:
        if not t.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError("keys repeat")
    return reduce(lambda a, b: a.join(b, keys, "outer"), tables)


def left_merge(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that keeps the number of rows: the right side's keys must be unique."""
    if not right.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError("keys repeat")
    return left.join(right, keys, "left")


def replaced_column(left: DataFrame, right: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``left`` with ``column`` taken from ``right``, dropped first if it is there."""
    return left_merge(left.drop(column), right.select(*keys, column), keys)


def distinct_union(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables).distinct()


def missing(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present.select(*keys).distinct(), keys, "left_anti")


def validated(links: DataFrame, known: DataFrame, key: str, shown: int = 5) -> DataFrame:
    """``links``; raises with up to ``shown`` unknown keys."""
    bad = [r[key] for r in links.select(key).distinct().join(known.select(key).distinct(), key, "left_anti").orderBy(key).limit(shown).collect()]
    if bad:
        raise ValueError(f"unknown {key}: {bad}")
    return links


def jaccard_matrix(pairs: DataFrame) -> DataFrame:
    """(a, b, n) of set overlaps, with sizes on the diagonal, as a, b, jaccard."""
    size = pairs.filter("a = b").select(F.col("a").alias("_k"), F.col("n").alias("_n"))
    both = pairs.join(size.toDF("a", "_na"), "a").join(size.toDF("b", "_nb"), "b")
    return both.select("a", "b", F.try_divide(F.col("n").cast("double"), F.col("_na") + F.col("_nb") - F.col("n")).alias("jaccard"))
