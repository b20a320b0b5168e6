"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all ends of ``edges`` (columns a and b).

    Large and small stars take turns until nothing changes, which takes a number of rounds that
    grows with the logarithm of the longest path. Every step is a minimum by node and a join, so
    no neighbourhood is ever collected, and each round's edges are written to the shared folder.
    Null ends and loops are left out.
    """
    e = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    e = stored(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    n = e.count()
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_rows")).withColumn("m", F.least("a", "m"))
        e = by_key(both, least, ["a"], total=2 * n).filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()  # large star: larger neighbours to the least
        least = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_rows"))
        near = by_key(e, least, ["a"], total=2 * n)
        e = stored(near.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct(), "edges")  # small star: the node and its smaller neighbours to the least
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 31)), F.lit(0))).first()
        if now == mark:
            break
        mark, n = now, now[0]
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(e.select("b", F.col("b")).distinct())
