"""How specific a feature is to one group: one minus its entropy over the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entropy_specificity(values: Column, eps: float = 1e-6, min_total: float = 0.0) -> Column:
    """1 - H / ln k of an array of values, negative ones as 0, each raised by ``eps``; null where the sum is under ``min_total``."""
    x = F.transform(values, lambda v: F.greatest(v, F.lit(0.0)))
    raised = F.transform(x, lambda v: v + eps)
    total = F.aggregate(raised, F.lit(0.0), lambda s, v: s + v)
    h = F.aggregate(raised, F.lit(0.0), lambda s, v: s - v / total * F.log(v / total))
    plain = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(values) > 1) & (plain >= min_total), 1 - h / F.log(F.size(values).cast("double")))


def joint_specificity(first: Column, second: Column, eps: float = 1e-6) -> Column:
    """Specificity of the products of two arrays of the same groups."""
    return entropy_specificity(F.zip_with(first, second, lambda a, b: F.greatest(a, F.lit(0.0)) * F.greatest(b, F.lit(0.0))), eps)


def probability_specificity(values: Column, eps: float = 1e-12) -> Column:
    """The same for probabilities, with 0 log 0 = 0; null for one group, a sum of 0 or negative values."""
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    h = F.aggregate(values, F.lit(0.0), lambda s, v: s - F.when(v > 0, v / total * F.log(F.when(v > 0, v) / total)).otherwise(0.0))
    return F.when((F.size(values) > 1) & (total > eps) & ~F.exists(values, lambda v: v < 0), 1 - h / F.log(F.size(values).cast("double")))


def by_group(means: DataFrame, feature: str, group: str, value: str, n_groups: int, eps: float = 1e-6) -> DataFrame:
    """feature, specificity and dominant group (the first by name of equal ones) from long group means; absent groups are 0."""
    own = Window.partitionBy(feature).orderBy(F.desc(value), group)
    packed = means.withColumn("_r", F.row_number().over(own)).groupBy(feature).agg(F.collect_list(F.col(value).cast("double")).alias("_v"), F.max(F.when(F.col("_r") == 1, F.col(group))).alias("dominant"))
    full = F.concat("_v", F.array_repeat(F.lit(0.0), F.greatest(F.lit(n_groups) - F.size("_v"), F.lit(0))))
    return packed.select(feature, entropy_specificity(full, eps).alias("specificity"), "dominant")


def attach_pairs(links: DataFrame, peak_spec: DataFrame, gene_spec: DataFrame) -> DataFrame:
    """Links (peak_id, gene_id) with the specificities of both sides, the smaller, their geometric mean, and whether dominant groups agree."""
    p = peak_spec.select(F.col("feature_id").alias("peak_id"), F.col("specificity").alias("peak_specificity"), F.col("dominant").alias("peak_dominant"))
    g = gene_spec.select(F.col("feature_id").alias("gene_id"), F.col("specificity").alias("gene_specificity"), F.col("dominant").alias("gene_dominant"))
    out = links.join(p, "peak_id", "left").join(g, "gene_id", "left")
    return out.withColumns({"min_specificity": F.least("peak_specificity", "gene_specificity"), "mean_specificity": F.sqrt(F.col("peak_specificity") * F.col("gene_specificity")), "concordant": F.col("peak_dominant") == F.col("gene_dominant")})


def one_per_key(df: DataFrame, keys: list[str], value: str, policy: str, order: str) -> DataFrame:
    """Duplicates of a key by ``policy``: 'first' (by ``order``), 'mean', or 'error'."""
    if policy == "mean":
        return df.groupBy(*keys).agg(F.avg(value).alias(value))
    if policy == "first":
        return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_r = 1").select(*keys, value)
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError("keys repeat")
    return df.select(*keys, value)
