"""Sparse count matrices in long form: (cell_id, feature_id, value), zeros left out.

Every mean and variance counts the zeros: it divides by the number of all cells, which is passed in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feature_moments(counts: DataFrame, n_cells: int) -> DataFrame:
    """feature_id, nnz, total, mean, var (population), log_total."""
    m = F.sum("value") / n_cells
    return counts.groupBy("feature_id").agg(F.count_if(F.col("value") != 0).alias("nnz"), F.sum("value").alias("total"), m.alias("mean"), (F.sum(F.col("value") * F.col("value")) / n_cells - m * m).alias("var"), F.log10(F.sum("value") + 1e-10).alias("log_total"))


def group_sums(counts: DataFrame, cells: DataFrame, group: str) -> DataFrame:
    """Pseudobulk: sums by group of cells and feature."""
    return counts.join(cells.select("cell_id", group), "cell_id").groupBy(group, "feature_id").agg(F.sum("value").alias("total"))


def group_moments(counts: DataFrame, cells: DataFrame, group: str, floor_mean: float = 1e-6, var_at_least_mean: bool = True) -> DataFrame:
    """group, feature_id, mean (not under ``floor_mean``) and var of each feature in each group of cells."""
    sizes = cells.groupBy(group).agg(F.count("*").alias("_n"))
    sums = counts.join(cells.select("cell_id", group), "cell_id").groupBy(group, "feature_id").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"))
    mean = F.greatest(F.col("_s") / F.col("_n"), F.lit(floor_mean))
    var = F.col("_q") / F.col("_n") - mean * mean
    return sums.join(sizes, group).select(group, "feature_id", mean.alias("mean"), (F.greatest(var, mean) if var_at_least_mean else var).alias("var"))


def group_means_wide(counts: DataFrame, cells: DataFrame, group: str, groups: list[str]) -> DataFrame:
    """One row a feature, one column a group with the mean over all its cells."""
    sizes = cells.groupBy(group).agg(F.count("*").alias("_n"))
    means = group_sums(counts, cells, group).join(sizes, group).withColumn("_mean", F.col("total") / F.col("_n"))
    wide = means.groupBy("feature_id").pivot(group, groups).agg(F.first("_mean"))
    return wide.na.fill(0.0, groups)


def sparse_enough(counts: DataFrame, n_cells: int, share: float) -> DataFrame:
    """Counts of the features that are non-zero in at least ``share`` of the cells."""
    kept = counts.groupBy("feature_id").agg((F.count_if(F.col("value") != 0) / n_cells).alias("_share")).filter(F.col("_share") >= share)
    return counts.join(kept.select("feature_id"), "feature_id", "left_semi")


def fragments(value: Column) -> Column:
    """Reads to fragments: half, rounded to the even neighbour."""
    return F.bround(value / 2).cast("int")


def quality_chain(rna: DataFrame, atac: DataFrame, n_cells: int, min_features: int, min_cells: int, min_peak_cells: int, depth: tuple[float, float], features: tuple[int, int], sparsity: float) -> tuple[DataFrame, DataFrame]:
    """The filters in their order: cells by features, features by cells, peaks by cells, cells by features and depth, sparsity, fragments, common cells."""

    def having(df: DataFrame, key: str, condition: Column) -> DataFrame:
        return df.join(df.filter("value <> 0").groupBy(key).agg(F.count("*").alias("_k"), F.sum("value").alias("_d")).filter(condition).select(key), key, "left_semi")

    rna = having(rna, "cell_id", F.col("_k") >= min_features)
    rna = having(rna, "feature_id", F.col("_k") >= min_cells)
    atac = having(atac, "feature_id", F.col("_k") >= min_peak_cells)
    atac = having(atac, "cell_id", F.col("_k").between(*features) & F.col("_d").between(*depth))
    rna, atac = sparse_enough(rna, n_cells, sparsity), sparse_enough(atac, n_cells, sparsity)
    atac = atac.withColumn("value", fragments(F.col("value")).cast("double")).filter("value <> 0")
    return rna.join(atac.select("cell_id").distinct(), "cell_id", "left_semi"), atac.join(rna.select("cell_id").distinct(), "cell_id", "left_semi")


def cell_summary(counts: DataFrame, cells: DataFrame, group: str, n_features: int) -> DataFrame:
    """Quality figures of all cells (group 'all') and of each group: n_cells, depth and detected features.

    Cells without counts count with zeros; cells without a group count in 'all' only.
    """
    per_cell = counts.groupBy("cell_id").agg(F.sum("value").alias("_depth"), F.count_if(F.col("value") != 0).alias("_seen"))
    full = cells.select("cell_id", group).join(per_cell, "cell_id", "left").na.fill(0, ["_depth", "_seen"])
    sets = full.groupingSets([[], [F.col(group)]], F.col(group)).agg(
        F.grouping_id().alias("_all"), F.count("*").alias("n_cells"), F.avg("_depth").alias("mean_depth"), F.percentile("_depth", F.lit(0.5)).alias("median_depth"),
        F.avg("_seen").alias("mean_detected"), (F.avg("_seen") / n_features).alias("detect_rate"), (1 - F.avg("_seen") / n_features).alias("sparsity"),
    )
    return sets.filter((F.col("_all") == 1) | F.col(group).isNotNull()).withColumn("cell_group", F.when(F.col("_all") == 1, "all").otherwise(F.col(group))).drop("_all", group)


def top_share(counts: DataFrame, n_cells: int, fraction: float) -> DataFrame:
    """One row: the share of all signal in the top ``fraction`` of the features, at least one, by mean."""
    means = counts.groupBy("feature_id").agg((F.sum("value") / n_cells).alias("_m"))  # one row a feature
    ranked = means.withColumns({"_r": F.row_number().over(Window.orderBy(F.desc("_m"), "feature_id")), "_n": F.count("*").over(Window.partitionBy(F.lit(1)))})
    k = F.greatest(F.lit(1), F.ceil(F.col("_n") * fraction))
    return ranked.agg(F.count_if(F.col("_r") <= k).alias("n_top"), F.try_divide(F.sum(F.when(F.col("_r") <= k, F.col("_m"))), F.sum("_m")).alias("top_share"))


def normalised(counts: DataFrame) -> DataFrame:
    """Counts scaled to the median depth of the cells, then log1p."""
    depth = counts.groupBy("cell_id").agg(F.sum("value").alias("_d"))
    median = depth.agg(F.percentile("_d", F.lit(0.5))).first()[0]
    return counts.join(depth, "cell_id").withColumn("value", F.log1p(F.col("value") * F.lit(median) / F.col("_d"))).drop("_d")
