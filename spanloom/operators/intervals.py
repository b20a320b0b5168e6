"""Joins of half-open intervals.

Spark joins intervals by their chromosome alone and then compares all pairs, so intervals are cut
into bins of a fixed width first and joined by (chromosome, bin). A pair that shares several bins
is kept in the first of them only, so no duplicates have to be removed. Wide intervals cost one
row a bin; ``bin_width`` should be near the typical width of an interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bins(df: DataFrame, tag: str, chrom: str, start: str, end: str, width: int) -> DataFrame:
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    return df.filter(F.col(end) > F.col(start)).withColumns({f"_{tag}first": first}).withColumn(f"_{tag}bin", F.explode(F.sequence(first, last))).withColumn(f"_{tag}chrom", F.col(chrom))


def overlap_join(left: DataFrame, right: DataFrame, bin_width: int, left_cols: tuple[str, str, str] = ("chrom", "start", "end"), right_cols: tuple[str, str, str] = ("r_chrom", "r_start", "r_end"), min_left_fraction: float = 0.0, reciprocal: bool = False) -> DataFrame:
    """All pairs that overlap, with the columns of both and ``overlap``, the bases that they share.

    Column names of the sides must differ. ``min_left_fraction``: least share of the left interval
    that is covered; ``reciprocal`` asks the same of the right one. Empty intervals and null places
    join nothing.
    """
    a, b = _bins(left, "a", *left_cols, bin_width), _bins(right, "b", *right_cols, bin_width)
    (_, s, e), (_, rs, re) = left_cols, right_cols
    shared = F.least(e, re) - F.greatest(s, rs)
    pairs = a.join(b, (F.col("_achrom") == F.col("_bchrom")) & (F.col("_abin") == F.col("_bbin")) & (F.col(s) < F.col(re)) & (F.col(rs) < F.col(e)) & (F.col("_abin") == F.greatest("_afirst", "_bfirst")))
    pairs = pairs.withColumn("overlap", shared).drop("_afirst", "_abin", "_achrom", "_bfirst", "_bbin", "_bchrom")
    if min_left_fraction:
        pairs = pairs.filter(F.col("overlap") >= min_left_fraction * (F.col(e) - F.col(s)))
        if reciprocal:
            pairs = pairs.filter(F.col("overlap") >= min_left_fraction * (F.col(re) - F.col(rs)))
    return pairs


def window_links(peaks: DataFrame, genes: DataFrame, distance: int, bin_width: int) -> DataFrame:
    """Candidate links: peaks that overlap a gene body widened by ``distance`` on both sides, not below 0.

    ``peaks``: peak_id, chrom, start, end. ``genes``: gene_id, g_chrom, g_start, g_end. The result has
    peak_id, gene_id and overlap.
    """
    wide = genes.select("gene_id", "g_chrom", F.greatest(F.col("g_start") - distance, F.lit(0)).alias("w_start"), (F.col("g_end") + distance).alias("w_end"))
    return overlap_join(peaks, wide, bin_width, right_cols=("g_chrom", "w_start", "w_end")).select("peak_id", "gene_id", "overlap")


def overlap_flag(left: DataFrame, right: DataFrame, key: str, bin_width: int, **cols: tuple[str, str, str]) -> DataFrame:
    """``left`` with ``flag``: whether any interval of ``right`` overlaps (semi join)."""
    hit = overlap_join(left, right, bin_width, **cols).select(F.col(key).alias("_hit")).distinct()
    return left.join(hit, F.col(key) == F.col("_hit"), "left").withColumn("flag", F.col("_hit").isNotNull().cast("int")).drop("_hit")


def overlap_count(left: DataFrame, right: DataFrame, key: str, bin_width: int, **cols: tuple[str, str, str]) -> DataFrame:
    """``left`` with ``n_overlaps``, 0 where nothing overlaps (left outer join and count)."""
    n = overlap_join(left, right, bin_width, **cols).groupBy(F.col(key).alias("_hit")).agg(F.count("*").alias("n_overlaps"))
    return left.join(n, F.col(key) == F.col("_hit"), "left").withColumn("n_overlaps", F.coalesce("n_overlaps", F.lit(0)).cast("long")).drop("_hit")


def gap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Bases between two intervals, negative where they overlap."""
    return F.greatest(other_start - end, start - other_end)


def signed_distance(start: Column, end: Column, point: Column) -> Column:
    """How far an interval lies from a point: negative before it, positive behind it, 0 over it."""
    return F.when(end < point, end - point).when(start > point, start - point).otherwise(F.lit(0))


def activity(counts: DataFrame, peaks: DataFrame, genes: DataFrame, upstream: int, bin_width: int) -> DataFrame:
    """Gene activity: cell_id, gene_id, value, the counts of peaks that overlap a gene body from ``upstream`` before its start."""
    body = genes.select("gene_id", "g_chrom", F.greatest(F.col("g_start") - upstream, F.lit(0)).alias("w_start"), F.col("g_end").alias("w_end"))
    hits = overlap_join(peaks, body, bin_width, right_cols=("g_chrom", "w_start", "w_end")).select("peak_id", "gene_id")
    return counts.join(hits, counts["feature_id"] == hits["peak_id"]).groupBy("cell_id", "gene_id").agg(F.sum("value").alias("value"))
