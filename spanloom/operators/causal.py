"""Counts of points in intervals by cumulative counts, and the enrichment of causal variants by gene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import clean
from ..sources.shared import stored
from .metrics import running


def counts_between(intervals: DataFrame, points: DataFrame, key: str, chrom: str = "chrom", start: str = "start", end: str = "end", point_chrom: str = "chrom", position: str = "pos") -> DataFrame:
    """key, n_points: how many points lie from ``start`` to ``end``, both included, whole numbers.

    The count is the number of points up to the end less that before the start, so no point meets an
    interval. Both come from one running count over points and ends, made by ranges of positions.
    Intervals with null places have null; ends before starts make 0.
    """
    p = points.select(F.col(point_chrom).alias("_c"), F.col(position).cast("long").alias("_p"), F.lit(1).alias("_n"))
    ends = intervals.select(F.col(chrom).alias("_c"), F.explode(F.array(F.col(start).cast("long") - 1, F.col(end).cast("long"))).alias("_p")).withColumn("_n", F.lit(0))
    levels = stored(p.unionByName(ends).filter("_c is not null and _p is not null").groupBy("_c", "_p").agg(F.sum("_n").alias("_n")), "positions")
    upto = stored(running(levels, "_p", "_p", True, ["_c"], {"_k": F.col("_n")}).select("_c", "_p", "_k"), "positions-upto")
    i = intervals.select(F.col(key), F.col(chrom).alias("_ic"), (F.col(start).cast("long") - 1).alias("_before"), F.col(end).cast("long").alias("_last"))
    low, high = upto.toDF("_lc", "_lp", "_low"), upto.toDF("_hc", "_hp", "_high")
    met = i.join(low, (F.col("_ic") == F.col("_lc")) & (F.col("_before") == F.col("_lp")), "left").join(high, (F.col("_ic") == F.col("_hc")) & (F.col("_last") == F.col("_hp")), "left")
    n = F.col("_high") - F.col("_low")
    return met.select(key, F.when(n < 0, 0).otherwise(n).cast("long").alias("n_points"))


def top_rows(df: DataFrame, score: str, key: str, top: int) -> Column:
    """Whether a row is among the ``top`` smallest scores, ties by key, rows without a score last: a condition for :func:`chosen`."""
    last = df.select(F.coalesce(clean(F.col(score).cast("double")), F.lit(float("inf"))).alias("_s"), F.col(key).alias("_k")).orderBy("_s", "_k").limit(top).agg(F.max(F.struct("_s", "_k"))).first()[0]
    if last is None:
        return F.lit(False)
    s = F.coalesce(clean(F.col(score).cast("double")), F.lit(float("inf")))
    return (s < last["_s"]) | ((s == last["_s"]) & (F.col(key) <= last["_k"]))


def causal_enrichment(causal: DataFrame, common: DataFrame, annotated: DataFrame, reference: DataFrame, variants: DataFrame, windows: DataFrame, score: str, threshold: float | int, key: str = "id") -> DataFrame:
    """gene, pip_annotated, n_annotated, pip_total, n_window, enrichment: a row for each gene that is both annotated and in the reference.

    ``causal``: key, eqtl_gene, annotated_gene, probability, score: causal variants in annotated
    places. ``common``: annotated_gene, a row for each common variant in an annotated place.
    ``annotated``: gene. ``reference``: gene, probability. ``variants``: chrom, pos. ``windows``:
    gene, chrom, start, end. A whole ``threshold`` of 1 or more takes that many rows of the smallest
    scores, any other those under it.

    The enrichment is (pip_annotated / n_annotated) / (pip_total / n_window); it is 0 without any
    probability or common variant, and null, which keeps the gene out of means, where the window is
    empty or unknown.
    """
    genes = annotated.select(F.col("gene").cast("string").alias("gene")).join(reference.select(F.col("gene").cast("string").alias("gene")), "gene", "left_semi").distinct()
    total = reference.groupBy(F.col("gene").cast("string").alias("gene")).agg(F.sum("probability").alias("pip_total"))
    chosen = top_rows(causal, score, key, threshold) if isinstance(threshold, int) and threshold >= 1 else F.col(score) < threshold
    linked = causal.filter(chosen & (F.col("eqtl_gene").cast("string") == F.col("annotated_gene").cast("string"))).groupBy(F.col("eqtl_gene").cast("string").alias("gene")).agg(F.sum("probability").alias("pip_annotated"))
    near = common.groupBy(F.col("annotated_gene").cast("string").alias("gene")).agg(F.count("*").alias("n_annotated"))
    places = windows.withColumn("gene", F.col("gene").cast("string")).join(genes, "gene", "left_semi").dropDuplicates(["gene"])
    window = counts_between(places, variants, "gene").withColumnRenamed("n_points", "n_window")
    out = genes.join(linked, "gene", "left").join(near, "gene", "left").join(total, "gene", "left").join(window, "gene", "left").na.fill(0)
    share = F.try_divide(F.col("pip_annotated") / F.col("n_annotated"), F.col("pip_total") / F.col("n_window"))
    value = F.when((F.col("pip_total") == 0) | (F.col("n_annotated") == 0), 0.0).when(F.col("n_window") > 0, share)
    return out.select("gene", "pip_annotated", "n_annotated", "pip_total", "n_window", value.alias("enrichment"))
