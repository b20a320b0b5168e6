"""Curves and odds by blocks of equal scores, so that the order of ties doesn't matter.

A block is all rows of one score; everything follows from how many rows and gold rows each block
and those before it hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import clean
from ..sources.shared import stored
from .metrics import fisher_p, odds_ratio, running, with_totals

#: Normal quantile of 0.975.
Z95 = 1.959963984540054


def blocks(df: DataFrame, score: str, label: str, within: list[str] | None = None, ascending: bool = True) -> DataFrame:
    """within, score, _block_n, _block_g, _upto_n, _upto_g, _scored_n, _scored_g, _total_n, _total_g: a row for each distinct score: rows and gold.

    ``_upto``: with all blocks before. ``_total`` counts unscored rows too, whose null or NaN score is
    in no block. Rows without a label are left out; ``label`` is a boolean or a share of gold.
    """
    within = within or []
    rows = df.filter(F.col(label).isNotNull()).select(*within, clean(F.col(score).cast("double")).alias(score), F.col(label).cast("double").alias("_g"))
    levels = stored(rows.groupBy(*within, score).agg(F.count("*").alias("_block_n"), F.sum("_g").alias("_block_g")), "tie-blocks")
    total = levels.groupBy(*within).agg(F.sum("_block_n").alias("_total_n"), F.sum("_block_g").alias("_total_g"), F.coalesce(F.sum(F.when(F.col(score).isNotNull(), F.col("_block_n"))), F.lit(0)).alias("_scored_n"), F.coalesce(F.sum(F.when(F.col(score).isNotNull(), F.col("_block_g"))), F.lit(0.0)).alias("_scored_g"))
    upto = running(levels.filter(F.col(score).isNotNull()), score, score, ascending, within, {"_upto_n": F.col("_block_n"), "_upto_g": F.col("_block_g")})
    return with_totals(upto, total, within)


def curve(df: DataFrame, score: str, label: str, within: list[str] | None = None, ascending: bool = True, min_recall: float = 0.0, max_recall: float = 1.0, extrapolate: bool = False) -> DataFrame:
    """within, recall, enrichment at the end of each block, inside the recall window; of equal recalls the first block's.

    ``extrapolate`` goes on in even steps, one for each gold row without a score, to (1, 1). Groups
    without gold rows have no points.
    """
    within = within or []
    b = stored(blocks(df, score, label, within, ascending).filter("_total_g > 0"), "tie-curve")
    points = b.select(*within, (F.col("_upto_g") / F.col("_total_g")).alias("recall"), (F.col("_upto_g") / F.col("_upto_n") / (F.col("_total_g") / F.col("_total_n"))).alias("enrichment"), F.col("_upto_n").alias("_at"))
    if extrapolate:
        last = b.filter("_upto_n = _scored_n").select(*within, (F.col("_upto_g") / F.col("_total_g")).alias("_r"), (F.col("_upto_g") / F.col("_upto_n") / (F.col("_total_g") / F.col("_total_n"))).alias("_e"), F.ceil(F.col("_total_g") - F.col("_scored_g")).cast("long").alias("_k"), F.col("_total_n").alias("_at"))
        steps = last.filter("_k > 0 and _r < 1").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k"))))
        points = points.unionByName(steps.select(*within, (F.col("_r") + (1 - F.col("_r")) * F.col("_i") / F.col("_k")).alias("recall"), (F.col("_e") - (F.col("_e") - 1) * F.col("_i") / F.col("_k")).alias("enrichment"), (F.col("_at") + F.col("_i")).alias("_at")))
    inside = points.filter((F.col("recall") >= min_recall) & (F.col("recall") <= max_recall))
    return inside.groupBy(*within, "recall").agg(F.min_by("enrichment", "_at").alias("enrichment"))


def expected_tops(df: DataFrame, score: str, label: str, tops: list[int], within: list[str] | None = None, ascending: bool = True, epsilon: float = 0.5) -> DataFrame:
    """within, top, tp, precision, recall, odds_ratio, ci_lower, ci_upper: expected over all orders of ties, among scored rows.

    Of the block that ``top`` falls into, the part that is taken holds the block's share of gold.
    Tops beyond the scored rows are left out. Odds are smoothed by ``epsilon``, their interval is
    Wald's.
    """
    within = within or []
    b = blocks(df, score, label, within, ascending).withColumn("top", F.explode(F.array(*[F.lit(int(k)).cast("long") for k in tops])))
    cut = b.filter((F.col("top") > F.col("_upto_n") - F.col("_block_n")) & (F.col("top") <= F.col("_upto_n")))
    tp = F.col("_upto_g") - F.col("_block_g") + (F.col("top") - (F.col("_upto_n") - F.col("_block_n"))) * F.col("_block_g") / F.col("_block_n")
    cut = cut.withColumn("tp", tp)
    fp, fn = F.col("top") - F.col("tp"), F.col("_scored_g") - F.col("tp")
    low, high = wald(F.col("tp"), fp, fn, F.col("_scored_n") - F.col("top") - fn, epsilon)
    return cut.select(*within, "top", "tp", (F.col("tp") / F.col("top")).alias("precision"), F.try_divide(F.col("tp"), F.col("_scored_g")).alias("recall"), odds_ratio(F.col("tp"), fp, fn, F.col("_scored_n") - F.col("top") - fn, epsilon).alias("odds_ratio"), low.alias("ci_lower"), high.alias("ci_upper"))


def wald(tp: Column, fp: Column, fn: Column, tn: Column, epsilon: float = 0.5, z: float = Z95) -> tuple[Column, Column]:
    """Interval of an odds ratio, normal on the log scale, with ``epsilon`` added to each cell; null where a cell is still 0."""
    cells = [c + epsilon for c in (tp, fp, fn, tn)]
    fine = F.least(*cells) > 0
    log = F.when(fine, F.log(cells[0] * cells[3] / (cells[1] * cells[2])))
    half = z * F.sqrt(sum((1 / c for c in cells[1:]), 1 / cells[0]))
    return F.exp(log - half), F.exp(log + half)


def regime_odds(df: DataFrame, score: str, label: str, regime: list[str], top: int = 100, ascending: bool = True, epsilon: float = 0.5) -> DataFrame:
    """regime, tp, fp, fn, tn, odds_ratio, fisher_p, smoothed, ci_lower, ci_upper: gold among rows whose average rank within the regime is ``top`` at most.

    Equal scores have one rank, so a block is in the top as a whole or not at all; rows without a
    score never are. ``top`` is at most the number of rows of the regime.
    """
    b = blocks(df, score, label, regime, ascending)
    inside = (F.col("_upto_n") - F.col("_block_n") + (F.col("_block_n") + 1) / 2) <= F.least(F.lit(top), F.col("_total_n"))
    s = b.groupBy(*regime, "_total_n", "_total_g").agg(F.coalesce(F.sum(F.when(inside, F.col("_block_n"))), F.lit(0)).alias("_n"), F.coalesce(F.sum(F.when(inside, F.col("_block_g"))), F.lit(0.0)).alias("_g"))
    tp = F.col("_g").cast("long")
    s = s.select(*regime, tp.alias("tp"), (F.col("_n") - tp).alias("fp"), (F.col("_total_g").cast("long") - tp).alias("fn"), (F.col("_total_n") - F.col("_n") - (F.col("_total_g").cast("long") - tp)).alias("tn"))
    cells = [F.col(c) for c in ("tp", "fp", "fn", "tn")]
    low, high = wald(*cells, epsilon)
    return s.select("*", odds_ratio(*cells).alias("odds_ratio"), fisher_p(*cells).alias("fisher_p"), odds_ratio(*cells, epsilon).alias("smoothed"), low.alias("ci_lower"), high.alias("ci_upper"))
