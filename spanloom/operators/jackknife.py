"""Delete-one jackknife over blocks, and what single bins contribute.

Rows are ranked once. Of every block the sums up to each cut-off are kept, and what a block's removal
leaves is the total minus the block. Where removal also moves ranks, ranks are cut into segments:
sums by segment say in which one a cut-off falls after the removal, and only rows of that segment
are looked at again. No row is copied for the blocks that it isn't in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import clean
from ..sources.shared import stored
from .metrics import cumulated, fisher_p, odds_ratio, running, with_totals

#: Segments that ranks are cut into.
SEGMENTS = 1000


def spread(stat: Column, left: Column, ratio: Column, blocks: int | Column | None = None, level: float = 0.95) -> list[Column]:
    """Aggregates over blocks: ci_lower, ci_upper (percentiles of what removals leave), jackknife_sd, n_blocks.

    ``ratio`` is the number of rows over that of the block. The deviation is that of the delete-m
    jackknife for unequal blocks. Blocks without a finite value don't count; a block that is all
    there is has a ratio of 1 and counts for nothing.
    """
    ok = clean(left).isNotNull() & (ratio > 1) & clean(stat).isNotNull()
    theta, h = F.when(ok, left), F.when(ok, ratio)
    a = (1 - level) / 2
    # pseudo-values h stat - (h - 1) left about their estimate, from sums of their parts
    g = F.count(theta)
    centre = F.sum(stat - theta) + F.sum(theta / h)
    tau = h * stat - (h - 1) * theta
    squares = F.sum(tau * tau / (h - 1)) - 2 * centre * F.sum(tau / (h - 1)) + centre * centre * F.sum(F.when(ok, 1 / (h - 1)))
    sd = F.sqrt(F.greatest(squares, F.lit(0.0)) / (g if blocks is None else blocks))
    return [F.percentile(theta, F.lit(a)).alias("ci_lower"), F.percentile(theta, F.lit(1 - a)).alias("ci_upper"), F.when(g > 0, sd).alias("jackknife_sd"), g.alias("n_blocks")]


def _tops(rows: DataFrame, tops: list[int], within: list[str], sums: dict[str, Column], block: str) -> tuple[DataFrame, DataFrame]:
    """Sums of rows up to each of ``tops`` (suffix _top) and over all, by block and in total; one pass over the rows."""
    upto = [F.struct(F.lit(n).alias("top"), *[F.coalesce(F.sum(F.when(F.col("_rank") <= n, c)), F.lit(0)).alias(f"{k}_top") for k, c in sums.items()]) for n in sorted(tops)]
    by = rows.groupBy(*within, block).agg(F.array(*upto).alias("_t"), *[F.sum(c).alias(k) for k, c in sums.items()])
    by = stored(by.select(*within, block, *sums, F.explode("_t").alias("_t")).select(*within, block, *sums, "_t.*"), "jackknife-blocks")
    names = [*sums, *[f"{k}_top" for k in sums]]
    return by, by.groupBy(*within, "top").agg(*[F.sum(k).alias(f"_all_{k}") for k in names])


def odds_jackknife(df: DataFrame, score: str, label: str, block: str, key: str, tops: list[int], within: list[str] | None = None, epsilon: float = 0.0, least_fn: int = 0, tied: Column | None = None) -> DataFrame:
    """within, top, odds_ratio, fisher_p, ci_lower, ci_upper, jackknife_sd, n_blocks of gold among the ``top`` smallest scores.

    Rows without a score come last, ties go by key, rows without a label are left out; a null block
    is a block. The top is that of all rows also where a block is left out. With fewer than
    ``least_fn`` gold rows outside the top the odds are null; so are the intervals of groups where
    ``tied`` (a column) is true and more rows share the least score than ``top`` takes.
    """
    within = within or []
    rows = cumulated(df.withColumn("_tied", F.lit(False) if tied is None else tied), score, label, key, True, within, None)
    gold = F.col(label).cast("boolean").cast("long")
    by, total = _tops(rows, tops, within, {"n": F.lit(1), "g": gold}, block)
    both = with_totals(by, total, [*within, "top"])

    def odds(tag: str, eps: float) -> Column:
        take = (lambda k: F.col(f"_all_{k}")) if tag == "all" else (lambda k: F.col(f"_all_{k}") - F.col(k))
        tp, fp, fn = take("g_top"), take("n_top") - take("g_top"), take("g") - take("g_top")
        return odds_ratio(tp, fp, fn, take("n") - take("n_top") - fn, eps)

    point = F.when(F.col("_all_g") - F.col("_all_g_top") >= least_fn, odds("all", epsilon))
    both = both.withColumns({"_stat": point, "_left": odds("left", 0.0), "_ratio": F.col("_all_n") / F.col("n")})
    tp, fp, fn = F.col("_all_g_top"), F.col("_all_n_top") - F.col("_all_g_top"), F.col("_all_g") - F.col("_all_g_top")
    both = both.withColumn("_fisher", fisher_p(tp, fp, fn, F.col("_all_n") - F.col("_all_n_top") - fn))
    out = both.groupBy(*within, "top").agg(F.max("_stat").alias("odds_ratio"), F.max("_fisher").alias("fisher_p"), *spread(F.col("_stat"), F.col("_left"), F.col("_ratio")))
    if tied is None:
        return out
    least = Window.partitionBy(*within, F.lit(1))
    ties = rows.filter("_tied and _scored").groupBy(*within, score).agg(F.count("*").alias("_c")).groupBy(*within).agg(F.min_by("_c", score).alias("_ties"))
    named = ties.withColumnsRenamed({c: f"_of_{c}" for c in within})
    same = F.lit(True)
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    short = F.coalesce(F.col("top") < F.col("_ties"), F.lit(False))
    return out.join(named, same, "left").select(*within, "top", *[F.when(~short, F.col(c)).alias(c) for c in ("odds_ratio", "fisher_p", "ci_lower", "ci_upper", "jackknife_sd")], "n_blocks")


def enrichment_jackknife(df: DataFrame, score: str, gold: str, block: str, key: str, tops: list[int], within: list[str] | None = None) -> DataFrame:
    """within, top, enrichment, ci_lower, ci_upper, jackknife_sd, n_blocks: the mean of ``gold`` among the ``top`` smallest scores over its mean among all.

    Only rows with a gold value enter the means; the top is that of all rows. No gold rows in the
    top make 0, as does an empty rest. Tops of as many rows as have gold values, or more, are left out.
    """
    within = within or []
    value = clean(F.col(gold).cast("double"))
    rows = cumulated(df.withColumn("_any", F.lit(True)), score, "_any", key, True, within, None)
    by, total = _tops(rows, tops, within, {"n": F.when(value.isNotNull(), 1).otherwise(0), "g": F.coalesce(value, F.lit(0.0))}, block)
    both = with_totals(by, total, [*within, "top"]).filter(F.col("top") < F.col("_all_n"))

    def share(take: object) -> Column:
        inside = F.when(take("n_top") > 0, take("g_top") / take("n_top")).otherwise(0.0)
        return F.try_divide(inside, F.when(take("n") > 0, take("g") / take("n")))

    both = both.withColumns({"_stat": share(lambda k: F.col(f"_all_{k}")), "_left": F.when(F.col("n") > 0, share(lambda k: F.col(f"_all_{k}") - F.col(k))), "_ratio": F.try_divide(F.col("_all_n"), F.col("n"))})
    return both.groupBy(*within, "top").agg(F.max("_stat").alias("enrichment"), *spread(F.col("_stat"), F.col("_left"), F.col("_ratio")))


def _removals(ranked: DataFrame, within: list[str], block: str, bin_col: str | None) -> DataFrame:
    """within, _b, _q, _on_b, _on_q: nothing removed, each block, each bin, and each block with each bin that rows have."""
    keys = ranked.select(*within, block, *([bin_col] if bin_col else [])).distinct()
    yes, no = F.lit(True), F.lit(False)
    kind = lambda b, q: keys.select(*within, (F.col(block) if b else F.lit(None)).alias("_b"), (F.col(bin_col) if q else F.lit(None)).alias("_q"), (yes if b else no).alias("_on_b"), (yes if q else no).alias("_on_q")).distinct()
    out = kind(False, False).unionByName(kind(True, False))
    if not bin_col:
        return out
    bins = kind(False, True)
    pairs = kind(True, False).select(*[F.col(c).alias(f"_of_{c}") for c in within], F.col("_b").alias("_bb"))
    same = F.lit(True)
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    both = bins.join(pairs, same).select(*within, F.col("_bb").alias("_b"), "_q", yes.alias("_on_b"), "_on_q")  # blocks times bins
    return out.unionByName(bins).unionByName(both)


def areas(df: DataFrame, score: str, gold: str, block: str, key: str, tops: list[int], within: list[str] | None = None, bin_col: str | None = None) -> DataFrame:
    """within, _b, _q, _on_b, _on_q, area, kept: the area under the enrichment curve after each removal of a block, a bin, or both.

    The curve is taken at the whole midpoints of ``tops``, each for as many links as lie between its
    neighbours. Rows without a score or a gold value are left out; ranks are those of the rows that
    a removal keeps, at most all of them; a removal that keeps none has no area.
    """
    within = within or []
    cuts = sorted(set(tops))
    mids = [((a + b) // 2, b - a) for a, b in zip(cuts, cuts[1:])]
    rows = df.withColumns({"_score": clean(F.col(score).cast("double")), "_gold": clean(F.col(gold).cast("double"))}).filter("_score is not null and _gold is not null")
    rows = rows.select(*within, F.col(block).cast("string").alias("_block"), (F.col(bin_col).cast("string") if bin_col else F.lit("")).alias("_bin"), F.col(key).alias("_key"), "_score", "_gold")
    ranked = running(rows, "_score", "_key", True, within, {"_rank": F.lit(1)})
    ranked = with_totals(ranked, rows.groupBy(*within).agg(F.count("*").alias("_n")), within)
    ranked = stored(ranked.withColumn("_seg", F.floor((F.col("_rank") - 1) * SEGMENTS / F.col("_n"))), "jackknife-ranked")
    cells = stored(ranked.groupBy(*within, "_block", "_bin", "_seg").agg(F.count("*").alias("c"), F.sum("_gold").alias("g")), "jackknife-segments")
    removed = _removals(ranked, within, "_block", "_bin" if bin_col else None)

    def side(by: list[str], tag: str) -> DataFrame:
        s = cells.groupBy(*within, "_seg", *by).agg(F.sum("c").alias(f"c{tag}"), F.sum("g").alias(f"g{tag}"))
        return s.withColumnsRenamed({k: f"_{tag}_{k}" for k in [*within, "_seg", *by]})

    def same(tag: str, names: dict[str, str]) -> Column:
        out = F.lit(True)
        for ours, theirs in names.items():
            out = out & F.col(ours).eqNullSafe(F.col(f"_{tag}_{theirs}"))
        return out

    own = {c: c for c in within}
    grid = removed.join(side([], "all"), same("all", own)).withColumnRenamed("_all__seg", "_seg").drop(*[f"_all_{c}" for c in within])  # removals times segments
    grid = grid.join(side(["_block"], "b"), F.col("_on_b") & same("b", own | {"_seg": "_seg", "_b": "_block"}), "left")
    if bin_col:
        grid = grid.join(side(["_bin"], "q"), F.col("_on_q") & same("q", own | {"_seg": "_seg", "_q": "_bin"}), "left")
        grid = grid.join(side(["_block", "_bin"], "bq"), F.col("_on_b") & F.col("_on_q") & same("bq", own | {"_seg": "_seg", "_b": "_block", "_q": "_bin"}), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    kept = lambda k: F.col(f"{k}all") - zero(f"{k}b") - (zero(f"{k}q") - zero(f"{k}bq") if bin_col else 0)
    what = [*within, "_b", "_q", "_on_b", "_on_q"]
    grid = grid.select(*what, "_seg", kept("c").alias("_c"), kept("g").alias("_g"))
    part = Window.partitionBy(*what)
    upto = part.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumns({"_before": F.coalesce(F.sum("_c").over(upto), F.lit(0)), "_gold_before": F.coalesce(F.sum("_g").over(upto), F.lit(0.0)), "_kept": F.sum("_c").over(part), "_gold_all": F.sum("_g").over(part)})
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("mid"), F.lit(w).alias("width")) for n, w in mids])).alias("_m")
    ends = grid.select("*", at).select("*", "_m.mid", "_m.width").withColumn("_take", F.least("mid", "_kept"))
    ends = stored(ends.filter((F.col("_before") < F.col("_take")) & (F.col("_before") + F.col("_c") >= F.col("_take"))).drop("_m"), "jackknife-ends")  # a row for each removal and midpoint
    inside = ranked.select(*[F.col(c).alias(f"_r_{c}") for c in within], F.col("_seg").alias("_r__seg"), "_block", "_bin", "_rank", "_gold")
    met = ends.join(inside, same("r", own | {"_seg": "_seg"})).filter(~(F.col("_on_b") & F.col("_block").eqNullSafe(F.col("_b"))) & ~(F.col("_on_q") & F.col("_bin").eqNullSafe(F.col("_q"))))
    first = F.row_number().over(Window.partitionBy(*what, "mid").orderBy("_rank")) <= F.col("_take") - F.col("_before")
    tops_of = met.withColumn("_first", first).filter("_first").groupBy(*what, "mid", "width", "_take", "_kept", "_gold_before", "_gold_all").agg(F.sum("_gold").alias("_in"))
    height = F.try_divide((F.col("_gold_before") + F.col("_in")) / F.col("_take"), F.col("_gold_all") / F.col("_kept"))
    return tops_of.groupBy(*what, F.col("_kept").alias("kept")).agg(F.sum(height * F.col("width")).alias("area"))


def area_jackknife(df: DataFrame, score: str, gold: str, block: str, key: str, tops: list[int], within: list[str] | None = None) -> DataFrame:
    """within, area, ci_lower, ci_upper, jackknife_sd, n_blocks of the area under the enrichment curve (:func:`areas`)."""
    within = within or []
    found = stored(areas(df, score, gold, block, key, tops, within), "jackknife-areas")
    whole = found.filter("not _on_b").select(*within, F.col("area").alias("_stat"), F.col("kept").alias("_all"))
    left = with_totals(found.filter("_on_b"), whole, within)
    out = left.groupBy(*within).agg(F.max("_stat").alias("area"), *spread(F.col("_stat"), F.col("area"), F.col("_all") / F.when(F.col("_all") > F.col("kept"), F.col("_all") - F.col("kept"))))
    return out


def bin_contributions(df: DataFrame, score: str, gold: str, block: str, bin_col: str, key: str, tops: list[int], within: list[str] | None = None) -> DataFrame:
    """within, bin, contribution, se: the area minus that without the bin, and its deviation when blocks are left out too."""
    within = within or []
    found = stored(areas(df, score, gold, block, key, tops, within, bin_col), "jackknife-areas")
    without = found.filter("_on_q").select(*within, "_b", "_on_b", F.col("_q").alias("bin"), F.col("area").alias("_without"))
    whole = found.filter("not _on_q").select(*within, "_b", "_on_b", F.col("area").alias("_with"))
    gain = with_totals(without, whole, [*within, "_b", "_on_b"]).withColumn("_gain", F.col("_with") - F.col("_without"))
    left = F.when(F.col("_on_b"), F.col("_gain"))
    se = F.when(F.count(left) > 1, F.stddev_samp(left) * F.sqrt(F.count(left) - 1))
    return gain.groupBy(*within, "bin").agg(F.max(F.when(~F.col("_on_b"), F.col("_gain"))).alias("contribution"), se.alias("se"))
