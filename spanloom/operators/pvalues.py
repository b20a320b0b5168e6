"""Empirical p-values and false discovery rates by counting in sorted windows.

Controls and observations are put into one frame and counted by a window, so no observation is
ever paired with all controls. Counts over all rows (pooled values, false discovery rates) first
make one row a distinct value, store these, and run over them by ranges of values with the totals
of the ranges above; no single task sorts all rows, and rows are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import clean, normal_sf
from ..sources.shared import stored
from .metrics import running, with_totals


def counts_at_least(obs: DataFrame, ctrl: DataFrame, value: str, ctrl_value: str, key: str, group: str | None = None) -> DataFrame:
    """key, n_ge, n_ctrl: how many controls of the group (or at all) are at least the observation, and how many there are.

    Null and NaN controls don't count; null and NaN observations get null for ``n_ge``.
    """
    g = F.lit(0) if group is None else F.col(group)
    o = obs.select(g.alias("_g"), clean(F.col(value)).alias("_v"), F.lit(1).alias("_obs"), F.col(key).alias("_key"))
    c = ctrl.select(g.alias("_g"), clean(F.col(ctrl_value)).alias("_v"), F.lit(0).alias("_obs"), F.lit(None).cast(obs.schema[key].dataType).alias("_key")).filter("_v is not null")
    both = o.unionByName(c)
    total = F.sum(1 - F.col("_obs"))
    if group is not None:
        part = Window.partitionBy("_g")
        n = F.when(F.col("_v").isNotNull(), total.over(part.orderBy(F.desc("_v")).rangeBetween(Window.unboundedPreceding, 0)))
        out = both.withColumns({"n_ge": n, "n_ctrl": total.over(part)})
    else:
        # one row a distinct value, so that equal values are no work and ranges of values can be cut anywhere
        levels = stored(both.filter("_v is not null").groupBy("_v").agg(total.alias("_c")), "levels")
        upto = running(levels, "_v", "_v", False, [], {"n_ge": F.col("_c")}).select(F.col("_v").alias("_at"), "n_ge")
        n = levels.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n_ctrl"))  # one row
        out = o.join(upto, F.col("_v") == F.col("_at"), "left").join(F.broadcast(n))
    return out.filter("_obs = 1").select(F.col("_key").alias(key), "n_ge", "n_ctrl")


def monte_carlo(obs: DataFrame, ctrl: DataFrame, value: str, ctrl_value: str, key: str, group: str | None = None, two_sided: bool = False) -> DataFrame:
    """Adds ``mcpval``: (1 + controls at least as large) / (1 + controls)."""
    if two_sided:
        obs, ctrl = obs.withColumn(value, F.abs(value)), ctrl.withColumn(ctrl_value, F.abs(ctrl_value))
    n = counts_at_least(obs, ctrl, value, ctrl_value, key, group)
    return obs.join(n, key, "left").withColumn("mcpval", (F.col("n_ge") + 1) / (F.col("n_ctrl") + 1)).drop("n_ge", "n_ctrl")


def interpolated(obs: DataFrame, ctrl: DataFrame, value: str, ctrl_value: str, key: str, group: str | None = None) -> DataFrame:
    """Adds ``survival``: the share of controls that are larger, 1 minus their distribution at the observation."""
    n = counts_at_least(obs.withColumn(value, -F.col(value)), ctrl.withColumn(ctrl_value, -F.col(ctrl_value)), value, ctrl_value, key, group)
    return obs.join(n.select(key, (1 - F.try_divide(F.col("n_ge"), F.col("n_ctrl"))).alias("survival")), key, "left")


def moments(v: Column) -> tuple[Column, Column, Column]:
    """Aggregates of a group: mean, population deviation and sample variance, exact where all values are equal.

    Partial means of equal values don't always give that value again when they are put together
    (100 / 11 * 11 isn't 100), and a deviation that is 0 would be some 1e-14, as the rows are dealt.
    """
    same = F.min(v) == F.max(v)
    return F.when(same, F.min(v)).otherwise(F.avg(v)), F.when(same, 0.0).otherwise(F.stddev_pop(v)), F.when(same & (F.count(v) > 1), 0.0).otherwise(F.var_samp(v))


def centred(obs: DataFrame, ctrl: DataFrame, value: str, ctrl_value: str, group: str, se: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Observations and controls standardised by their group's controls (mean and population deviation).

    With ``se``, a column of standard errors, the variance is the sample variance plus the mean
    squared error. Groups without controls, or whose deviation is 0, are dropped from both. Mean and
    deviation are made once and stored: made for each side, sums in another order would part an
    observation from the control that equals it.
    """
    v = clean(F.col(ctrl_value))
    mean, deviation, variance = moments(v)
    spread = deviation if se is None else F.sqrt(variance + F.avg(F.col(se) * F.col(se)))
    stats = stored(ctrl.groupBy(group).agg(mean.alias("_m"), spread.alias("_s")).filter("_s > 0"), "moments")  # a row a group
    scaled = lambda df, c: df.join(stats, group).withColumn(c, (F.col(c) - F.col("_m")) / F.col("_s")).drop("_m", "_s")
    return scaled(obs.filter(clean(F.col(value)).isNotNull()), value), scaled(ctrl.filter(v.isNotNull()), ctrl_value)


def pooled(obs: DataFrame, ctrl: DataFrame, value: str, ctrl_value: str, key: str, group: str) -> DataFrame:
    """Adds ``ppval``: the Monte Carlo p-value among the standardised controls of all groups that have a valid observation."""
    o, c = centred(obs, ctrl, value, ctrl_value, group)
    c = c.join(o.select(group).distinct(), group, "left_semi")
    n = counts_at_least(o, c, value, ctrl_value, key)
    return obs.join(n, key, "left").withColumn("ppval", (F.col("n_ge") + 1) / (F.col("n_ctrl") + 1)).drop("n_ge", "n_ctrl")


def z_scores(obs: DataFrame, ctrl: DataFrame, value: str, ctrl_value: str, group: str) -> DataFrame:
    """Adds ``z`` and ``zpval`` against the group's controls; a deviation of 0 gives plus or minus infinity."""
    mean, deviation, _ = moments(clean(F.col(ctrl_value)))
    stats = ctrl.groupBy(group).agg(mean.alias("_m"), deviation.alias("_s"))
    d = F.col(value) - F.col("_m")
    z = F.when(F.col("_s") > 0, F.try_divide(d, F.col("_s"))).when(d > 0, float("inf")).when(d < 0, float("-inf"))
    return obs.join(stats, group, "left").withColumn("z", z).withColumn("zpval", F.when(F.col("z") == float("inf"), 0.0).when(F.col("z") == float("-inf"), 1.0).otherwise(normal_sf(F.col("z")))).drop("_m", "_s")


def studentised(beta: Column, se: Column, limit: float = 100.0) -> Column:
    ratio = F.try_divide(beta, se)
    return F.when(ratio.isNotNull(), F.greatest(F.least(ratio, F.lit(limit)), F.lit(-limit)))


def empirical_fdr(obs: DataFrame, ctrl: DataFrame, value: str, ctrl_value: str, key: str, group: str | None = None) -> DataFrame:
    """Adds ``q_value``: for each threshold the share of controls over the share of statistics at least as large, at most 1,
    made monotone from the least stringent threshold. Shares are of all controls, null ones too, and of the statistics that there are."""
    g = F.lit(0) if group is None else F.col(group)
    v, zero, one = F.col("_v"), F.lit(0), F.lit(1)
    o = obs.select(g.alias("_g"), clean(F.col(value).cast("double")).alias("_v"), one.alias("_o"), zero.alias("_c"))
    c = ctrl.select(g.alias("_g"), clean(F.col(ctrl_value).cast("double")).alias("_v"), zero.alias("_o"), one.alias("_c"))
    # statistics and controls are read once, into one row a distinct value; the null value has those without one
    levels = stored(o.unionByName(c).groupBy("_g", "_v").agg(F.sum("_o").alias("_o"), F.sum("_c").alias("_c")), "levels")
    sizes = levels.groupBy("_g").agg(F.coalesce(F.sum(F.when(v.isNotNull(), F.col("_o"))), zero).alias("_m"), F.sum("_c").alias("_b"))
    upto = running(levels.filter("_v is not null"), "_v", "_v", False, ["_g"], {"_stat_ge": F.col("_o"), "_ctrl_ge": F.col("_c")})
    ratio = F.least(F.lit(1.0), F.try_divide(F.try_divide(F.col("_ctrl_ge"), F.col("_b")), F.try_divide(F.col("_stat_ge"), F.col("_m"))))
    tested = stored(with_totals(upto.filter("_o > 0"), sizes, ["_g"]).select("_g", "_v", ratio.alias("_r")), "thresholds")
    run = running(tested, "_v", "_v", True, ["_g"], {"q_value": F.col("_r")}, least=True).select(F.col("_g").alias("_gg"), F.col("_v").alias("_t"), "q_value")
    rows = obs.withColumn("_g", g)
    return rows.join(run, F.col("_g").eqNullSafe(F.col("_gg")) & (clean(F.col(value).cast("double")) == F.col("_t")), "left").drop("_g", "_gg", "_t")


def fdr_threshold(tested: DataFrame, value: str, target: float = 0.1, group: list[str] | None = None) -> DataFrame:
    """One row a group: ``t_star``, the largest statistic whose ``q_value`` is ``target`` at most; null without one."""
    return tested.groupBy(*(group or [])).agg(F.max(F.when(F.col("q_value") <= target, F.col(value))).alias("t_star"))


def benjamini_hochberg(df: DataFrame, p: str, key: str, group: str | None = None) -> DataFrame:
    """Adds ``bh_q``: p * n / rank, made monotone from the largest p; null p stays null.

    Equal p share the largest of their ranks, as the running minimum makes of any order among them.
    """
    within = [] if group is None else [group]
    levels = stored(df.filter(F.col(p).isNotNull()).groupBy(*within, p).agg(F.count("*").alias("_c")), "levels")
    ranked = running(levels, p, p, True, within, {"_r": F.col("_c")})
    total = levels.groupBy(*within).agg(F.sum("_c").alias("_n"))
    ranked = stored(with_totals(ranked, total, within).withColumn("_q", F.col(p) * F.col("_n") / F.col("_r")), "thresholds")
    best = running(ranked, p, p, False, within, {"_least": F.col("_q")}, least=True)
    best = best.select(*[F.col(c).alias(f"_of_{c}") for c in within], F.col(p).alias("_p"), F.least(F.lit(1.0), "_least").alias("bh_q"))
    same = F.col(p) == F.col("_p")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return df.join(best, same, "left").drop("_p", *[f"_of_{c}" for c in within])
