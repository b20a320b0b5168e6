"""Evaluation of ranked scores against binary labels: enrichment, odds ratios, precision and recall, bootstrap.

Ranks need one order over all rows. :func:`running` makes cumulative sums over a total order without
a single task: rows are cut into ranges of the score, sums of the ranges above are added to sums
within a range. Rows carry weights, so that a bootstrap replicate is the same rows with other
multiplicities and no copies are made.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import PRIME, clean, draw, lgamma

#: Ranges that a total order is cut into.
RANGES = 32


def running(df: DataFrame, score: str, key: str, ascending: bool, within: list[str], sums: dict[str, Column], ties: bool = False, least: bool = False) -> DataFrame:
    """Adds for each of ``sums`` the sum (or with ``least`` the minimum) over all rows up to this one in order of (score, key), within groups.

    With ``ties``, up to the last row with the same score. Ranges are cut at quantiles of the score;
    a null score counts as the smallest.
    """
    total, joined = (F.min, F.least) if least else (F.sum, lambda x, y: x + F.coalesce(y, F.lit(0)))
    edges = df.select(F.percentile_approx(score, [i / RANGES for i in range(1, RANGES)], 1000).alias("e")).first()["e"] or []
    cut = F.lit(0)
    for e in sorted(set(edges)):
        cut = cut + F.when(F.col(score) > e, 1).otherwise(0)
    rows = df.withColumn("_cut", cut if ascending else -cut)
    part = rows.groupBy(*within, "_cut").agg(*[total(c).alias(f"_s_{k}") for k, c in sums.items()])  # RANGES rows a group
    before = Window.partitionBy(*within, F.lit(1)).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select(*[F.col(c).alias(f"_in_{c}") for c in within], F.col("_cut").alias("_in_cut"), *[total(f"_s_{k}").over(before).alias(f"_o_{k}") for k in sums])
    order = Window.partitionBy(*within, "_cut").orderBy(F.col(score).asc() if ascending else F.col(score).desc(), *([] if ties else [key]))
    order = order.rangeBetween(Window.unboundedPreceding, 0) if ties else order.rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_cut") == F.col("_in_cut")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_in_{c}"))
    return rows.join(F.broadcast(offsets), same).withColumns({k: joined(total(c).over(order), F.col(f"_o_{k}")) for k, c in sums.items()}).drop("_cut", "_in_cut", *[f"_in_{c}" for c in within], *[f"_o_{k}" for k in sums])


def contingency(df: DataFrame, predicted: Column, label: Column, within: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn."""
    return df.groupBy(*(within or [])).agg(F.count_if(predicted & label).alias("tp"), F.count_if(predicted & ~label).alias("fp"), F.count_if(~predicted & label).alias("fn"), F.count_if(~predicted & ~label).alias("tn"))


def odds_ratio(tp: Column, fp: Column, fn: Column, tn: Column, epsilon: float = 0.0) -> Column:
    """Smoothed by ``epsilon`` in every cell; without it, infinite or null where cells are empty."""
    top, bottom = (tp + epsilon) * (tn + epsilon), (fp + epsilon) * (fn + epsilon)
    return F.when(bottom > 0, top / F.when(bottom > 0, bottom)).when(top > 0, float("inf"))


def fisher_p(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Two-sided exact p-value: all tables with the same margins that are no more likely than this one, with a slack of 1e-7."""
    a, b, c, d = (x.cast("double") for x in (tp, fp, fn, tn))
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    log_p = lambda k: choose(a + b, k) + choose(c + d, a + c - k) - choose(a + b + c + d, a + c)
    low, high = F.greatest(F.lit(0), tp - tn).cast("long"), F.least(tp + fp, tp + fn).cast("long")
    observed = log_p(a)
    return F.least(F.lit(1.0), F.aggregate(F.sequence(low, high), F.lit(0.0), lambda s, k: s + F.when(log_p(k.cast("double")) <= observed + math.log1p(1e-7), F.exp(log_p(k.cast("double")))).otherwise(0.0)))


def cumulated(df: DataFrame, score: str, label: str, key: str, ascending: bool, within: list[str], weight: str | None) -> DataFrame:
    """Rows with a label, best scores first and those without a score last: _scored, _w, and up to each row _rank (of all), _linked (of scored) and _gold; _n and _g of the group."""
    w = F.lit(1) if weight is None else F.col(weight).cast("int")
    value = clean(F.col(score).cast("double"))
    rows = df.filter(F.col(label).isNotNull()).withColumns({"_w": w, "_scored": value.isNotNull(), "_at": F.coalesce(value, F.lit(float("inf") if ascending else float("-inf")))}).filter("_w > 0")
    hit = F.col("_w") * F.col(label).cast("int")
    total = rows.groupBy(*within).agg(F.sum("_w").alias("_n"), F.sum(hit).alias("_g"))
    rows = running(rows, "_at", key, ascending, within, {"_rank": F.col("_w"), "_linked": F.when(F.col("_scored"), F.col("_w")).otherwise(0), "_gold": hit})
    return with_totals(rows, total, within).drop("_at")


def with_totals(rows: DataFrame, total: DataFrame, within: list[str]) -> DataFrame:
    """``rows`` with the columns of their group's row of ``total``; null is a group too."""
    named = total.withColumnsRenamed({c: f"_of_{c}" for c in within})
    same = F.lit(True)
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(F.broadcast(named), same).drop(*[f"_of_{c}" for c in within])


def enrichment_curve(df: DataFrame, score: str, label: str, key: str, ascending: bool = True, within: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Adds recall and enrichment at each scored row: the share of all gold rows found so far, and precision so far over the overall share.

    Rows without a score are no points, but count among all rows and all gold rows.
    """
    rows = cumulated(df, score, label, key, ascending, within or [], weight).filter("_scored")
    rows = rows.withColumn("_back", F.explode(F.sequence(F.lit(0), F.col("_w") - 1))) if weight else rows.withColumn("_back", F.lit(0))
    gold, linked = F.col("_gold") - F.when(F.col(label), F.col("_back")).otherwise(0), F.col("_linked") - F.col("_back")
    return rows.withColumns({"recall": F.try_divide(gold, F.col("_g")), "enrichment": F.try_divide(F.try_divide(gold, linked), F.try_divide(F.col("_g"), F.col("_n")))}).drop("_back", "_w", "_scored", "_rank", "_linked", "_gold", "_n", "_g")


def auerc(df: DataFrame, score: str, label: str, key: str, ascending: bool = True, within: list[str] | None = None, weighted: bool = True, max_recall: float = 1.0, weight: str | None = None) -> DataFrame:
    """Area under the whole enrichment-recall curve, as a mean height, weighted by 1 - recall, or up to ``max_recall``.

    The curve is held constant to recall 0 before its first point and to ``max_recall`` after its last. Fewer
    than two points, or a group without gold rows, give null. Only gold rows move the recall, and the
    point before a gold row follows from its own counts, so the area is a plain sum over rows.
    """
    within = within or []
    rows = cumulated(df, score, label, key, ascending, within, weight).filter("_scored")
    n, g = F.col("_n").cast("double"), F.nullif(F.col("_g").cast("double"), F.lit(0.0))
    share = lambda gold, linked: F.try_divide(F.try_divide(gold, linked), F.try_divide(g, n))
    mass = lambda recall: (1 - recall) if weighted else F.lit(1.0)

    def step(j: Column) -> Column:
        """Area and mass between a copy of a gold row, the j-th of the row's, and the point before it."""
        gold, linked = F.col("_gold") - F.col("_w") + j, F.col("_linked") - F.col("_w") + j
        x, px = gold / g, (gold - 1) / g
        y, py = share(gold, linked), F.when(linked > 1, share(gold - 1, linked - 1))
        w, pw = mass(x), F.when(linked > 1, mass(px)).otherwise(mass(x))
        area, base = (x - px) * (y * w + F.coalesce(py, y) * pw) / 2, (x - px) * (w + pw) / 2
        return F.when(x <= max_recall, F.struct(area.alias("area"), base.alias("mass"), linked.alias("linked"), gold.alias("gold")))

    hits = F.filter(F.transform(F.sequence(F.lit(1), F.col("_w")), step), lambda p: p.isNotNull())
    steps = F.when(F.col(label) & (F.col("_g") > 0), hits)
    flat = F.when(~F.col(label) & (F.col("_gold") / g <= max_recall), F.struct(F.col("_linked").alias("linked"), F.col("_gold").alias("gold")))
    rows = rows.withColumns({"_steps": steps, "_flat": flat})
    last = F.coalesce(F.transform(F.slice("_steps", -1, 1), lambda p: F.struct(p["linked"].alias("linked"), p["gold"].alias("gold")))[0], F.col("_flat"))
    points = F.sum(F.when(F.col("_steps").isNotNull(), F.size("_steps")).when(F.col("_flat").isNotNull(), F.col("_w")).otherwise(0))

    def summed(field: str) -> Column:
        return F.sum(F.when(F.size("_steps") > 0, F.aggregate("_steps", F.lit(0.0), lambda t, p: t + p[field])).otherwise(0.0))

    rows = rows.withColumn("_last", F.when(F.coalesce(F.size("_steps") > 0, F.lit(False)) | F.col("_flat").isNotNull(), last))
    sums = rows.groupBy(*within, "_n", "_g").agg(summed("area").alias("_area"), summed("mass").alias("_mass"), points.alias("_points"), F.max("_last").alias("_end"))
    x = F.col("_end")["gold"] / g
    rest = (max_recall - x) * mass(x)
    area, whole = F.col("_area") + rest * share(F.col("_end")["gold"], F.col("_end")["linked"]), F.col("_mass") + rest
    return sums.select(*within, F.when(F.col("_points") >= 2, F.try_divide(area, whole)).alias("auerc"))


def top_k_log_odds(df: DataFrame, score: str, label: str, key: str, ascending: bool = True, within: list[str] | None = None, epsilon: float = 0.5, share: float = 0.99, weight: str | None = None) -> DataFrame:
    """k, log_or for k up to the number of gold rows and to ``share`` of the rows: the top k against the rest.

    Rows without a score rank last. A row of weight w stands for w rows, each with a k of its own. A
    group without gold rows, or without others, has none.
    """
    within = within or []
    log_or, rows = top_k(df, score, label, key, ascending, within, epsilon, share, weight)
    return rows.select(*within, F.col("_k").cast("long").alias("k"), log_or(F.col("_k"), F.col("_tp")).alias("log_or"))


def top_k(df: DataFrame, score: str, label: str, key: str, ascending: bool, within: list[str], epsilon: float, share: float, weight: str | None) -> tuple[Callable[[Column, Column], Column], DataFrame]:
    """The log odds ratio as a function of (k, true positives), and the ranked rows with their _k and _tp."""
    rows = cumulated(df, score, label, key, ascending, within, weight).filter("_g > 0 and _g < _n")
    rows = rows.withColumn("_back", F.explode(F.sequence(F.lit(0), F.col("_w") - 1))) if weight else rows.withColumn("_back", F.lit(0))
    rows = rows.withColumns({"_k": F.col("_rank") - F.col("_back"), "_tp": F.col("_gold") - F.when(F.col(label), F.col("_back")).otherwise(0)})

    def log_or(k: Column, tp: Column) -> Column:
        return F.log(odds_ratio(tp, k - tp, F.col("_g") - tp, F.col("_n") - F.col("_g") - k + tp, epsilon))

    return log_or, rows.filter((F.col("_k") <= F.col("_g")) & (F.col("_k") <= F.floor(F.col("_n") * share)))


def auorc(df: DataFrame, score: str, label: str, key: str, ascending: bool = True, within: list[str] | None = None, epsilon: float = 0.5, weight: str | None = None) -> DataFrame:
    """Area under the top-k log odds ratios over k, weighted by 1 / k, as a mean height; null under two points.

    The point before a row follows from the row's own counts, so this is a plain sum.
    """
    within = within or []
    log_or, rows = top_k(df, score, label, key, ascending, within, epsilon, 0.99, weight)
    k, tp = F.col("_k"), F.col("_tp")
    before = log_or(k - 1, tp - F.col(label).cast("int"))
    area = F.when(k > 1, (log_or(k, tp) / k + before / (k - 1)) / 2)
    mass = F.when(k > 1, (1 / k + 1 / (k - 1)) / 2)
    return rows.groupBy(*within).agg(F.try_divide(F.sum(area), F.sum(mass)).alias("auorc"))


def precision_recall(df: DataFrame, score: str, label: str, within: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """One point for each distinct score, larger scores first: precision, recall and the recall gained."""
    within = within or []
    w = F.lit(1) if weight is None else F.col(weight)
    rows = df.filter(clean(F.col(score)).isNotNull() & F.col(label).isNotNull())
    levels = rows.groupBy(*within, score).agg(F.sum(w).alias("_c"), F.sum(w * F.col(label).cast("int")).alias("_p")).filter("_c > 0")
    levels = running(levels, score, score, False, within, {"_n": F.col("_c"), "_tp": F.col("_p")})
    total = levels.groupBy(*within).agg(F.sum("_p").alias("_g"))
    levels = with_totals(levels, total, within)
    return levels.select(*within, score, (F.col("_tp") / F.col("_n")).alias("precision"), F.try_divide(F.col("_tp"), F.col("_g")).alias("recall"), F.try_divide(F.col("_p"), F.col("_g")).alias("gain"))


def average_precision(df: DataFrame, score: str, label: str, within: list[str] | None = None, weight: str | None = None) -> DataFrame:
    return precision_recall(df, score, label, within, weight).groupBy(*(within or [])).agg(F.sum(F.col("gain") * F.col("precision")).alias("ap"))


def partial_average_precision(df: DataFrame, score: str, label: str, max_recall: float = 0.2, within: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """The trapezoid area of precision over recall up to ``max_recall``, from (0, 1), divided by it; null without another point."""
    within = within or []
    curve = precision_recall(df, score, label, within, weight).select(*within, "recall", "precision")
    points = curve.filter(F.col("recall") <= max_recall)
    start = curve.select(*within).distinct().withColumns({"recall": F.lit(0.0), "precision": F.lit(1.0)}) if within else points.sparkSession.createDataFrame([(0.0, 1.0)], "recall double, precision double")
    # points of one recall stand in order of falling precision, as the scores fall
    order = Window.partitionBy(*within, F.lit(1)).orderBy("recall", F.desc("precision"))
    all_points = points.unionByName(start).withColumns({"_x": F.lag("recall").over(order), "_y": F.lag("precision").over(order)})
    return all_points.groupBy(*within).agg((F.sum((F.col("recall") - F.col("_x")) * (F.col("precision") + F.col("_y")) / 2) / max_recall).alias("pap"))


def minus_log10(p: Column) -> Column:
    return F.when(p.isNotNull(), -F.log10(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300))))


def multiplicity(key: Column, replicate: Column, seed: int) -> Column:
    """How often a row stands in a bootstrap replicate: Poisson(1) from an integer hash, the same in any engine.

    Independent Poisson weights need no common total, so replicates are made row by row.
    """
    u = draw(key, replicate, seed)
    p, total, out = math.exp(-1), 0.0, F.lit(0)
    for k in range(8):
        total += p
        p /= k + 1
        out = out + F.when(u >= int(total * PRIME), 1).otherwise(0)
    return out


def replicates(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """The rows of every replicate with their weights, ``rep`` 0 being the rows themselves."""
    rows = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return rows.withColumn("weight", F.when(F.col("rep") == 0, 1).otherwise(multiplicity(F.col(key), F.col("rep"), seed))).filter("weight > 0")


def drawn(df: DataFrame, n: int, key: str, strata: list[str], seed: int = 0) -> DataFrame:
    """As :func:`replicates`, with draws that keep the number of rows of each of ``strata`` (of all, without any) exactly.

    Every row draws one of its stratum by a hash of (key, replicate), and a row's weight is how
    often it was drawn. ``key`` tells rows of a stratum apart. With the label among ``strata``, gold
    and other rows are drawn apart.
    """
    rows = running(df, key, key, True, strata, {"_pos": F.lit(1)})
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_m"))
    keys = [F.col(s).eqNullSafe(F.col(f"_of_{s}")) for s in strata]
    named = sizes.select(*[F.col(s).alias(f"_of_{s}") for s in strata], "_m")
    own = rows.select(*strata, key).join(F.broadcast(named), keys if keys else F.lit(True)).select(*strata, key, "_m").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n)))) if n else None
    first = rows.withColumns({"rep": F.lit(0), "weight": F.lit(1)}).drop("_pos")
    if own is None:
        return first
    hits = own.groupBy(*strata, "rep", (F.pmod(F.xxhash64(key, "rep", F.lit(seed)), F.col("_m")) + 1).alias("_hit")).agg(F.count("*").cast("int").alias("weight"))
    hits = hits.select(*[F.col(s).alias(f"_of_{s}") for s in strata], "rep", "_hit", "weight")
    again = rows.join(hits, [*keys, F.col("_pos") == F.col("_hit")]).drop("_pos", "_hit", *[f"_of_{s}" for s in strata])
    return first.unionByName(again)


def bootstrap_odds_ratio(df: DataFrame, predicted: str, label: str, key: str, n: int = 1000, level: float = 0.95, epsilon: float = 0.5, stratified: bool = True, seed: int = 0) -> DataFrame:
    """One row: or_point, fisher_p, ci_lower, ci_upper, boot_p, n_boot_finite of the odds ratio smoothed by ``epsilon``.

    The interval is one of percentiles; boot_p is two-sided, of the replicates about the log of the
    point. With fewer than two finite replicates both are null.
    """
    rows = df.filter(F.col(predicted).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(predicted).cast("boolean").alias("_y"), F.col(label).cast("boolean").alias("_label"))
    reps = drawn(rows, n, "_key", ["_label"] if stratified else [], seed)
    y, gold, w = F.col("_y"), F.col("_label"), F.col("weight")
    cell = {c: F.sum(F.when(test, w).otherwise(0)) for c, test in (("tp", y & gold), ("fp", y & ~gold), ("fn", ~y & gold), ("tn", ~y & ~gold))}
    cells = reps.groupBy("rep").agg(*[c.alias(k) for k, c in cell.items()])
    cells = cells.withColumn("_or", odds_ratio(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"), epsilon))
    cells = cells.withColumn("_log", clean(F.when(F.col("_or") > 0, F.log("_or"))))
    point = cells.filter("rep = 0").select(F.col("_or").alias("or_point"), fisher_p(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).alias("fisher_p"), F.col("_log").alias("_at"))
    a, boot = (1 - level) / 2, cells.filter("rep > 0").crossJoin(point.select("_at"))
    shift = F.signum(F.col("_log") - F.col("_at"))
    low, high = F.avg((1 - shift) / 2), F.avg((1 + shift) / 2)
    enough = F.count("_log") >= 2
    told = boot.agg(F.when(enough, F.exp(F.percentile("_log", F.lit(a)))).alias("ci_lower"), F.when(enough, F.exp(F.percentile("_log", F.lit(1 - a)))).alias("ci_upper"), F.when(enough, F.least(F.lit(1.0), 2 * F.least(low, high))).alias("boot_p"), F.count("_log").alias("n_boot_finite"))
    return point.drop("_at").crossJoin(told)


def bootstrap_summary(estimates: DataFrame, value: str, within: list[str], level: float = 0.95) -> DataFrame:
    """estimate, bootstrap_sd, ci_lower, ci_upper, n_bootstrap of a metric from its values by ``rep``."""
    boot = F.when(F.col("rep") > 0, clean(F.col(value)))
    a = (1 - level) / 2
    return estimates.groupBy(*within).agg(F.max(F.when(F.col("rep") == 0, F.col(value))).alias("estimate"), F.stddev_samp(boot).alias("bootstrap_sd"), F.percentile(boot, F.lit(a)).alias("ci_lower"), F.percentile(boot, F.lit(1 - a)).alias("ci_upper"), F.count(boot).alias("n_bootstrap"))


def paired_difference(estimates: DataFrame, value: str, method: str, reference: str, level: float = 0.95) -> DataFrame:
    """method, diff_estimate, diff_ci_lower, diff_ci_upper, p_value: each method minus the reference, paired by replicate.

    Estimates are made once: made again for the reference, sums in another order would differ in
    their last digits, and the reference from itself.
    """
    same = Window.partitionBy("rep")  # a row a method
    ref = F.max(F.when(F.col(method) == reference, F.struct(F.col(value).alias("v")))).over(same)
    d = estimates.withColumn("_r", ref).filter("_r is not null").withColumn("_d", F.col(value) - F.col("_r.v"))
    boot, a = F.when(F.col("rep") > 0, clean(F.col("_d"))), (1 - level) / 2
    p = 2 * F.least(F.avg((boot <= 0).cast("int")), F.avg((boot >= 0).cast("int")))
    return d.groupBy(method).agg(F.max(F.when(F.col("rep") == 0, F.col("_d"))).alias("diff_estimate"), F.percentile(boot, F.lit(a)).alias("diff_ci_lower"), F.percentile(boot, F.lit(1 - a)).alias("diff_ci_upper"), F.least(F.lit(1.0), p).alias("p_value"))
