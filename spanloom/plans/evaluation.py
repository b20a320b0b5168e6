"""Evaluation of methods against truth: strata, metrics, bootstrap."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import PRIME, clean, draw
from ..operators import metrics
from ..sources.shared import stored


@dataclass(frozen=True)
class Metric:
    """A metric by name: from (rows, score, label, key, within, weight) to (within, name); smaller scores rank first if ``ascending``."""

    name: str
    make: Callable[[DataFrame, str, str, str, list[str], str | None], DataFrame]


def defaults(ascending: bool = True, early: float = 0.2) -> list[Metric]:
    """Weighted area, early area, top-k odds, average and early average precision."""
    flip = lambda df, s: df.withColumn("_flip", -F.col(s) if ascending else F.col(s))
    return [
        Metric("auerc", lambda d, s, l, k, w, m=None: metrics.auerc(d, s, l, k, ascending, w, weight=m)),
        Metric("avg_enrichment", lambda d, s, l, k, w, m=None: metrics.auerc(d, s, l, k, ascending, w, weighted=False, weight=m).withColumnRenamed("auerc", "avg_enrichment")),
        Metric("auerc_early", lambda d, s, l, k, w, m=None: metrics.auerc(d, s, l, k, ascending, w, weighted=False, max_recall=early, weight=m).withColumnRenamed("auerc", "auerc_early")),
        Metric("auorc", lambda d, s, l, k, w, m=None: metrics.auorc(d, s, l, k, ascending, w, weight=m)),
        Metric("ap", lambda d, s, l, k, w, m=None: metrics.average_precision(flip(d, s), "_flip", l, w, m)),
        Metric("pap", lambda d, s, l, k, w, m=None: metrics.partial_average_precision(flip(d, s), "_flip", l, early, w, m)),
    ]


def labelled(rows: DataFrame, score: str, kind: str, threshold: float = 0.5) -> DataFrame:
    """Adds ``label`` by the rule of a kind of truth: at least, at most, or the score itself."""
    s = F.col(score)
    rule = {"qtl": s >= threshold, "abc": s >= 0.2, "hichip": s <= 0.1, "crispr": s.cast("boolean")}[kind]
    return rows.withColumn("label", rule)


def strict(rows: DataFrame, score: str, high: float, low: float) -> DataFrame:
    return rows.filter((F.col(score) >= high) | (F.col(score) <= low))


def prepared(rows: DataFrame, methods: list[str], fill: float | None = 1.0, clip: tuple[float, float] | None = (0.0, 1.0)) -> DataFrame:
    """Scores as doubles, kept within ``clip``, missing ones filled (or their rows dropped)."""
    for m in methods:
        c = clean(F.col(m).try_cast("double"))
        c = c if clip is None else F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(clip[1])), F.lit(clip[0])))
        rows = rows.withColumn(m, c if fill is None else F.coalesce(c, F.lit(fill)))
    return rows.dropna(subset=methods) if fill is None else rows


def long_form(rows: DataFrame, methods: list[str], keep: list[str]) -> DataFrame:
    """One row for each method: keep, method, score."""
    return rows.unpivot(keep, methods, "method", "score")


def supported(rows: DataFrame, label: str, stratum: list[str], least: int = 100, least_gold: int = 10) -> DataFrame:
    """Rows of strata with enough rows and enough gold ones."""
    ok = rows.groupBy(*stratum).agg(F.count("*").alias("_n"), F.count_if(F.col(label)).alias("_g")).filter((F.col("_n") >= least) & (F.col("_g") >= least_gold)).select(*stratum)
    return rows.join(ok, stratum, "left_semi")


def bootstrap(rows: DataFrame, methods: list[str], label: str, key: str, n: int, ascending: bool = True, stratum: Column | None = None, seed: int = 0, specs: list[Metric] | None = None, by_class: bool = False) -> DataFrame:
    """stratum, method, metric, estimate, bootstrap_sd, ci_lower, ci_upper, n_bootstrap of each of ``specs`` (all of :func:`defaults`) for each method and stratum.

    Replicates are weights, not copies, and the same for all methods and metrics. ``by_class`` draws
    gold and other rows of a stratum apart, so that each keeps its number.
    """
    rows = rows.withColumn("stratum", F.lit("all") if stratum is None else stratum)
    kept = rows.select(key, label, "stratum", *methods)
    reps = metrics.drawn(kept, n, key, ["stratum", label], seed) if by_class else metrics.replicates(kept, n, key, seed)
    long = stored(long_form(reps, methods, [key, label, "stratum", "rep", "weight"]), "replicates")
    within = ["stratum", "method", "rep"]
    out = None
    for m in specs or defaults(ascending):
        est = m.make(long, "score", label, key, within, "weight").select(*within, F.lit(m.name).alias("metric"), F.col(m.name).alias("value"))
        out = est if out is None else out.unionByName(est)
    return metrics.bootstrap_summary(out, "value", ["stratum", "method", "metric"])


def jittered(rows: DataFrame, methods: list[str], key: str, amount: float, seed: Column) -> DataFrame:
    """Scores moved by up to ``amount`` either way, by one hash of (key, seed) for all methods of a row; missing ones stay."""
    noise = ((draw(F.col(key), seed, 0) + 0.5) / PRIME * 2 - 1) * amount
    rows = rows.withColumn("_noise", noise)
    return rows.withColumns({m: F.col(m) + F.col("_noise") for m in methods}).drop("_noise")


def seed_averaged(
    rows: DataFrame, methods: list[str], label: str, key: str, reference: str, n: int = 1000, seeds: int = 10, amount: float | None = None, ascending: bool = True, stratum: Column | None = None, seed: int = 0,
    specs: list[Metric] | None = None, by_class: bool = False, least: float | None = 1e-300, fill: float | None = None, level: float = 0.95,
) -> DataFrame:
    """stratum, method, metric, estimate, seed_sd, n_seeds, bootstrap_sd, ci_lower, ci_upper, n_bootstrap, diff_estimate, diff_ci_lower, diff_ci_upper, p_value.

    Scores are numbers not under ``least``, missing ones filled with ``fill`` or left; then each of
    ``seeds`` moves them a little (:func:`jittered`), so that ties fall either way. An estimate is the
    mean of a metric over seeds, finite values only; every replicate is drawn once for all seeds and
    methods. Differences are the reference's value minus the method's, paired by replicate.
    """
    rows = rows.withColumn("stratum", F.lit("all") if stratum is None else stratum)
    for m in methods:
        c = clean(F.col(m).try_cast("double"))
        c = c if least is None else F.when(c.isNotNull(), F.greatest(c, F.lit(least)))
        rows = rows.withColumn(m, c if fill is None else F.coalesce(c, F.lit(fill)))
    kept = rows.select(key, label, "stratum", *methods)
    reps = metrics.drawn(kept, n, key, ["stratum", label], seed) if by_class else metrics.replicates(kept, n, key, seed)
    reps = reps.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    if amount is not None:
        reps = jittered(reps, methods, key, amount, F.col("seed"))
    long = stored(long_form(reps, methods, [key, label, "stratum", "rep", "seed", "weight"]), "replicates")
    within = ["stratum", "method", "rep", "seed"]
    found = None
    for m in specs or defaults(ascending):
        est = m.make(long, "score", label, key, within, "weight").select("stratum", "method", "rep", F.lit(m.name).alias("metric"), clean(F.col(m.name)).alias("value"))
        found = est if found is None else found.unionByName(est)
    by = ["stratum", "method", "metric"]
    means = stored(found.groupBy(*by, "rep").agg(F.avg("value").alias("value"), F.stddev_samp("value").alias("seed_sd")), "seed-means")
    table = metrics.bootstrap_summary(means, "value", by, level)
    spread = means.filter("rep = 0").select(*by, "seed_sd", F.lit(seeds).alias("n_seeds"))
    own = means.filter(F.col("method") == reference).select("stratum", "metric", "rep", F.col("value").alias("_r"))
    d = means.join(own, ["stratum", "metric", "rep"], "left").withColumn("_d", F.col("_r") - F.col("value"))
    boot, a = F.when(F.col("rep") > 0, F.col("_d")), (1 - level) / 2
    p = F.least(F.lit(1.0), 2 * F.least(F.avg((boot <= 0).cast("int")), F.avg((boot >= 0).cast("int"))))
    diff = d.groupBy(*by).agg(F.max(F.when(F.col("rep") == 0, F.col("_d"))).alias("diff_estimate"), F.percentile(boot, F.lit(a)).alias("diff_ci_lower"), F.percentile(boot, F.lit(1 - a)).alias("diff_ci_upper"), p.alias("p_value"))
    return table.join(spread, by, "left").join(diff, by, "left")
