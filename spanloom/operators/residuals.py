"""Residuals of counts on depth and batch, and Poisson regression on several covariates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import PRIME, bound, count_span, draw, normal_quantile
from ..sources.shared import stored
from .pairs import beside
from .regression import FURTHEST, Regression, told_cells


def alpha_moments(y: Column, mu: Column) -> Column:
    """Dispersion by moments, an aggregate: sum of ((y - mu)^2 - mu) over sum of mu^2, not under 0."""
    return F.greatest(F.coalesce(F.try_divide(F.sum((y - mu) * (y - mu) - mu), F.sum(mu * mu)), F.lit(0.0)), F.lit(0.0))


def pearson_residual(y: Column, mu: Column, alpha: Column, eps: float = 1e-8) -> Column:
    return (y - mu) / F.sqrt(F.greatest(mu + alpha * mu * mu, F.lit(eps)))


def depth_residuals(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """cell_id, feature_id, mu, alpha, residual for every cell and feature: expected by depth and the feature's share, dispersion by moments, Pearson residual.

    Dense by nature: one row for every cell and feature.
    """
    total = counts.agg(F.sum("value")).first()[0]
    depth = cells.select("cell_id").join(counts.groupBy("cell_id").agg(F.sum("value").alias("_d")), "cell_id", "left").na.fill(0.0, ["_d"])
    share = counts.groupBy("feature_id").agg((F.sum("value") / F.lit(total)).alias("_p"))
    full = depth.withColumn("_k", F.lit(1)).join(F.broadcast(share.withColumn("_k", F.lit(1))), "_k").drop("_k").join(counts, ["cell_id", "feature_id"], "left").na.fill(0.0, ["value"])
    full = full.select("cell_id", "feature_id", "value", (F.col("_d") * F.col("_p")).alias("mu"))
    alpha = full.groupBy("feature_id").agg(alpha_moments(F.col("value"), F.col("mu")).alias("alpha"))
    return full.join(F.broadcast(alpha), "feature_id").withColumn("residual", pearson_residual(F.col("value"), F.col("mu"), F.col("alpha")))


def standardised(df: DataFrame, value: str, within: str) -> DataFrame:
    """``value`` minus its mean over its sample deviation within a group; a deviation of 0 counts as 1."""
    s = df.groupBy(within).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(s, within).withColumn(value, (F.col(value) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).drop("_m", "_s")


def shrunk_alpha(features: DataFrame, mean: str = "mean", squares: str = "squares", alpha: str = "alpha", threshold: float = 0.1, tau: float = 1e4, clip: tuple[float, float] = (1e-6, 30.0)) -> DataFrame:
    """``alpha`` of features with a mean under ``threshold`` drawn to a median on the log scale, the more so the smaller the sum of squared means.

    The median is that of the features with a larger mean, or of all if there are none; the weight
    of a feature's own alpha is squares / (squares + tau). All alphas end inside ``clip``.
    """
    raised = F.greatest(F.col(alpha), F.lit(clip[0]))
    above = F.col(mean) > threshold
    middle = lambda c: F.percentile(c, F.lit(0.5))
    medians = features.agg(middle(F.when(above, F.log(raised))).alias("_above"), middle(F.log(raised)).alias("_all")).first()  # a row a feature
    median = medians["_above"] if medians["_above"] is not None else medians["_all"]
    if median is None:
        return features
    w = F.col(squares) / (F.col(squares) + tau)
    drawn = F.exp(w * F.log(raised) + (1 - w) * median)
    return features.withColumn(alpha, F.greatest(F.least(F.when(F.col(mean) < threshold, drawn).otherwise(raised), F.lit(clip[1])), F.lit(clip[0])))


def log_offsets(cells: DataFrame, offset: str = "offset") -> DataFrame:
    """Offsets on the log scale, with a mean of 0: values with a median above 50 and a maximum above 100 are counts, and become log(value + 1e-8)."""
    o = F.col(offset)
    s = cells.agg(F.count(o).alias("n"), F.count_if(o > 50).alias("over"), F.max(o).alias("most"), F.max(F.when(o <= 50, o)).alias("below"), F.min(F.when(o > 50, o)).alias("above")).first()
    # the median of an even number is the mean of the middle two
    counts = s["n"] and s["most"] > 100 and (2 * s["over"] > s["n"] or 2 * s["over"] == s["n"] and (s["below"] + s["above"]) / 2 > 50)
    value = F.log(o + 1e-8) if counts else o
    mean = cells.agg(F.avg(value)).first()[0]
    return cells.withColumn(offset, value - F.lit(mean or 0.0))


#: Levels of a batch column at most; each is a coefficient.
MOST_LEVELS = 500


def batch_design(cells: DataFrame, batch: str = "batch") -> DataFrame:
    """Adds ``c``: an array of ones and zeros for each level of the batch but the first; a null batch has zeros."""
    levels = [r[0] for r in cells.select(batch).filter(F.col(batch).isNotNull()).distinct().orderBy(batch).limit(MOST_LEVELS + 1).collect()]
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} batches")
    return cells.withColumn("c", F.array(*[F.when(F.col(batch) == v, 1.0).otherwise(0.0) for v in levels[1:]]).cast("array<double>"))


def count_model(counts: DataFrame, cells: DataFrame, alpha_init: float = 0.5, refit: bool = True) -> DataFrame:
    """feature_id, b, alpha, mean, squares: a negative binomial regression of each feature on an offset and the batch.

    ``counts``: cell_id, feature_id, value, non-zeros only. ``cells``: cell_id, offset (log scale), c
    (an array of covariates). The first fit has ``alpha_init``; then alpha is matched to the squared
    residuals, and where it is above 0 the fit is made again with it. ``mean`` and ``squares``
    belong to the fitted means over all cells. Features without counts don't come up.
    """
    r = Regression(counts.select(F.col("feature_id").alias("unit"), "cell_id", F.lit(0.0).alias("x"), F.col("value").alias("y")), cells, has_x=False)
    p = r.dispersed(r.fitted(r.start(alpha_init)))
    if refit:
        p = r.fitted(p, dispersed_only=True)
    return r.table(r.moments(p)).select(F.col("unit").alias("feature_id"), "b", "alpha", F.get("more", F.lit(0)).alias("mean"), F.element_at("more", -1).alias("squares"))


#: Features that stand in one row while residuals are made, and residuals that one task makes, about.
TOGETHER, RESIDUALS = 512, 100_000


def modelled(counts: DataFrame, cells: DataFrame, features: DataFrame) -> DataFrame:
    """cell_id, feature_id, value, mu, alpha for every cell and every feature of ``features`` (feature_id, b, alpha).

    The full table is dense by nature, but it is made row by row: features come in blocks, a cell's
    counts of a block as a map, and only these are joined. Cells are small beside what is made of
    them, so they are dealt out by that and not by their size. ``cells`` and ``features`` should be stored.
    """
    n_features = features.count()
    n, tasks = max(1, -(-n_features // TOGETHER)), max(1, -(-n_features * cells.count() // RESIDUALS))
    block = F.pmod(F.xxhash64("feature_id"), F.lit(n)).alias("_block")
    packed = features.groupBy(block).agg(F.collect_list(F.struct("feature_id", "b", "alpha")).alias("_f"))  # about TOGETHER features each
    held = counts.select("cell_id", "feature_id", "value", block).repartition(tasks, "cell_id", "_block").groupBy("cell_id", "_block").agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "value"))).alias("_y"))
    every = cells.select("cell_id", "offset", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("_block")).repartition(tasks, "cell_id", "_block")
    full = every.join(held, ["cell_id", "_block"], "left").join(packed, "_block").select("cell_id", "offset", "c", "_y", F.inline("_f"))
    z = F.concat(F.array(F.lit(1.0)), F.col("c"))
    eta = F.aggregate(F.zip_with("b", z, lambda a, v: a * v), F.col("offset"), lambda s, v: s + v)
    value = F.coalesce(F.try_element_at("_y", F.col("feature_id")), F.lit(0.0))
    return full.select("cell_id", "feature_id", value.alias("value"), F.exp(F.greatest(F.least(eta, F.lit(FURTHEST)), F.lit(-FURTHEST))).alias("mu"), "alpha")


def quantile_residual(y: Column, mu: Column, alpha: Column, u: Column) -> Column:
    """Randomised quantile residual: the normal quantile of a point between the distribution function below y and at y, at the share ``u``.

    Poisson where alpha is 0, else negative binomial with size 1 / alpha. The point stays 1e-12 off 0 and 1.
    """
    within = lambda s: s["below"] + u * F.greatest(F.least(s["upto"] - s["below"], F.lit(1.0)), F.lit(0.0))
    point = bound(count_span(y, mu, alpha), within)
    return normal_quantile(F.greatest(F.least(point, F.lit(1 - 1e-12)), F.lit(1e-12)))


def count_residuals(counts: DataFrame, cells: DataFrame, kind: str = "pearson", refit: bool = True, shrink: bool = False, clip: float | None = 10.0, standardise: bool = False, whole: bool = False, seed: int = 0) -> DataFrame:
    """cell_id, feature_id, mu, alpha, residual for every cell and every feature with counts: a negative binomial model of offset and batch.

    ``cells``: cell_id, offset (logs, or counts told by :func:`log_offsets`), batch. ``kind``:
    'pearson' or 'quantile' (randomised by an integer hash of cell, feature and seed). ``whole``
    refuses counts that aren't whole numbers.
    """
    if whole and not counts.filter(F.col("value") != F.floor("value")).isEmpty():
        raise ValueError("counts must be whole numbers")
    cells = stored(batch_design(log_offsets(cells)).select("cell_id", "offset", "c"), "model-cells")
    features = stored(count_model(counts, cells, refit=refit), "model-features")
    if shrink:
        features = shrunk_alpha(features)
    full = modelled(counts, cells, features)
    y, mu, alpha = F.col("value"), F.col("mu"), F.col("alpha")
    if kind == "quantile":
        full = full.withColumn("_u", (draw(F.col("cell_id"), F.col("feature_id"), seed) + 0.5) / PRIME)  # beside mu, where its steps are compiled
        r = quantile_residual(y, mu, alpha, F.col("_u"))
    else:
        r = pearson_residual(y, mu, alpha)
    if clip is not None:
        r = F.greatest(F.least(r, F.lit(clip)), F.lit(-clip))
    out = full.select("cell_id", "feature_id", "mu", "alpha", r.alias("residual"))
    return standardised(stored(out, "residuals"), "residual", "feature_id") if standardise else out


def poisson_multi(links: DataFrame, x: DataFrame, y: DataFrame, covariates: DataFrame, ridge: float = 0.0) -> DataFrame:
    """link_id, beta, se: the slope of y on x beside an intercept and covariates (cell_id, c: array), over all cells.

    A link whose x and y are 0 in all cells has no slope and doesn't come up.
    """
    numbered = links.select("link_id", "x_id", "y_id", F.xxhash64("x_id", "y_id").alias("unit"))  # equal pairs are fitted once
    pairs = stored(numbered.select(F.col("unit").alias("link_id"), "x_id", "y_id").distinct(), "pairs")
    cells = stored(told_cells(covariates.select("cell_id", F.lit(0.0).alias("offset"), "c")), "covariates")
    # cells with x have their y beside it; those with y alone are all that have this y, less those with x
    placed, rows, names = beside(pairs, x, y, cells)
    met = rows.select("x_id", "_b", "_c", F.coalesce("_x", F.lit(0.0)).alias("_x"), "offset", "c", F.posexplode(F.array(*names)).alias("_pos", "y")).join(placed, ["x_id", "_b", "_c", "_pos"])
    entry = lambda x, n: F.struct(x.alias("x"), F.col("y"), F.lit(n).alias("n"))
    met = met.select(F.col("link_id").alias("unit"), "offset", "c", F.inline(F.array(entry(F.col("_x"), 1.0), entry(F.lit(0.0), -1.0))))
    alone = pairs.join(y.select(F.col("feature_id").alias("y_id"), "cell_id", F.col("value").alias("y")), "y_id").join(cells, "cell_id").select(F.col("link_id").alias("unit"), "offset", "c", F.lit(0.0).alias("x"), "y", F.lit(1.0).alias("n"))
    r = Regression(met.unionByName(alone).filter("x != 0 or y != 0"), cells, has_x=True)
    fits = r.table(r.fitted(r.start(), ridge)).select("unit", F.get("b", F.lit(1)).alias("beta"), F.get("more", F.lit(1)).alias("se"))
    return numbered.join(fits, "unit").select("link_id", "beta", "se")
