"""Count regressions, residuals and the distribution functions under them, against plain numpy and known values."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions.special import beta_i, count_cdf, count_span, digamma, gamma_p, normal_quantile, trigamma
from spanloom.operators import pairs, regression, residuals
from spanloom.plans.inputs import Inputs
from spanloom.sources.shared import stored
from tests import newton

LONG = "cell_id long, feature_id long, value double"


def long(spark, m):
    return spark.createDataFrame([(int(c), k, float(v[c])) for k, v in enumerate(m) for c in range(len(v)) if v[c]], LONG)


def links_of(spark, n):
    return spark.createDataFrame([(k, k, k) for k in range(n)], "link_id long, x_id long, y_id long")


@pytest.fixture()
def small_blocks(monkeypatch):
    for name, v in (("UNITS", 2), ("ROWS", 16), ("ENTRIES", 8)):
        monkeypatch.setattr(regression, name, v)


def study(kind, n=300, units=5):
    rng = np.random.default_rng(4)
    c = rng.normal(size=(n, 2)) if kind == "continuous" else rng.integers(0, 2, (n, 2)).astype(float)
    x = rng.poisson(1.0, (units, n)).astype(float)
    y = rng.poisson(np.exp(-0.2 + 0.3 * x + 0.4 * c[:, 0] - 0.2 * c[:, 1])).astype(float)
    return c, x, y


@pytest.mark.parametrize("kind", ["continuous", "categories"])
@pytest.mark.parametrize("ridge", [0.0, 1.0])
def test_covariates_match_newton(spark, small_blocks, kind, ridge):
    c, x, y = study(kind)
    cov = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(c)], "cell_id long, c array<double>")
    links = links_of(spark, 5).union(spark.createDataFrame([(9, 0, 0)], "link_id long, x_id long, y_id long"))
    got = {r["link_id"]: r for r in residuals.poisson_multi(links, long(spark, x), long(spark, y), cov, ridge).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 9} and got[9]["beta"] == got[0]["beta"]
    for k in range(5):
        b, se, _ = newton.fitted(np.column_stack([np.ones(300), x[k], c]), y[k], ridge=ridge)
        assert got[k]["beta"] == pytest.approx(b[1], abs=1e-8) and got[k]["se"] == pytest.approx(se[1], abs=1e-8)


def test_regression_with_offsets_dispersion_and_odd_cells(spark, small_blocks):
    c, x, y = study("categories")
    off = np.random.default_rng(5).normal(size=300) * 0.3
    cells = spark.createDataFrame([(k, float(off[k]), v.tolist()) for k, v in enumerate(c)], "cell_id long, offset double, c array<double>")
    entries = long(spark, y).select(F.col("feature_id").alias("unit"), "cell_id", F.lit(0.0).alias("x"), F.col("value").alias("y"))
    entries = entries.union(spark.createDataFrame([(0, 10_000, 0.0, 5.0)], "unit long, cell_id long, x double, y double"))  # a cell that isn't there
    r = regression.Regression(entries, cells, has_x=False)
    p = r.fitted(r.start(0.5))
    d = r.dispersed(p)
    again = r.moments(r.fitted(d, dispersed_only=True))
    first, alphas, last = ({q["unit"]: q for q in r.table(t).collect()} for t in (p, d, again))
    z = np.column_stack([np.ones(300), c])
    for k in range(5):
        b, se, mu = newton.fitted(z, y[k], off, 0.5)
        assert np.allclose(first[k]["b"], b, atol=1e-8) and np.allclose(first[k]["more"], se, atol=1e-7)
        alpha = newton.matched_alpha(y[k], mu, 297)
        assert alphas[k]["alpha"] == pytest.approx(alpha, abs=1e-9)
        b, _, mu = newton.fitted(z, y[k], off, alpha) if alpha > 0 else (b, se, mu)
        assert np.allclose(last[k]["b"], b, atol=1e-8) and last[k]["more"][0] == pytest.approx(mu.mean()) and last[k]["more"][-1] == pytest.approx((mu * mu).sum())


def test_separated_and_empty_units_end(spark):
    cells = spark.createDataFrame([(k, 0.0, [float(k % 2)]) for k in range(40)], "cell_id long, offset double, c array<double>")
    rows = [(0, k, 0.0, 1.0 + k % 3) for k in range(0, 40, 2)] + [(1, 3, 2.0, 0.0)]  # y only where c is 0; no y at all
    r = regression.Regression(spark.createDataFrame(rows, "unit long, cell_id long, x double, y double"), cells, has_x=True)
    got = {q["unit"]: q["b"] for q in r.table(r.fitted(r.start())).collect()}
    assert all(math.isfinite(v) for b in got.values() for v in b) and got[0][2] < -10 and got[1][0] < -10
    none = regression.Regression(spark.createDataFrame([], "unit long, cell_id long, x double, y double"), cells, has_x=True)
    assert none.table(none.fitted(none.start())).count() == 0
    with pytest.raises(ValueError, match="different number"):
        regression.Regression(spark.createDataFrame(rows, "unit long, cell_id long, x double, y double"), cells.union(spark.createDataFrame([(99, 0.0, [1.0, 2.0])], cells.schema)), has_x=True)


def test_residuals_match_numpy(spark):
    rng = np.random.default_rng(8)
    n = 200
    batch, off = rng.integers(0, 3, n), rng.normal(size=n) * 0.2
    y = rng.poisson(np.exp(0.3 + off) * rng.gamma(1.0, 1.0, (4, n)))
    cells = spark.createDataFrame([(k, float(off[k]), None if batch[k] == 0 and k % 2 else int(batch[k])) for k in range(n)], "cell_id long, offset double, batch int")
    got = residuals.count_residuals(long(spark, y), cells, clip=3.0, whole=True).collect()
    assert len(got) == 4 * n
    z = np.column_stack([np.ones(n), batch == 1, batch == 2]).astype(float)  # a null batch is the first level
    centred = off - off.mean()
    for k in range(4):
        _, _, mu = newton.fitted(z, y[k].astype(float), centred, 0.5)
        alpha = newton.matched_alpha(y[k], mu, n - 3)
        _, _, mu = newton.fitted(z, y[k].astype(float), centred, alpha)
        want = np.clip((y[k] - mu) / np.sqrt(mu + alpha * mu * mu), -3, 3)
        own = sorted((r["cell_id"], r["residual"]) for r in got if r["feature_id"] == k)
        assert np.allclose([v for _, v in own], want, atol=1e-6)
    with pytest.raises(ValueError, match="whole"):
        residuals.count_residuals(long(spark, y * 0.5), cells, whole=True)
    scaled = residuals.count_residuals(long(spark, y), cells, standardise=True).groupBy("feature_id").agg(F.avg("residual").alias("m"), F.stddev_samp("residual").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in scaled)


def test_quantile_residuals_are_normal_under_the_model(spark):
    rng = np.random.default_rng(11)
    n = 3000
    for alpha in (0.0, 0.7):
        mu = np.exp(rng.normal(size=n))
        y = rng.poisson(mu * (rng.gamma(1 / alpha, alpha, n) if alpha else 1))
        d = spark.createDataFrame([(k, float(y[k]), float(mu[k])) for k in range(n)], "k long, y double, mu double")
        u = (F.pmod(F.xxhash64("k"), F.lit(100_003)) + 0.5) / 100_003
        r = np.sort([q[0] for q in d.select(residuals.quantile_residual(F.col("y"), F.col("mu"), F.lit(alpha), u)).collect()])
        p = np.array([NormalDist().cdf(v) for v in r])
        assert np.abs(p - (np.arange(n) + 0.5) / n).max() < 1.63 / math.sqrt(n)  # one in a hundred


def test_residuals_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(residuals, "RESIDUALS", 100, raising=False)
    monkeypatch.setattr(residuals, "TOGETHER", 3)
    y = np.random.default_rng(5).poisson(0.8, (5, 200))
    cells = stored(spark.createDataFrame([(k, 0.1 * (k % 3), [float(k % 2)]) for k in range(200)], "cell_id long, offset double, c array<double>"), "cells")
    features = stored(spark.createDataFrame([(k, [0.1 * k, -0.2], 0.5) for k in range(5)], "feature_id long, b array<double>, alpha double"), "features")
    full = residuals.modelled(long(spark, y), cells, features).withColumn("task", F.spark_partition_id()).collect()
    assert {(r["cell_id"], r["feature_id"]): r["value"] for r in full} == {(c, k): float(y[k][c]) for c in range(200) for k in range(5)} and len(full) == 1000
    assert all(abs(r["mu"] - math.exp(0.1 * (r["cell_id"] % 3) + 0.1 * r["feature_id"] - 0.2 * (r["cell_id"] % 2))) < 1e-12 for r in full)
    assert np.unique([r["task"] for r in full], return_counts=True)[1].max() < 250  # 10 tasks, not one for so small an input


def test_alphas_are_drawn_to_the_median(spark):
    rng = np.random.default_rng(2)
    mean, squares, alpha = rng.uniform(0, 0.3, 60), rng.uniform(0, 3e4, 60), np.concatenate([rng.uniform(0, 40, 59), [0.0]])
    d = spark.createDataFrame([(k, float(mean[k]), float(squares[k]), float(alpha[k])) for k in range(60)], "feature_id long, mean double, squares double, alpha double")

    def want(keep):
        a = np.clip(alpha[keep], 1e-6, None)
        big = mean[keep] > 0.1
        middle = np.median(np.log(a[big] if big.any() else a))
        w = squares[keep] / (squares[keep] + 1e4)
        return np.clip(np.exp(np.where(mean[keep] < 0.1, w * np.log(a) + (1 - w) * middle, np.log(a))), 1e-6, 30)

    for keep in (np.arange(60), np.flatnonzero(mean < 0.1)):
        rows = d.filter(F.col("feature_id").isin(keep.tolist()))
        assert np.allclose([r["alpha"] for r in residuals.shrunk_alpha(rows).orderBy("feature_id").collect()], want(keep), rtol=1e-9)
    assert residuals.shrunk_alpha(d.filter("false")).count() == 0


@pytest.mark.parametrize(("values", "logs"), [([60, 70, 200], True), ([10, 20, 300], False), ([40, 70, 40, 300], True), ([40, 55, 40, 300], False), ([60, 70, 90], False), ([1.0], False)])
def test_offsets_that_are_counts_are_told(spark, values, logs):
    d = spark.createDataFrame([(float(v),) for v in values], "offset double")
    want = np.log(np.array(values) + 1e-8) if logs else np.array(values, float)
    assert np.allclose(sorted(r[0] for r in residuals.log_offsets(d).collect()), sorted(want - want.mean()))


def known(spark, rows, schema, make):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(make).collect()]


def test_distribution_functions_of_counts(spark):
    rows = [(float(y), mu, a) for y in (-1, 0, 1, 4, 30, 300, 900) for mu in (1e-6, 0.4, 3.0, 40.0, 800.0) for a in (0.0, 1e-3, 0.2, 3.0)] + [(0.0, 0.0, 0.0)]

    def want(y, mu, a):
        if y < 0 or mu == 0:
            return float(y >= 0)
        if a == 0:
            return math.fsum(math.exp(k * math.log(mu) - mu - math.lgamma(k + 1)) for k in range(int(y) + 1))
        r = 1 / a
        return math.fsum(math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) - r * math.log1p(mu / r) + k * math.log(mu / (r + mu))) for k in range(int(y) + 1))

    got = known(spark, rows, "y double, mu double, a double", count_cdf(F.col("y"), F.col("mu"), F.col("a")))
    assert max(abs(g - want(*r)) for g, r in zip(got, rows)) < 1e-10
    both = known(spark, rows, "y double, mu double, a double", count_span(F.col("y"), F.col("mu"), F.col("a")))
    assert [b["upto"] for b in both] == got
    assert max(abs(b["below"] - want(y - 1, mu, a)) for b, (y, mu, a) in zip(both, rows)) < 1e-10


def test_special_functions(spark):
    p = [1e-10, 1e-5, 0.02, 0.0243, 0.3, 0.5, 0.9, 0.97575, 1 - 1e-9]
    assert np.allclose(known(spark, [(v,) for v in p], "p double", normal_quantile(F.col("p"))), [NormalDist().inv_cdf(v) for v in p], atol=1e-9, rtol=0)
    assert known(spark, [(0.0,), (1.0,), (2.0,), (None,)], "p double", normal_quantile(F.col("p"))) == [-math.inf, math.inf, None, None]
    x = [(0.5,), (1.0,), (10.0,)]
    assert np.allclose(known(spark, x, "x double", digamma(F.col("x"))), [-np.euler_gamma - 2 * math.log(2), -np.euler_gamma, sum(1 / k for k in range(1, 10)) - np.euler_gamma], atol=1e-11)
    assert np.allclose(known(spark, x, "x double", trigamma(F.col("x"))), [math.pi**2 / 2, math.pi**2 / 6, math.pi**2 / 6 - sum(1 / k**2 for k in range(1, 10))], atol=1e-11)
    # P(1, x) = 1 - exp(-x); P(1/2, x) = erf(sqrt(x)); I_x(1, b) = 1 - (1 - x)^b; I_x(1/2, 1/2) = 2/pi asin(sqrt(x))
    for v in (0.0, 0.01, 0.7, 3.0, 30.0):
        assert np.allclose(known(spark, [(v,)], "x double", F.array(gamma_p(F.lit(1.0), F.col("x")), gamma_p(F.lit(0.5), F.col("x"))))[0], [1 - math.exp(-v), math.erf(math.sqrt(v))], atol=1e-11)
    for v in (0.0, 0.01, 0.4, 0.9, 1.0):
        assert np.allclose(known(spark, [(v,)], "x double", F.array(beta_i(F.lit(1.0), F.lit(7.0), F.col("x")), beta_i(F.lit(0.5), F.lit(0.5), F.col("x"))))[0], [1 - (1 - v) ** 7, 2 / math.pi * math.asin(math.sqrt(v))], atol=1e-11)


def test_negative_binomial_matches_a_plain_maximiser(spark):
    rng = np.random.default_rng(1)
    n, xs, ys = 400, [], []
    for b0, b1, a in ((0.3, 0.2, 0.5), (-1, 0.4, 2.0), (1.0, -0.3, 0.1), (2.0, 0.1, 5.0), (0.5, 0.1, 0.0)):
        x = rng.poisson(1.0, n)
        xs.append(x)
        ys.append(rng.poisson(np.exp(b0 + b1 * x) * (rng.gamma(1 / a, a, n) if a else 1)))
    xs += [rng.poisson(1.0, n), rng.poisson(0.4, n), np.zeros(n, int)]
    ys += [np.zeros(n, int), (xs[6] > 0) * 2, rng.poisson(1.0, n)]
    got = {r["link_id"]: r for r in pairs.negative_binomial_fit(pairs.joint_histograms(links_of(spark, 8), long(spark, xs), long(spark, ys), n)).collect()}
    for k in range(4):
        g = got[k]
        v = newton.most_likely([g["b0"] + 0.01, g["b1"] - 0.01, -math.log(g["alpha"]) + 0.02], xs[k], ys[k])
        assert [g["b0"], g["b1"], g["alpha"]] == pytest.approx([v[0], v[1], math.exp(-v[2])], abs=1e-6)
        assert g["se"] > 0 and math.fsum(b["n"] for b in g["bars"]) == n
    assert got[4]["alpha"] < 0.1 and (got[5]["b0"], got[5]["b1"], got[5]["alpha"], got[5]["se"]) == (None, None, None, None)
    assert math.isfinite(got[6]["b1"]) and got[7]["b0"] == pytest.approx(math.log(ys[7].mean()), abs=1e-6)


def test_joint_histograms_move_no_row_for_each_link_and_cell(spark):
    rng = np.random.default_rng(6)
    x, y = rng.poisson(0.7, (2, 50)), rng.poisson(0.9, (11, 50))
    pairs_of = [(a * 11 + b, a, b) for a in range(2) for b in range(11)] + [(90, 1, 7), (91, 5, 3), (92, 0, 30)]  # one twice, no such x, no such y
    links = spark.createDataFrame(pairs_of, "link_id long, x_id long, y_id long")
    found = pairs.joint_histograms(links, long(spark, x), long(spark, y), 50)
    got = {q["link_id"]: q for q in found.collect()}
    assert len(got) == 25
    for link, a, b in pairs_of:
        u, v = x[a] if a < 2 else np.zeros(50, int), y[b] if b < 11 else np.zeros(50, int)
        want = {(0.0, 0.0): 0.0} | {k: float(n) for k, n in zip(*(lambda t, n: ([tuple(map(float, r)) for r in t], n))(*np.unique(np.column_stack([u, v]), axis=0, return_counts=True)))}
        assert [tuple(q) for q in got[link]["bars"]] == [(*k, n) for k, n in sorted(want.items())] and got[link]["sum_y"] == v.sum()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [link_id" in line and "cell_id" in line for line in plan.splitlines())


def test_classes_are_the_counts_of_both_matrices(spark):
    t = Inputs(spark, "/root/testdata/sf0.001")
    for got, want in zip(t.classes(), (t.x(), t.y())):
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_equal_entries_of_a_unit_are_one(spark, monkeypatch):
    """Cells that are alike in x, y and covariates are counted, so rounds don't grow with cells; a hundred cells of two kinds make as many entries as two."""
    made = {}
    monkeypatch.setattr(regression, "stored", lambda df, tag: made.setdefault(tag, stored(df, tag)) if tag == "regression-entries" else stored(df, tag))
    cells = spark.createDataFrame([(k, 0.1 * (k % 2), [float(k % 2)]) for k in range(100)], "cell_id long, offset double, c array<double>")
    y = np.array([[1 + k % 2 for k in range(100)]])
    r = regression.Regression(long(spark, y).select(F.col("feature_id").alias("unit"), "cell_id", F.lit(0.0).alias("x"), F.col("value").alias("y")), cells, has_x=False)
    assert sorted((q["y"], q["n"]) for q in made["regression-entries"].collect()) == [(1.0, 50.0), (2.0, 50.0)]
    got = r.table(r.fitted(r.start())).first()["b"]
    assert got == pytest.approx([0.0, math.log(2) - 0.1], abs=1e-8)


def test_links_of_one_x_and_unknown_cells_match_newton(spark):
    """Several links of an x, y without x, and cells without covariates, which are left out; no row is made for a link and a cell."""
    c, x, y = study("categories", 120, 3)
    cov = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(c[:100])], "cell_id long, c array<double>")
    pairs_of = [(a * 3 + b, a, b) for a in range(2) for b in range(3)]
    found = residuals.poisson_multi(spark.createDataFrame(pairs_of, "link_id long, x_id long, y_id long"), long(spark, x), long(spark, y), cov)
    got = {q["link_id"]: q for q in found.collect()}
    for link, a, b in pairs_of:
        want, se, _ = newton.fitted(np.column_stack([np.ones(100), x[a][:100], c[:100]]), y[b][:100])
        assert [got[link]["beta"], got[link]["se"]] == pytest.approx([want[1], se[1]], abs=1e-8)
