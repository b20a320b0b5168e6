"""Seed-averaged evaluation, whitened bins and promoter peaks."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions.special import PRIME
from spanloom.operators import metrics
from spanloom.plans import evaluation, jobs

AP = [evaluation.Metric("ap", lambda d, s, l, k, w, m=None: metrics.average_precision(d, s, l, w, m))]


def rows(spark, n=60):
    rng = random.Random(4)
    data = [(k, rng.random() < 0.4, float(rng.randint(0, 3)), rng.choice([None, "bad", str(rng.randint(0, 3))])) for k in range(n)]
    return data, spark.createDataFrame(data, "id long, label boolean, a double, b string")


def drawn(a, b, seed):
    h = (a * 48271 + b * 69621 + seed * 16807 + 1) % PRIME
    for f, o in ((39373, a), (40692, b), (62089, a), (25214, b)):
        h = (h * h + o * f + 12345) % PRIME
    return h


def precision(pairs):
    pairs = sorted(pairs, reverse=True)
    gold = sum(l for _, l in pairs)
    return sum(l * sum(m for _, m in pairs[: k + 1]) / (k + 1) for k, (_, l) in enumerate(pairs)) / gold


@pytest.mark.parametrize("fill", [None, 0.0])
def test_estimates_are_means_over_jittered_scores(spark, fill):
    data, df = rows(spark)
    got = {r["method"]: r for r in evaluation.seed_averaged(df, ["a", "b"], "label", "id", "a", n=0, seeds=5, amount=0.4, specs=AP, least=0.5, fill=fill).collect()}
    for at, name in ((2, "a"), (3, "b")):
        values = []
        for s in range(5):
            scored = []
            for r in data:
                v = None if r[at] in (None, "bad") else max(float(r[at]), 0.5)
                v = fill if v is None else v
                if v is not None:
                    scored.append((v + ((drawn(r[0], s, 0) + 0.5) / PRIME * 2 - 1) * 0.4, r[1]))
            values.append(precision(scored))
        assert got[name]["estimate"] == pytest.approx(np.mean(values)) and got[name]["seed_sd"] == pytest.approx(np.std(values, ddof=1)) and got[name]["n_bootstrap"] == 0
    assert got["b"]["diff_estimate"] == pytest.approx(got["a"]["estimate"] - got["b"]["estimate"]) and got["a"]["diff_estimate"] == 0


@pytest.mark.parametrize("by_class", [True, False])
def test_replicates_are_paired(spark, by_class):
    _, df = rows(spark)
    got = {r["method"]: r for r in evaluation.seed_averaged(df.withColumn("same", F.col("a")), ["a", "same"], "label", "id", "a", n=12, seeds=2, specs=AP, least=None, by_class=by_class).collect()}
    assert got["same"]["diff_ci_lower"] == got["same"]["diff_ci_upper"] == 0 and got["same"]["p_value"] == 1
    assert got["a"]["seed_sd"] == 0 and 0 < got["a"]["bootstrap_sd"] < 0.3 and got["a"]["ci_lower"] < got["a"]["estimate"] < got["a"]["ci_upper"]
    assert evaluation.seed_averaged(df.filter("false"), ["a"], "label", "id", "a", n=2, seeds=2, specs=AP).count() == 0


def test_promoter_peaks(spark):
    peaks = spark.createDataFrame([(1, "chr1", 100, 200), (2, "chr1", 2300, 2400), (3, "chr1", 3000, 3100), (4, "chr2", 100, 200)], "peak_id long, chrom string, start long, end long")
    genes = spark.createDataFrame([("1", 300), ("chr1", 300), ("2", None)], "chrom string, tss long")
    flags = {r["peak_id"]: r["promoter"] for r in jobs.promoter_peaks(peaks, genes).collect()}
    assert flags == {1: 1, 2: 0, 3: 0, 4: 0}
    bins = spark.createDataFrame([(1, "0.1"), (4, "0.1"), (9, "2.0")], "feature_id long, bin string")
    assert {r["feature_id"]: r["bin"] for r in jobs.with_promoter(bins, jobs.promoter_peaks(peaks, genes)).collect()} == {1: "0.1.1", 4: "0.1.0", 9: "2.0.0"}


def test_whitened_bins(spark):
    rng = np.random.default_rng(3)
    counts, gc = rng.integers(1, 50, 30), rng.random(30)
    m = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(counts)], "cell_id long, feature_id long, value double")
    got = {r["feature_id"]: r for r in jobs.whitened_gc_bins(m, 10, spark.createDataFrame([(k, float(v)) for k, v in enumerate(gc)], "feature_id long, gc double"), 3, 2).collect()}
    both = np.vstack([np.log10(counts + 1e-10), gc])
    z = np.linalg.solve(np.linalg.cholesky(np.cov(both)).T, both)  # the upper factor
    order = np.argsort(np.argsort(z[0], kind="stable"), kind="stable")
    assert all(got[k]["main_bin"] == sum(order[k] + 1 > 1 + 29 * q / 3 + 1e-9 for q in (1, 2)) for k in range(30))
    assert all(math.isclose(float(got[k]["bin"].split(".")[0]), got[k]["main_bin"]) for k in range(30))
