"""Agreement of data sets and bootstrapped formulas, against sets and plain numpy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import agreement, meta


@pytest.mark.parametrize("bucket", [16_384, 3])
def test_pair_counts_equal_sets(spark, monkeypatch, bucket):
    monkeypatch.setattr(agreement, "BUCKET", bucket)
    rng = random.Random(1)
    rows = [(rng.choice("abcde"), rng.randint(0, 60), rng.choice([True, False, None])) for _ in range(500)] + [("z", 10_000, True)] * 50 + [(None, 1, True), ("a", None, True)]
    df = spark.createDataFrame(rows, "d string, link int, pos boolean").withColumns({"name": F.lit("?"), "set": F.lit("?"), "bucket": F.lit("?")})
    every, good = {}, {}
    for d, l, p in rows:
        if d is not None and l is not None:
            every.setdefault(d, set()).add(l)
            good.setdefault(d, set())
            if p:
                good[d].add(l)
    want = {(a, b): (len(every[a] & every[b]), len(good[a] & good[b]), len(good[a] & every[b]), len(every[a] & good[b])) for a in every for b in every if a <= b and every[a] & every[b]}
    counts = agreement.pair_counts(df, "d", "link", "pos")
    assert {(r["a"], r["b"]): tuple(r[2:]) for r in counts.collect()} == want
    sizes = {r["category"]: (r["first"], r["second"], r["joint"]) for r in agreement.paired_sizes(counts, "b", "a").collect()}
    assert sizes == {"links": (len(every["b"]), len(every["a"]), want["a", "b"][0]), "positive": (len(good["b"]), len(good["a"]), want["a", "b"][1])}
    assert agreement.pair_counts(df.filter("false"), "d", "link", "pos").count() == 0


def test_odds_and_chi_squared_by_hand(spark):
    counts = spark.createDataFrame([("a", "b", 100, 20, 30, 35), ("a", "c", 50, 0, 10, 5), ("b", "b", 9, 9, 9, 9), ("b", "c", 40, 0, 0, 0)], agreement.COUNTS.replace("a int, b int", "a string, b string"))
    got = {(r["a"], r["b"]): r for r in agreement.odds_matrix(counts).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    table = np.array([[20.0, 15.0], [10.0, 100.0]])
    expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
    chi = ((np.abs(table - expected) - 0.5) ** 2 / expected).sum()
    assert got["a", "b"]["odds_ratio"] == pytest.approx(20 * 100 / (15 * 10)) and got["a", "b"]["chi_squared"] == pytest.approx(chi)
    assert got["a", "b"]["p_value"] == pytest.approx(math.erfc(math.sqrt(chi / 2)))
    assert got["a", "c"]["odds_ratio"] == pytest.approx(0.5 * 50.5 / (5.5 * 10.5)) and got["b", "c"]["chi_squared"] is None
    assert agreement.odds_matrix(counts, corrected=False).filter("a = 'a' and b = 'c'").first()["odds_ratio"] == 0


def test_terms():
    assert meta.terms_of("y ~ a + b*c + a:c") == ("y", [("a",), ("b",), ("c",), ("b", "c"), ("a", "c")])


def study(n=200):
    rng = np.random.default_rng(7)
    return [(str(rng.integers(0, 6)), float(rng.normal()), float(rng.normal()), str(rng.choice(["u", "v", "w"])), float(rng.random() + 0.1)) for _ in range(n)]


@pytest.mark.parametrize("weight", [None, "w"])
def test_formula_equals_least_squares_on_the_drawn_rows(spark, weight):
    rows = study()
    df = spark.createDataFrame(rows + [("0", None, 1.0, "u", 1.0), ("1", 1.0, math.nan, "u", 1.0)], "d string, y double, x double, g string, w double").repartition(3)
    got = {}
    for r in meta.bootstrap_formula(df, "y ~ x * g", "d", 12, weight, seed=3).collect():
        got.setdefault(r["rep"], {})[r["term"]] = r["coefficient"]
    assert set(got) == set(range(13)) and set(got[0]) == {"Intercept", "x", "g[v]", "g[w]", "x:g[v]", "x:g[w]"}

    def drawn(pos, rep, seed, p=2147483647):
        h = (pos * 48271 + rep * 69621 + seed * 16807 + 1) % p
        for f, o in ((39373, pos), (40692, rep), (62089, pos), (25214, rep)):
            h = (h * h + o * f + 12345) % p
        return h

    for rep in range(13):
        times = np.bincount([drawn(k, rep, 3) % 6 for k in range(6)], minlength=6) if rep else np.ones(6, int)
        sample = [r for r in rows for _ in range(times[int(r[0])])]
        z = np.array([[1, r[2], r[3] == "v", r[3] == "w", r[2] * (r[3] == "v"), r[2] * (r[3] == "w")] for r in sample], float)
        w = np.sqrt([r[4] if weight else 1.0 for r in sample])
        want = np.linalg.lstsq(z * w[:, None], np.array([r[1] for r in sample]) * w, rcond=None)[0]
        assert [got[rep][t] for t in ("Intercept", "x", "g[v]", "g[w]", "x:g[v]", "x:g[w]")] == pytest.approx(want.tolist(), abs=1e-9)


def test_formula_of_few_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 2.0)], "d string, y double, x double")
    same = {r["term"]: r["coefficient"] for r in meta.bootstrap_formula(df, "y ~ x", "d", 0).collect()}  # x is constant: no single answer
    assert same["Intercept"] + 2 * same["x"] == pytest.approx(1.5)
    assert meta.bootstrap_formula(df.filter("false"), "y ~ x", "d", 5).count() == 0
    s = meta.coefficient_summary(spark.createDataFrame([(k, "x", float(v)) for k, v in enumerate([5, -1, 1, 2, 3])], "rep int, term string, coefficient double")).first()
    assert (s["estimate"], s["p_value"]) == (5.0, 0.5) and s["ci_lower"] == pytest.approx(np.percentile([-1, 1, 2, 3], 2.5))
