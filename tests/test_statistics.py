"""Hand-computed values of the statistics, and numpy references for fits."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import strings
from spanloom.functions.special import cauchy_combined, lgamma, normal_sf
from spanloom.operators import binning, meta, metrics, nulls, pairs, pvalues, specificity
from spanloom.plans import evaluation, jobs
from tests import newton


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def mc(spark, ctrl, obs, **kw):
    c = frame(spark, [(0, v) for v in ctrl], "grp int, ctrl double")
    o = frame(spark, [(1, 0, obs)], "key int, grp int, value double")
    return pvalues.monte_carlo(o, c, "value", "ctrl", "key", "grp", **kw).first()["mcpval"]


@pytest.mark.parametrize(("ctrl", "obs", "two", "want"), [([1, 2, 3, 4, 5], 3.5, False, 0.5), ([1, 2, 3, 4, 5], 3.5, True, 0.5), ([-1, -2, -3, -4, -5], -3.5, False, 4 / 6), ([-1, -2, -3, -4, -5], -3.5, True, 0.5), ([1, math.nan, 3, math.nan], 2, False, 2 / 3), ([1, 2, 3], math.nan, False, None)])
def test_monte_carlo(spark, ctrl, obs, two, want):
    got = mc(spark, [float(c) for c in ctrl], float(obs), two_sided=two)
    assert got == (None if want is None else pytest.approx(want))


def test_pooled_skips_invalid_groups(spark):
    c = frame(spark, [(0, 1.0), (0, math.nan), (0, 3.0), (1, 2.0), (1, 4.0), (1, math.nan), (2, 1.0), (2, 1.0), (2, 1.0)], "grp int, ctrl double")
    o = frame(spark, [(0, 0, 2.0), (1, 1, math.nan), (2, 2, 1.0)], "key int, grp int, value double")
    got = {r["key"]: r["ppval"] for r in pvalues.pooled(o, c, "value", "ctrl", "key", "grp").collect()}
    assert got == {0: pytest.approx(2 / 3), 1: None, 2: None}


def test_z_scores(spark):
    c = frame(spark, [(g, float(v)) for g in (0, 1) for v in range(1, 6)] + [(2, 3.0)] * 3 + [(3, 3.0)] * 3, "grp int, ctrl double")
    o = frame(spark, [(0, 0, 3.0), (1, 1, 5.0), (2, 2, 4.0), (3, 3, 2.0)], "key int, grp int, value double")
    got = {r["key"]: (r["z"], r["zpval"]) for r in pvalues.z_scores(o, c, "value", "ctrl", "grp").collect()}
    assert got[0] == (0, pytest.approx(0.5)) and got[1][0] == pytest.approx(math.sqrt(2))
    assert got[2] == (math.inf, 0.0) and got[3] == (-math.inf, 1.0)


def test_ungrouped_counts_match_brute_force(spark):
    rng = np.random.default_rng(5)
    obs, ctrl = rng.integers(0, 50, 300).astype(float), rng.integers(0, 60, 2000).astype(float)
    got = pvalues.counts_at_least(frame(spark, list(enumerate(obs.tolist())), "key int, value double"), frame(spark, [(v,) for v in ctrl.tolist()], "ctrl double"), "value", "ctrl", "key").collect()
    assert all(r["n_ge"] == int((ctrl >= obs[r["key"]]).sum()) and r["n_ctrl"] == 2000 for r in got)


def test_rank_quantile_of_seven_in_three(spark):
    d = spark.range(7).withColumn("v", F.col("id").cast("double"))
    assert [r["b"] for r in binning.quantile_bins(d, "v", "id", 3, "b").orderBy("id").collect()] == [0, 0, 1, 1, 2, 2, 2]


def test_nested_bins(spark):
    rows = [(0, 10.0, 0), (0, 30.0, 1), (0, 20.0, 2), (1, 5.0, 3), (1, 15.0, 4), (1, 10.0, 5)]
    got = binning.nested_bins(frame(spark, rows, "g int, v double, id int"), "g", "v", "id", 2, "b").orderBy("id").collect()
    assert [r["b"] for r in got] == ["0.0", "0.1", "0.0", "1.0", "1.1", "1.0"]


def test_special_functions(spark):
    xs = [0.5, 1.0, 3.0, 7.5, 40.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", lgamma(F.col("x")).alias("g"), normal_sf(F.col("x") - 3).alias("p")).collect()
    for r in got:
        assert r["g"] == pytest.approx(math.lgamma(r["x"]), abs=1e-9)
        assert r["p"] == pytest.approx(0.5 * math.erfc((r["x"] - 3) / math.sqrt(2)), abs=1e-12)
    p = spark.createDataFrame([([0.2, None, 0.2],), ([],)], "p array<double>").select(cauchy_combined(F.col("p")).alias("c")).collect()
    assert p[0]["c"] == pytest.approx(0.2) and p[1]["c"] is None


def simulated(spark, n=400, pairs_=8):
    rng = np.random.default_rng(123)
    slopes = [-0.3, -0.2, -0.1, 0, 0.1, 0.2, 0.3, 0.4]
    x = rng.poisson(1.2, (pairs_, n))
    y = rng.poisson(np.exp(0.35 + np.array(slopes)[:, None] * x))
    long = lambda m: frame(spark, [(c, k, float(m[k, c])) for k in range(pairs_) for c in range(n) if m[k, c]], "cell_id long, feature_id long, value double")
    return x, y, long(x), long(y), frame(spark, [(k, k, k) for k in range(pairs_)], "link_id long, x_id long, y_id long")


def test_poisson_fit_matches_newton(spark):
    x, y, lx, ly, links = simulated(spark)
    got = {r["link_id"]: r for r in pairs.poisson_fit(pairs.histograms(links, lx, ly, 400), tolerance=1e-10).collect()}
    for k in range(8):
        b, se, _ = newton.fitted(np.column_stack([np.ones(400), x[k]]), y[k].astype(float))
        assert got[k]["b0"] == pytest.approx(b[0], abs=1e-6) and got[k]["b1"] == pytest.approx(b[1], abs=1e-6) and got[k]["se"] == pytest.approx(se[1], abs=1e-5)


def test_correlations_match_numpy(spark):
    x, y, lx, ly, links = simulated(spark)
    p = {r["link_id"]: r["corr"] for r in pairs.pearson(links, lx, ly, 400).collect()}
    s = {r["link_id"]: r["corr"] for r in pairs.spearman(links, lx, ly, 400).collect()}
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    for k in range(8):
        assert p[k] == pytest.approx(np.corrcoef(x[k], y[k])[0, 1], abs=1e-9)
        assert s[k] == pytest.approx(np.corrcoef(rank(x[k]), rank(y[k]))[0, 1], abs=1e-9)


def test_control_features_are_distinct_others_of_the_bin(spark):
    f = frame(spark, [(i, "a" if i % 2 else "b") for i in range(40)], "feature_id long, bin string")
    got = nulls.control_features(f, "bin", 6, seed=1).collect()
    by = {}
    for r in got:
        by.setdefault(r["feature_id"], []).append(r["ctrl_id"])
    assert all(len(set(c)) == 6 and i not in c and all((j - i) % 2 == 0 for j in c) for i, c in by.items()) and len(by) == 40


def test_control_pairs_are_distinct(spark):
    a = frame(spark, [(i, "a") for i in range(7)], "id long, bin string")
    b = frame(spark, [(i, "b") for i in range(11)], "id long, bin string")
    got = [(r["left_id"], r["right_id"]) for r in nulls.control_pairs(a, b, 60, seed=4).collect()]
    assert len(got) == 60 == len(set(got))


def test_average_precision_of_perfect_and_reversed_order(spark):
    rows = [(i, float(i), i >= 6) for i in range(10)]
    d = frame(spark, rows, "id int, s double, label boolean")
    assert metrics.average_precision(d, "s", "label").first()["ap"] == pytest.approx(1.0)
    assert metrics.average_precision(d.withColumn("s", -F.col("s")), "s", "label").first()["ap"] < 0.5


def test_meta_analysis_without_heterogeneity(spark):
    d = frame(spark, [(1.0, 0.5), (1.0, 0.5), (1.0, 1.0)], "e double, s double")
    got = meta.combined(d, "e", "s").first()
    assert got["estimate"] == pytest.approx(1.0) and got["tau2"] == 0 and got["se"] == pytest.approx(1 / 3)


def test_specificity_bounds(spark):
    d = spark.createDataFrame([([1.0, 1.0, 1.0],), ([1.0, 0.0, 0.0],), ([0.0, 0.0],)], "v array<double>")
    got = [r[0] for r in d.select(specificity.entropy_specificity(F.col("v"), min_total=0.1)).collect()]
    assert got[0] == pytest.approx(0, abs=1e-9) and got[1] > 0.99 and got[2] is None


def scored(spark, n=60):
    rng = np.random.default_rng(8)
    return frame(spark, [(i, bool(rng.random() < 0.4), float(rng.random()), float(rng.random())) for i in range(n)], "id long, label boolean, a double, b double")


def test_weights_stand_for_copies_in_every_default_metric(spark):
    d = scored(spark).withColumn("weight", (F.col("id") % 3).cast("int"))
    copies = d.filter("weight > 0").withColumn("c", F.explode(F.sequence(F.lit(1), F.col("weight")))).withColumn("id", F.col("id") * 10 + F.col("c"))
    for m in evaluation.defaults():
        got, want = m.make(d, "a", "label", "id", [], "weight").first()[m.name], m.make(copies, "a", "label", "id", [], None).first()[m.name]
        assert got == pytest.approx(want), m.name


def test_draws_keep_class_counts(spark):
    d = scored(spark)
    gold = d.filter("label").count()
    got = metrics.drawn(d, 5, "id", ["label"], seed=2).groupBy("rep").agg(F.sum("weight").alias("n"), F.sum(F.when(F.col("label"), F.col("weight"))).alias("g"), F.max("weight").alias("m")).collect()
    assert len(got) == 6 and all(r["n"] == 60 and r["g"] == gold and (r["m"] > 1) == (r["rep"] > 0) for r in got)


def test_bootstrap_covers_all_metrics(spark):
    d = scored(spark)
    got = {(r["method"], r["metric"]): r for r in evaluation.bootstrap(d, ["a", "b"], "label", "id", 8, by_class=True).collect()}
    assert len(got) == 12 and all(r["ci_lower"] <= r["ci_upper"] and r["n_bootstrap"] == 8 for r in got.values())
    for m in evaluation.defaults():
        assert got["b", m.name]["estimate"] == pytest.approx(m.make(d, "b", "label", "id", []).first()[m.name])


def test_bootstrap_odds_ratio(spark):
    d = frame(spark, [(i, i % 10 < (7 if i < 100 else 3), i < 100) for i in range(200)], "id long, y boolean, label boolean")
    got = metrics.bootstrap_odds_ratio(d, "y", "label", "id", 100).first()
    assert got["or_point"] == pytest.approx(70.5 * 70.5 / (30.5 * 30.5)) and got["fisher_p"] < 1e-6 and got["n_boot_finite"] == 100
    assert 1 < got["ci_lower"] < got["or_point"] < got["ci_upper"] and got["boot_p"] > 0.5


def test_interpolated_survival(spark):
    got = pvalues.interpolated(frame(spark, [(1, 0, 2.0), (2, 0, 0.0), (3, 0, 9.0)], "key int, grp int, value double"), frame(spark, [(0, float(v)) for v in (1, 2, 3, 4)], "grp int, ctrl double"), "value", "ctrl", "key", "grp")
    assert {r["key"]: (r["value"], r["survival"]) for r in got.collect()} == {1: (2.0, 0.5), 2: (0.0, 1.0), 3: (9.0, 0.0)}


def test_cluster_bootstrap_draws_whole_sets(spark):
    d = frame(spark, [(s, float(x), float(s * x)) for s in range(1, 5) for x in range(3)], "s int, x double, y double")
    got = {r["rep"]: r["slope"] for r in meta.bootstrap_slope(d, "x", "y", "s", 20).collect()}
    assert len(got) == 21 and got[0] == pytest.approx(2.5) and all(b * 4 == pytest.approx(round(b * 4)) for b in got.values()) and len(set(got.values())) > 2


def test_control_links_are_fitted_by_spearman(spark):
    x = frame(spark, [(c, 0, float(c)) for c in range(1, 9)], "cell_id long, feature_id long, value double")
    y = frame(spark, [(c, 0, float(c**3)) for c in range(1, 9)], "cell_id long, feature_id long, value double")
    got = jobs.fit(frame(spark, [("a", 0, 0)], "grp string, x_id long, y_id long"), x, y, 10, "spearman").first()
    assert got["grp"] == "a" and got["beta"] == pytest.approx(1.0)


def test_short_bins_are_refused(spark):
    x = frame(spark, [(c, f, float(1 + f)) for f in range(4) for c in range(f + 1)], "cell_id long, feature_id long, value double")
    for config in ("2.1.2.1.5", "2.1.inf.inf.2"):
        with pytest.raises(ValueError, match="fewer controls than asked"):
            jobs.generate_controls(x, x, 10, jobs.Bins.parse(config))
    for config, rows in (("2.1.2.1.4", 16), ("2.1.inf.inf.1", 4)):
        assert jobs.generate_controls(x, x, 10, jobs.Bins.parse(config))[0].count() == rows


def test_links_tell_the_shortfall_of_their_bin(spark):
    xb = frame(spark, [(0, "a"), (1, "a"), (2, "a"), (3, "b")], "feature_id long, bin string")
    links = frame(spark, [(0, 0, "a_a"), (3, 3, "b_b"), (0, 3, "a_b")], "x_id long, y_id long, grp string")
    got = {r["grp"]: r["ctrl_short"] for r in jobs.with_shortfall(links, xb, xb, jobs.Bins.parse("2.1.2.1.5")).collect()}
    assert got == {"a_a": 0, "b_b": 4, "a_b": 2}
    got = {r["grp"]: r["ctrl_short"] for r in jobs.with_shortfall(links, xb, None, jobs.Bins.parse("2.1.inf.inf.2")).collect()}
    assert got == {"a_a": 0, "b_b": 2, "a_b": 0}


def test_curve_over_whole_range_and_unscored_rows(spark):
    rows = lambda labels, scores=None: spark.createDataFrame([(i, float(i) if scores is None else scores[i], bool(x)) for i, x in enumerate(labels)], "id long, s double, y boolean")
    got = metrics.auerc(rows([1, 0, 0, 1]), "s", "y", "id", weighted=False).first()["auerc"]
    assert abs(got - (0.5 * 2 + 0.5 * (2 / 3 + 1) / 2)) < 1e-12
    # a gold row without a score counts among all gold rows
    some = rows([1, 0, 1, 1], [0.0, 1.0, 2.0, None])
    curve = metrics.enrichment_curve(some, "s", "y", "id").orderBy("id").collect()
    assert [round(r["recall"], 9) for r in curve] == [round(1 / 3, 9), round(1 / 3, 9), round(2 / 3, 9)]
    assert metrics.auerc(rows([0, 0]), "s", "y", "id").first()["auerc"] is None
    assert metrics.top_k_log_odds(some, "s", "y", "id").count() == 3
    assert metrics.partial_average_precision(rows([0, 1, 0, 0]).withColumn("s", -F.col("s")), "s", "y", 0.2).first()["pap"] is not None
    assert metrics.partial_average_precision(rows([1, 0]).withColumn("s", -F.col("s")), "s", "y", 0.2).first()["pap"] is None


def test_curve_weights_are_copies(spark):
    rng = random.Random(4)
    rows = [(i, rng.random(), rng.random() < 0.3, rng.randrange(4)) for i in range(80)]
    one = spark.createDataFrame(rows, "id long, s double, y boolean, w int")
    many = spark.createDataFrame([(k * 100 + c, s, y, 1) for k, (_, s, y, w) in enumerate(rows) for c in range(w)], "id long, s double, y boolean, w int")
    for make in (lambda d, w: metrics.auerc(d, "s", "y", "id", weight=w), lambda d, w: metrics.auerc(d, "s", "y", "id", weighted=False, max_recall=0.2, weight=w), lambda d, w: metrics.auorc(d, "s", "y", "id", weight=w)):
        a, b = make(one, "w").first()[0], make(many, None).first()[0]
        assert abs(a - b) < 1e-9


def test_false_discovery_counts_only_statistics_that_are_there(spark):
    obs = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, None), (4, None)], "key long, v double")
    ctrl = spark.createDataFrame([(2.0,), (0.0,), (0.0,), (0.0,)], "c double")
    got = pvalues.empirical_fdr(obs, ctrl, "v", "c", "key")
    assert {r["key"]: r["q_value"] for r in got.collect()} == {1: 0.0, 2: 0.25, 3: None, 4: None}
    assert pvalues.fdr_threshold(got, "v", 0.1).first()["t_star"] == 3.0 and pvalues.fdr_threshold(got, "v", 0.3).first()["t_star"] == 3.0


def test_controls_of_two_features_overlap_as_chance_has_it(spark):
    f = spark.range(2000).select((F.col("id") * 25).alias("feature_id"), F.lit("a").alias("bin"))
    got = {}
    for r in nulls.control_features(f, "bin", 100, seed=1).filter("feature_id < 1500").collect():
        got.setdefault(r["feature_id"], []).append(r["ctrl_id"])
    assert all(len(set(v)) == 100 and k not in v for k, v in got.items()) and len(got) == 60
    shared = [len(set(a) & set(b)) for a, b in itertools.combinations(got.values(), 2)]
    assert 4 < sum(shared) / len(shared) < 6 and max(shared) < 25
    small = nulls.control_features(spark.range(8).select(F.col("id").alias("feature_id"), F.lit(0).alias("bin")), "bin", 5).collect()
    assert len(small) == 40 and len({(r["feature_id"], r["ctrl_id"]) for r in small}) == 40
    pairs = nulls.control_pairs(spark.range(300).select("id", F.lit("x").alias("bin")), spark.range(200).select("id", F.lit("y").alias("bin")), 500, seed=2).collect()
    assert len({(r["left_id"], r["right_id"]) for r in pairs}) == 500
    assert 200 < len({r["left_id"] for r in pairs}) and 150 < len({r["right_id"] for r in pairs})


def test_width_bins_against_plain_python(spark):
    rng = np.random.default_rng(2)
    for x, q, least in ((rng.exponential(size=400) ** 2, 5, 30), (rng.normal(size=300), 4, 5), (rng.exponential(size=60), 6, 20), (np.repeat([1.0, 2.0, 9.0], 20), 3, 30)):
        cut = lambda k, x=x: np.maximum((x[:, None] > x.min() + np.arange(k) * ((x.max() - x.min()) / k)).sum(1) - 1, 0)
        quantile = lambda v, k: np.maximum((v[:, None] > np.unique(np.quantile(v, np.arange(k + 1) / k))[:-1]).sum(1) - 1, 0)
        label, low, m = cut(q), q - q // 2, 1
        while np.unique(label, return_counts=True)[1].min() < least:
            if m > len(np.unique(x)) // least:
                label = quantile(x, q)
                break
            label = cut(q * m)
            up = label >= low
            label[up] = low + quantile(x[up], low)
            m += 1
        rows = binning.width_bins(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, v double"), "v", "id", q, least, "b").orderBy("id").collect()
        assert [r["b"] for r in rows] == label.tolist()


def test_names_of_chromosomes_and_peaks(spark):
    names = ["1", "X", "x", "MT", "M", "chrMT", "chr1", "GL1", None]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, n string").orderBy("i").select(strings.normal_chromosome(F.col("n"))).collect()]
    assert got == ["chr1", "chrX", "x", "chrM", "chrM", "chrMT", "chr1", "GL1", None]
    peaks = ["1:100-200", "chr1-100-200", " CHRx:5-9 ", "chr1:100:200", "1-100", "chrUn:1-2", "a b", "mt-1-2", "1:-1-2", "", "chr:1-2", "1-2:3-4"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(peaks)], "i long, n string").orderBy("i").select(strings.canonical_peak(F.col("n"))).collect()]
    assert got == ["chr1:100-200", "chr1:100-200", "chrX:5-9", "chr1:100:200", "1-100", "chrUn:1-2", "a b", "chrMT:1-2", "1:-1-2", "", "chr:1-2", "1-2:3-4"]


def test_difference_of_the_reference_from_itself_is_none(spark):
    """Estimates that come out a little differently each time they are made, as sums in another order do."""
    noise = F.udf(lambda v: v + random.random() * 1e-12, "double").asNondeterministic()
    est = spark.createDataFrame([(m, rep, 0.5 + rep * 0.01) for m in ("a", "b") for rep in range(9)], "method string, rep int, v double").withColumn("v", noise("v"))
    got = {r["method"]: r for r in metrics.paired_difference(est, "v", "method", "b").collect()}
    assert [got["b"][c] for c in ("diff_estimate", "diff_ci_lower", "diff_ci_upper", "p_value")] == [0.0, 0.0, 0.0, 1.0]
    assert abs(got["a"]["diff_estimate"]) < 1e-11


def test_observations_and_controls_are_standardised_by_the_same_numbers(spark):
    """A mean made twice, its sum in another order, would part an observation from the control that equals it."""
    ctrl = spark.createDataFrame([("g", v) for v in (0.1, 0.2, 0.7)], "g string, c double")
    obs = ctrl.select(F.monotonically_increasing_id().alias("k"), "g", F.col("c").alias("v"))
    o, c = pvalues.centred(obs, ctrl, "v", "c", "g")
    made_once = lambda df: {f for f in df.inputFiles() if "moments" in f}
    assert made_once(o) and made_once(o) == made_once(c)
    assert sorted(r["v"] for r in o.collect()) == sorted(r["c"] for r in c.collect())


def test_equal_controls_have_no_deviation_however_they_are_dealt(spark):
    """Eleven in each of two tasks: their mean times eleven, over eleven, isn't theirs."""
    some = lambda n, tasks: spark.range(0, n, 1, tasks).select(F.lit("g").alias("g"), (F.col("id") * 0 + 100.0).alias("c"), F.lit(0.5).alias("se"))
    ctrl = some(22, 2)
    obs = spark.createDataFrame([(0, "g", 100.0), (1, "g", 99.0)], "k int, g string, v double")
    assert [r["ppval"] for r in pvalues.pooled(obs, ctrl, "v", "c", "k", "g").collect()] == [None, None]
    assert {r["k"]: (r["z"], r["zpval"]) for r in pvalues.z_scores(obs, ctrl, "v", "c", "g").collect()} == {0: (None, None), 1: (-math.inf, 1.0)}
    assert sorted(r["v"] for r in pvalues.centred(obs, ctrl, "v", "c", "g", "se")[0].collect()) == [-2.0, 0.0]
    assert pvalues.centred(obs, some(1, 1), "v", "c", "g", "se")[0].count() == 0


def test_histograms_with_many_links_of_a_feature(spark, monkeypatch):
    """More links than stand in a row, second features in more than one block, cells without any y, features that nothing has."""
    monkeypatch.setattr(pairs, "TOGETHER", 4)
    rng = random.Random(7)
    x = [(c, f, float(rng.randint(1, 3))) for c in range(60) for f in range(3) if rng.random() < 0.6]
    y = [(c, f, float(rng.randint(1, 3))) for c in range(50) for f in range(11) if rng.random() < 0.4]
    links = spark.createDataFrame([(f"{a};{b}", a, b) for a in range(4) for b in range(12)] + [("again", 0, 0)], "link_id string, x_id long, y_id long")
    long = lambda rows: spark.createDataFrame(rows, "cell_id long, feature_id long, value double")
    got = {r["link_id"]: [tuple(b) for b in r["hist"]] for r in pairs.histograms(links, long(x), long(y), 60).collect()}
    sums = {r["link_id"]: r["sxy"] for r in pairs.cross_sums(links, long(x), long(y)).collect()}
    at = {(c, f): v for c, f, v in y}
    assert len(got) == len(sums) == 49
    for link, a, b in [(f"{a};{b}", a, b) for a in range(4) for b in range(12)] + [("again", 0, 0)]:
        of = {c: v for c, f, v in x if f == a}
        bars = {v: (sum(1 for w in of.values() if w == v), sum(at.get((c, b), 0.0) for c, w in of.items() if w == v)) for v in of.values()}
        rest = sum(v for (c, f), v in at.items() if f == b and c not in of)
        assert got[link] == [(0.0, 60.0 - len(of), rest)] + [(v, *map(float, bars[v])) for v in sorted(bars)]
        assert sums[link] == sum(v * at.get((c, b), 0.0) for c, v in of.items())


def test_rows_of_a_join_of_links_dont_grow_with_links(spark):
    links = spark.createDataFrame([(b, 0, b) for b in range(16)], "link_id long, x_id long, y_id long")
    m = spark.createDataFrame([(c, f, 1.0) for c in range(30) for f in range(16)], "cell_id long, feature_id long, value double")
    placed, rows, names = pairs.beside(links, m.filter("feature_id = 0"), m)
    assert placed.count() == 16 and rows.count() == 60 and len(names) == pairs.WIDTH


def test_draws_of_a_feature_stay_in_its_row(spark):
    """No draw is a row of its own: what is shuffled before the names are joined are the features."""
    f = spark.range(400).select(F.col("id").alias("feature_id"), F.lit("b").alias("bin"))
    got = nulls.control_features(f, "bin", 5, seed=3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and got.count() == 2000
