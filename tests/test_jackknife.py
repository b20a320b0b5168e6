"""The jackknife against leaving blocks out one by one."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import jackknife


@pytest.fixture()
def rows():
    rng = np.random.default_rng(3)
    n = 400
    score = np.round(rng.random(n), 2)  # ties
    score[rng.random(n) < 0.05] = np.nan
    gold = (rng.random(n) < 0.3 - 0.2 * np.nan_to_num(score, nan=1.0)).astype(float) * rng.random(n)
    gold[rng.random(n) < 0.1] = np.nan
    return {"id": np.arange(n), "score": score, "gold": gold, "label": rng.random(n) < 0.6 - 0.5 * np.nan_to_num(score, nan=1.0), "chrom": rng.choice(["1", "2", "3", "4"], n, p=[0.5, 0.3, 0.15, 0.05]), "bin": rng.choice(["a", "b", "c"], n)}


def frame(spark, rows):
    none = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    data = [tuple(none(rows[c][k].item()) for c in ("id", "score", "gold", "label", "chrom", "bin")) for k in range(len(rows["id"]))]
    return spark.createDataFrame(data, "id long, score double, gold double, label boolean, chrom string, bin string").repartition(3)


def deviation(stat, left, ratio):
    left, ratio = np.array(left), np.array(ratio)
    tau = ratio * stat - (ratio - 1) * left
    centre = (stat - left).sum() + (left / ratio).sum()
    return math.sqrt(((tau - centre) ** 2 / (ratio - 1)).sum() / len(left))


def odds(top, label):
    tp, fp, fn, tn = (top & label).sum(), (top & ~label).sum(), (~top & label).sum(), (~top & ~label).sum()
    return tp * tn / (fp * fn) if fp * fn else math.inf


def order(rows):
    return np.lexsort((rows["id"], np.nan_to_num(rows["score"], nan=np.inf)))


def test_odds(spark, rows):
    got = {r["top"]: r for r in jackknife.odds_jackknife(frame(spark, rows), "score", "label", "chrom", "id", [20, 100, 150]).collect()}
    for n in (20, 100, 150):
        top = np.zeros(400, bool)
        top[order(rows)[:n]] = True
        left = [odds(top[rows["chrom"] != b], rows["label"][rows["chrom"] != b]) for b in "1234"]
        ratio = [400 / (rows["chrom"] == b).sum() for b in "1234"]
        stat = odds(top, rows["label"])
        assert got[n]["odds_ratio"] == pytest.approx(stat) and got[n]["n_blocks"] == 4 and 0 <= got[n]["fisher_p"] <= 1
        assert [got[n]["ci_lower"], got[n]["ci_upper"]] == pytest.approx(np.percentile(left, [2.5, 97.5]).tolist())
        assert got[n]["jackknife_sd"] == pytest.approx(deviation(stat, left, ratio))


def test_odds_of_tied_methods_and_few_gold_rows(spark, rows):
    d = frame(spark, rows).withColumn("score", F.floor(F.col("score") * 5) / 5)
    ties = d.filter("score = 0").count()
    got = {r["top"]: r["odds_ratio"] for r in jackknife.odds_jackknife(d, "score", "label", "chrom", "id", [ties - 1, ties], tied=F.lit(True)).collect()}
    assert got[ties - 1] is None and got[ties] is not None
    assert jackknife.odds_jackknife(d, "score", "label", "chrom", "id", [20], least_fn=1000).first()["odds_ratio"] is None
    assert jackknife.odds_jackknife(d.filter("false"), "score", "label", "chrom", "id", [20]).count() == 0


def test_enrichment(spark, rows):
    got = {r["top"]: r for r in jackknife.enrichment_jackknife(frame(spark, rows), "score", "gold", "chrom", "id", [20, 100, 399]).collect()}
    assert set(got) == {20, 100}
    seen = ~np.isnan(rows["gold"])
    for n in (20, 100):
        top = np.zeros(400, bool)
        top[order(rows)[:n]] = True

        def share(keep):
            return rows["gold"][keep & top & seen].mean() / rows["gold"][keep & seen].mean()

        everyone = np.ones(400, bool)
        left = [share(rows["chrom"] != b) for b in "1234"]
        ratio = [seen.sum() / (seen & (rows["chrom"] == b)).sum() for b in "1234"]
        assert got[n]["enrichment"] == pytest.approx(share(everyone))
        assert got[n]["jackknife_sd"] == pytest.approx(deviation(share(everyone), left, ratio))


def area(rows, keep, tops):
    ok = keep & ~np.isnan(rows["gold"]) & ~np.isnan(rows["score"])
    at = [i for i in order(rows) if ok[i]]
    gold = rows["gold"][at]
    return sum((b - a) * gold[: (a + b) // 2].mean() / gold.mean() for a, b in zip(tops, tops[1:]))


@pytest.mark.parametrize("segments", [1000, 7])
def test_areas_and_contributions(spark, rows, segments, monkeypatch):
    monkeypatch.setattr(jackknife, "SEGMENTS", segments)
    tops, everyone = [10, 31, 80, 200, 900], np.ones(400, bool)
    d = frame(spark, rows).withColumn("method", F.lit("m"))
    got = jackknife.area_jackknife(d, "score", "gold", "chrom", "id", tops, ["method"]).first()
    stat = area(rows, everyone, tops)
    ok = ~np.isnan(rows["gold"]) & ~np.isnan(rows["score"])
    left = [area(rows, rows["chrom"] != b, tops) for b in "1234"]
    assert got["area"] == pytest.approx(stat) and got["n_blocks"] == 4
    assert [got["ci_lower"], got["ci_upper"]] == pytest.approx(np.percentile(left, [2.5, 97.5]).tolist())
    assert got["jackknife_sd"] == pytest.approx(deviation(stat, left, [ok.sum() / (ok & (rows["chrom"] == b)).sum() for b in "1234"]))
    found = {r["bin"]: r for r in jackknife.bin_contributions(d, "score", "gold", "chrom", "bin", "id", tops, ["method"]).collect()}
    for q in "abc":
        gains = [area(rows, rows["chrom"] != b, tops) - area(rows, (rows["chrom"] != b) & (rows["bin"] != q), tops) for b in "1234"]
        assert found[q]["contribution"] == pytest.approx(stat - area(rows, rows["bin"] != q, tops))
        assert found[q]["se"] == pytest.approx(np.std(gains, ddof=1) * math.sqrt(3))
