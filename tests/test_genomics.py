"""Sequences, counts by position, causal enrichment, permutations and blocks of ties, against plain Python."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import causal, nulls, ties
from spanloom.sources import fasta


def gc(seq):
    g, k = sum(c in "GCSgcs" for c in seq), sum(c in "GCSATUWgcsatuw" for c in seq)
    return g / k if k else 0.0


@pytest.fixture()
def genome(tmp_path):
    rng = random.Random(2)
    seqs = {"chr1": "".join(rng.choices("ACGTNacgtSW", k=5000)), "chr2": "ACGT" * 10, "empty": "", "chr3": "".join(rng.choices("ACGT", k=997)), "n": "N" * 50}
    (tmp_path / "fa").mkdir()
    lines = lambda names: "ACGT before any header\n" + "".join(f">{n} some words\n" + "".join(seqs[n][i : i + 60] + "\n" for i in range(0, len(seqs[n]), 60)) for n in names)
    (tmp_path / "fa/a.fa").write_text(lines(["chr1", "chr2", "empty"]))
    (tmp_path / "fa/b.fa").write_text(lines(["chr3", "n"]))
    return str(tmp_path / "fa"), seqs


@pytest.mark.parametrize(("piece", "split"), [(8192, "128m"), (100, "700b"), (7, "61b")])
def test_sequences_and_gc_over_splits(spark, genome, piece, split):
    path, seqs = genome
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        pieces = fasta.sequences(spark, path, piece)
        found = {}
        for r in pieces.orderBy("chrom", "start").collect():
            assert r["start"] == len(found.get(r["chrom"], "")) and r["end"] - r["start"] == len(r["bases"]) <= piece
            found[r["chrom"]] = found.get(r["chrom"], "") + r["bases"]
        assert found == {k: v for k, v in seqs.items() if v}
        rng = random.Random(3)
        peaks = [(k, c, a, a + rng.randint(0, 300)) for k, c in enumerate(rng.choices(["chr1", "chr2", "chr3", "n"], k=60)) for a in [rng.randint(0, max(1, len(seqs[c]) - 50))]] + [(100, "chr1", 0, 5000), (101, "chr1", 4990, 9999), (102, "unknown", 0, 10), (103, "chr2", 39, 40), (104, "empty", 0, 5), (105, "chr1", 9000, 9999)]
        got = {r["peak_id"]: r["gc"] for r in fasta.gc_content(spark.createDataFrame(peaks, "peak_id long, chrom string, start long, end long"), pieces, piece=piece).collect()}
        assert got == {k: pytest.approx(gc(seqs[c][a:z])) if seqs.get(c) else None for k, c, a, z in peaks}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_a_sequence_that_stands_twice_is_refused(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nAC\n>x\nGT\n")
    with pytest.raises(ValueError, match="twice"):
        fasta.sequences(spark, str(tmp_path / "a.fa"))


def test_counts_between(spark):
    rng = random.Random(5)
    points = [(rng.choice("ab"), rng.randint(0, 50)) for _ in range(300)] + [(None, 3), ("a", None)]
    spans = [(k, rng.choice("abc"), a, a + rng.randint(-1, 20)) for k in range(80) for a in [rng.randint(-3, 55)]] + [(90, None, 1, 2), (91, "a", None, 5)]
    got = {r["id"]: r["n_points"] for r in causal.counts_between(spark.createDataFrame(spans, "id long, chrom string, start long, end long"), spark.createDataFrame(points, "chrom string, pos long"), "id").collect()}
    assert got == {k: None if c is None or a is None else sum(p == c and q is not None and a <= q <= z for p, q in points) for k, c, a, z in spans}


@pytest.mark.parametrize("threshold", [0.5, 7, 1000])
def test_causal_enrichment(spark, threshold):
    rng = random.Random(6)
    genes = [f"g{k}" for k in range(8)]
    causal_rows = [(k, rng.choice(genes), rng.choice(genes[:4]), rng.random(), rng.choice([None, rng.random()])) for k in range(120)]
    common = [(rng.choice(genes[:6]),) for _ in range(60)]
    annotated, reference = genes[:7] * 2, [(rng.choice(genes[1:]), rng.random()) for _ in range(40)] + [("g1", 0.0), ("other", 1.0)]
    variants = [("chr1", rng.randint(0, 100)) for _ in range(200)]
    windows = [(g, "chr1" if k < 6 else "chr9", 10 * k, 10 * k + 25) for k, g in enumerate(genes)]
    make = spark.createDataFrame
    got = causal.causal_enrichment(make(causal_rows, "id long, eqtl_gene string, annotated_gene string, probability double, p double"), make(common, "annotated_gene string"), make([(a,) for a in annotated], "gene string"), make(reference, "gene string, probability double"), make(variants, "chrom string, pos long"), make(windows, "gene string, chrom string, start long, end long"), "p", threshold).collect()
    ranked = sorted(causal_rows, key=lambda r: (r[4] is None, r[4] or 0, r[0]))
    chosen = ranked[:threshold] if isinstance(threshold, int) else [r for r in causal_rows if r[4] is not None and r[4] < threshold]
    want = {}
    for g in set(annotated) & {r[0] for r in reference}:
        pip, n = sum(r[3] for r in chosen if r[1] == r[2] == g), sum(c[0] == g for c in common)
        total = sum(p for h, p in reference if h == g)
        c, a, z = next(w[1:] for w in windows if w[0] == g)
        inside = sum(p == c and a <= q <= z for p, q in variants)
        want[g] = 0.0 if not total or not n else (pip / n) / (total / inside) if inside else None
    assert {r["gene"]: r["enrichment"] for r in got} == {g: v if v is None else pytest.approx(v) for g, v in want.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 17, 100, 101, 1000, 4099])
def test_permutations_are_one_to_one(spark, n):
    d = spark.range(n).withColumns({f"p{s}": nulls.permuted(F.col("id"), n, s) for s in (1, 2)})
    rows = d.collect()
    assert sorted(r["p1"] for r in rows) == sorted(r["p2"] for r in rows) == list(range(n))
    if n >= 100:
        a, b = np.array([r["p1"] for r in rows]), np.array([r["p2"] for r in rows])
        at = np.arange(n)
        assert (a == b).mean() < 0.1 and abs(np.corrcoef(at, a)[0, 1]) < 4 / math.sqrt(n) and abs(np.corrcoef(a[:-1], a[1:])[0, 1]) < 5 / math.sqrt(n)


def test_permutation_null_is_centred(spark):
    rng = np.random.default_rng(1)
    n = 300
    x = rng.poisson(1.0, n)
    long = lambda v: spark.createDataFrame([(c, 0, float(k)) for c, k in enumerate(v.tolist()) if k], "cell_id long, feature_id long, value double")
    got = nulls.permutation_null(spark.createDataFrame([(7, 0, 0)], "link_id long, x_id long, y_id long"), long(x), long(x + rng.poisson(0.2, n)), n, 200).collect()
    r = np.array([g["corr"] for g in got])
    assert {g["rep"] for g in got} == set(range(1, 201)) and {g["link_id"] for g in got} == {7}
    assert abs(r.mean()) < 4 / math.sqrt(200 * n) and r.std() == pytest.approx(1 / math.sqrt(n - 1), rel=0.2)


def test_tops_are_the_mean_over_all_orders(spark):
    rows = [(0.1, True), (0.2, False), (0.2, True), (0.2, False), (0.7, True), (0.7, False), (None, True)]
    d = spark.createDataFrame([(k, s, l) for k, (s, l) in enumerate(rows)], "id long, s double, l boolean")
    got = {r["top"]: r for r in ties.expected_tops(d, "s", "l", [1, 2, 3, 4, 5, 6, 7]).collect()}
    orders = [[rows[0], *b, *c] for b in itertools.permutations(rows[1:4]) for c in itertools.permutations(rows[4:6])]
    assert set(got) == {1, 2, 3, 4, 5, 6}
    for k in got:
        tp = np.mean([sum(l for _, l in o[:k]) for o in orders])
        assert got[k]["tp"] == pytest.approx(tp) and got[k]["precision"] == pytest.approx(tp / k) and got[k]["recall"] == pytest.approx(tp / 3)
        cells = np.array([tp, k - tp, 3 - tp, 6 - k - (3 - tp)]) + 0.5
        odds, half = cells[0] * cells[3] / (cells[1] * cells[2]), 1.959963984540054 * math.sqrt((1 / cells).sum())
        assert [got[k]["odds_ratio"], got[k]["ci_lower"], got[k]["ci_upper"]] == pytest.approx([odds, odds * math.exp(-half), odds * math.exp(half)])


def test_curve_of_blocks(spark):
    rows = [(0.1, True), (0.2, False), (0.2, True), (0.3, False), (0.7, True), (None, True), (float("nan"), False)]
    d = spark.createDataFrame([("m", s, l) for s, l in rows], "m string, s double, l boolean")
    points = lambda **k: sorted((round(r["recall"], 9), round(r["enrichment"], 9)) for r in ties.curve(d, "s", "l", ["m"], **k).collect())
    base = 4 / 7
    want = [(0.25, 1 / base), (0.5, 2 / 3 / base), (0.75, 3 / 5 / base)]
    assert points() == [pytest.approx(w) for w in want]
    assert points(min_recall=0.3, max_recall=0.6) == [pytest.approx(want[1])]
    assert points(extrapolate=True) == [pytest.approx(w) for w in [*want, (1.0, 1.0)]]
    assert ties.curve(d.filter("not l"), "s", "l", ["m"]).count() == 0


def test_odds_by_regime(spark):
    rng = random.Random(9)
    rows = [(rng.choice("xy"), rng.choice([None, *[k / 10 for k in range(10)]]), rng.random() < 0.4) for _ in range(120)]
    got = {r["g"]: r for r in ties.regime_odds(spark.createDataFrame(rows, "g string, s double, l boolean"), "s", "l", ["g"], 20).collect()}
    for g in "xy":
        own = [(s, l) for h, s, l in rows if h == g]
        scored = [s for s, _ in own if s is not None]
        rank = lambda s: sum(t < s for t in scored) + (sum(t == s for t in scored) + 1) / 2  # noqa: B023, E731
        top = [(s is not None and rank(s) <= 20, l) for s, l in own]
        cells = [sum(t and l for t, l in top), sum(t and not l for t, l in top), sum(not t and l for t, l in top), sum(not t and not l for t, l in top)]
        assert [got[g][c] for c in ("tp", "fp", "fn", "tn")] == cells
        assert got[g]["odds_ratio"] == pytest.approx(cells[0] * cells[3] / (cells[1] * cells[2])) and got[g]["ci_lower"] < got[g]["smoothed"] < got[g]["ci_upper"]


@pytest.mark.parametrize("n", [7, 53, 300])
def test_permutation_null_moves_cells_as_permuted_does(spark, monkeypatch, n):
    """Against a row for each moved cell; over many small blocks, and no more shuffled rows for more replicates."""
    monkeypatch.setattr(nulls, "X_BLOCK", 64)
    monkeypatch.setattr(nulls, "Y_BLOCK", 16)
    rng = np.random.default_rng(n)
    x, y = (spark.createDataFrame([(c, f, float(v)) for f in range(2) for c, v in enumerate(rng.poisson(1.0, n).tolist()) if v], "cell_id long, feature_id long, value double") for _ in range(2))
    links = spark.createDataFrame([("a", 0, 0), ("b", 1, 0), ("c", 1, 1), ("d", 5, 1)], "link_id string, x_id long, y_id long")
    got = {(r["link_id"], r["rep"]): r["corr"] for r in nulls.permutation_null(links, x, y, n, 3, seed=4).collect()}
    moved = y.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("at", nulls.permuted(F.col("cell_id"), n, F.xxhash64("feature_id", "rep", F.lit(4)))).collect()
    dense = {f: np.zeros(n) for f in (0, 1, 5)}
    for r in x.collect():
        dense[r["feature_id"]][r["cell_id"]] = r["value"]
    for link, a, b in (("a", 0, 0), ("b", 1, 0), ("c", 1, 1), ("d", 5, 1)):
        for rep in (1, 2, 3):
            v = np.zeros(n)
            for r in moved:
                if (r["feature_id"], r["rep"]) == (b, rep):
                    v[r["at"]] = r["value"]
            want = ((dense[a] * v).mean() - dense[a].mean() * v.mean()) / np.sqrt(max(dense[a].var(), 1e-8) * max(v.var(), 1e-8))
            assert got[link, rep] == pytest.approx(want, abs=1e-9)
    assert len(got) == 12
