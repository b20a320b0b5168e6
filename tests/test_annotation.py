"""Annotation of intervals and cleaning of tables, by hand and against all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from spanloom.operators import annotation


def spans(spark, n, seed, packed=False):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["chr1", "chr2"]), a, a + rng.randint(1, 30)) for k in range(n) for a in [rng.randint(0, 200)]]
    if packed:
        rows = [(*r, rng.choice(["e1", "e2", "e2;x", "e3;y;z"]), rng.choice(["enh", "prom", None])) for r in rows]
    return rows, spark.createDataFrame(rows, "id long, chrom string, start long, end long" + (", text string, kind string" if packed else ""))


def test_annotated_equals_all_pairs(spark):
    q, dq = spans(spark, 40, 1)
    f, df = spans(spark, 60, 2, packed=True)
    got = {r["id"]: r for r in annotation.annotated(dq.withColumn("text", F.lit("?")), df, "id", "text", "enh", 20, ["a", "b"]).collect()}
    assert len(got) == 40 and got[0]["text"] == "?"
    for k, c, a, z in q:
        hits = sorted((h[4].split(";") + [None, None])[:1] + [h[4]] + (h[4].split(";")[1:] + [None, None])[:2] for h in f if h[1] == c and h[2] < z and a < h[3])
        assert got[k]["enh_sum"] == len(hits)
        assert [got[k]["enh_hits"], got[k]["enh_a"], got[k]["enh_b"]] == [[h[0] for h in hits], [h[2] for h in hits], [h[3] for h in hits]]
    typed = annotation.typed_overlaps(dq, df, "id", "kind", 20).collect()
    assert len(typed) == sum(r["enh_sum"] for r in got.values())
    assert all((r["is_enh"], r["is_prom"]) == {"enh": (1, 0), "prom": (0, 1), None: (0, 0)}[r["f_kind"]] for r in typed)
    half = annotation.typed_overlaps(dq, df, "id", "kind", 20, fraction=0.5).count()
    assert half == sum(h[1] == c and min(z, h[3]) - max(a, h[2]) >= 0.5 * (z - a) and min(z, h[3]) > max(a, h[2]) for _, c, a, z in q for h in f)
    assert annotation.annotated(dq, df.filter("false"), "id", "text", "enh", 20).filter("enh_sum = 0 and size(enh_hits) = 0").count() == 40


def test_cleaning(spark):
    truth = spark.createDataFrame([("r1", "ENSG1", "10.0"), (None, "ENSG2", "5"), ("r3", "GENE", "5"), ("r4", None, "1"), ("r5", "ENSG5", "x")], "region string, gene string, start string")
    assert [tuple(r) for r in annotation.clean_truth(truth).select("region", "start", "end").orderBy("region").collect()] == [("r1", 10, 10), ("r5", None, None)]
    genes = spark.createDataFrame([("chr1", "5", "9"), ("1", "5", "9"), (None, "5", "9")], "chrom string, start string, end string")
    assert [tuple(r) for r in annotation.clean_genes(genes).collect()] == [("chr1", 5, 9)]
