"""Readers and writers on small files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanloom.functions import strings
from spanloom.operators import dedup, intervals
from spanloom.plans.jobs import Bins
from spanloom.sources import readers, writers


def test_bed_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("chr1", 1, 5, "a;b"), ("chr2", 3, 9, "c;d")], "chrom string, start long, end long, name string")
    writers.bed(d, str(tmp_path / "x"), ["chrom", "start", "end", "name"])
    assert sorted(map(tuple, readers.bed(spark, str(tmp_path / "x"), "name string").collect())) == sorted(map(tuple, d.collect()))


def test_gene_starts(spark, tmp_path):
    (tmp_path / "g.gtf").write_text('#x\n1\ts\tgene\t10\t50\t.\t+\t.\tgene_id "ENSG1.2"; gene_name "A";\nchr2\ts\tgene\t7\t90\t.\t-\t.\tgene_id "ENSG2"; gene_name "B";\n1\ts\texon\t1\t2\t.\t+\t.\tgene_id "ENSG3";\n1\ts\tgene\t99\t100\t.\t+\t.\tgene_id "ENSG1.3";\n')
    got = {r["gene_id"]: (r["chrom"], r["tss"]) for r in readers.gene_starts(spark, str(tmp_path / "g.gtf")).collect()}
    assert got == {"ENSG1": ("chr1", 10), "ENSG2": ("chr2", 90)}
    (tmp_path / "e.gtf").write_text("#none\n")
    with pytest.raises(ValueError):
        readers.gene_starts(spark, str(tmp_path / "e.gtf"))


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate\n% c\n3 4 2\n1 2 5\n3 4 1.5\n")
    assert sorted(map(tuple, readers.matrix_market(spark, str(tmp_path / "m.mtx")).collect())) == [(0, 1, 5.0), (2, 3, 1.5)]


def test_validation_overlaps(spark, tmp_path):
    (tmp_path / "v.bed").write_text("chr1\t1\t5\tt1;True;G1\tchr1\t2\t6\tp;G1\t3\nchr1\t1\t5\tt2;False;G1\tchr1\t2\t6\tp;G2\t3\n")
    got = readers.validation_overlaps(spark, str(tmp_path / "v.bed"), ["id", "score", "gene"]).collect()
    assert [(r["gt_score"], r["peak"], r["gene"]) for r in got] == [(1.0, "p", "G1")]


def test_chunks(spark, tmp_path):
    for name in ("c_0_5", "c_5_9", "c_12_20"):
        (tmp_path / name).write_text("x")
    ranges = readers.chunk_ranges(spark, str(tmp_path), "c")
    assert [tuple(r) for r in readers.gaps(ranges).collect()] == [(9, 12, 3)]


def test_upsert_and_square(spark):
    m = spark.createDataFrame([("a", "b", "n", 1.0), ("a", "a", "n", 5.0)], "a string, b string, metric string, value double")
    e = spark.createDataFrame([("a", "b", "n", 2.0)], m.schema)
    got = writers.square(writers.with_matrix_entry(m, e), "n", ["a", "b"]).first()
    assert (got["a"], got["b"]) == ("a", 2.0) or got[1:] == (5.0, 2.0)


def test_partitions_are_replaced_alone(spark, tmp_path):
    d = spark.createDataFrame([(1, "x"), (2, "y")], "v int, bin string")
    writers.partitioned(d, str(tmp_path / "p"), "bin")
    writers.partitioned(d.filter("bin = 'x'").withColumn("v", F.lit(9)), str(tmp_path / "p"), "bin")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).collect())) == [(2, "y"), (9, "x")]


@pytest.mark.parametrize(("name", "want"), [("1:5-9", "chr1:5-9"), ("chrX-5-9", "chrX:5-9"), (" CHRmt:1-2", "chrMT:1-2"), ("scaffold", "scaffold"), (None, None)])
def test_canonical_peak(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(strings.canonical_peak(F.col("n"))).first()[0] == want


def test_interval_join_against_brute_force(spark):
    import random

    rng = random.Random(4)
    make = lambda n: [(i, f"c{rng.randrange(3)}", s := rng.randrange(500), s + rng.randrange(0, 90)) for i in range(n)]
    a, b = make(200), make(200)
    got = {(r["id"], r["rid"]): r["overlap"] for r in intervals.overlap_join(spark.createDataFrame(a, "id int, chrom string, start int, end int"), spark.createDataFrame(b, "rid int, r_chrom string, r_start int, r_end int"), 40).collect()}
    want = {(i, j): min(e, f) - max(s, t) for i, c, s, e in a for j, d, t, f in b if c == d and s < f and t < e and e > s and f > t}
    assert got == want


def test_merge_refuses_repeated_keys(spark):
    d = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, v double")
    with pytest.raises(ValueError):
        dedup.left_merge(d, d, ["k"])


def test_bins_parse():
    assert Bins.parse("5.5.inf.inf.100").one_sided and Bins.parse("5.4.3.2.100").second_nested == 2
