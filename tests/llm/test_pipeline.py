"""Stages of the pipeline one by one, each on what its predecessor kept."""

from __future__ import annotations

import corpus_pipeline
from tests.llm import brute

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, {r["doc_id"]: r for r in docs.collect()})
        assert docs.columns[: len(columns)] == columns and (name == "mixing" or docs.columns == columns)
    before, after = seen["near_duplicates"]
    assert set(after) == {root for _, root in brute.jaccard(before, 5, 80).values()}
    before, after = seen["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(after) == {i for i, w in brute.leaks(before, items).items() if not w[4]}
    before, after = seen["personal_data"]
    assert set(after) == {i for i, _ in before}
    for i, t in before:
        assert brute.pii(after[i]["text"]) == [] and (after[i]["text"] == t) == (not brute.pii(t)) and after[i]["n_chars"] == len(after[i]["text"])
    before, after = seen["mixing"]
    assert all(r["copies"] in (1, 2) and r["taken"] == r["copies"] * r["size"] for r in after.values())


def test_stages_take_odd_tables(spark, tmp_path):
    rows = [(1, "a b c d e f g h", "en", None, 15), (1, "a b c d e f g h", "en", None, 15), (2, None, None, "s", None), (3, "", "en", "s", 0), (None, "mail a@b.co now", "en", "s", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("keep", "key", "log_weight", "_bytes", "_text", "base", "spans", "loose", "n_hit", "_runs", "_items", "size", "copies", "_h", "_s", "region", "_gone"):
        docs = docs.withColumn(c, docs["doc_id"].cast("string"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DIR).write.parquet(str(tmp_path / f"odd-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"odd-{name}"))
        assert name == "mixing" or docs.columns == columns
        if name == "near_duplicates":
            assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 1, 2, 3]
        if name == "personal_data":
            assert sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect() if r["text"] is not None) == [(0, "mail <EMAIL> now"), (1, "a b c d e f g h"), (3, "")]


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0
