"""Queries of this subpackage against SQL where there is some, and against plain Python elsewhere."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm.oracles import ORACLE_SQL
from spanloom.llm.queries import QUERIES
from tests.llm import brute
from tests.oracle import database, differences

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    assert differences(QUERIES[name](spark, DIR), ORACLE_SQL[name], database(DIR)) == []


def test_mixing_meets_its_targets(spark):
    rows = QUERIES["op3_mixing"](spark, DIR).join(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)


def test_decontamination(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.leaks(docs, items)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in QUERIES["op4_decontamination"](spark, DIR).collect()}
    assert got == want and any(w[4] for w in want.values())


def test_token_counts(spark, docs):
    import sentencepiece

    from spanloom.llm.tokens import model_path

    model = sentencepiece.SentencePieceProcessor(model_file=model_path())
    for i, r in by_id(QUERIES["op5_token_counts"](spark, DIR)).items():
        text = dict(docs)[i] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), len(n := model.encode(text)), len(n) > 4096)


def test_nearest_recall_and_scores(spark):
    d = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    ids, x = e.vec_id.to_numpy(), np.vstack(e.embedding.to_numpy()).astype(float)
    got = {}
    for r in QUERIES["op6_nearest"](spark, d).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    queries = [q for q in ids if q % 50 == 0]
    assert sorted(got) == queries
    length = np.sqrt((x * x).sum(1))
    hits = 0
    for q in queries:
        i = int(np.searchsorted(ids, q))
        s = (x @ x[i]) / (length * length[i])
        s[i] = -2
        best = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        hits += len(best & {v for v, _ in got[q].values()})
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        assert all(abs(s[np.searchsorted(ids, v)] - c) < 1e-12 for v, c in got[q].values())
        assert [c for _, c in sorted(got[q].values(), key=lambda v: (-v[1], v[0]))] == [got[q][k][1] for k in range(1, 6)]
    assert hits / (5 * len(queries)) >= 0.9


def test_pii_base_spans(spark, docs):
    got = by_id(QUERIES["op7_pii"](spark, DIR))
    for i, t in docs:
        want = brute.pii(t)
        assert got[i]["base_sha256"] == brute.sha(brute.joined(want))
        assert set(brute.joined(want).split(",")) <= set(got[i]["spans"].split(","))
        assert got[i]["n_email"] == sum(k == "email" for k, _, _ in want) and got[i]["n_card"] == sum(k == "card" for k, _, _ in want)


def test_secret_base_spans(spark, docs):
    got = by_id(QUERIES["op10_secrets"](spark, DIR))
    for i, t in docs:
        want = brute.secrets(t)
        assert got[i]["base_sha256"] == brute.sha(brute.joined(want)) and got[i]["n_hex"] == sum(k == "hex" for k, _, _ in want)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, docs, size, percent):
    from spanloom.llm.jaccard import join_components

    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join_components(spark.read.parquet(f"{DIR}/documents.parquet"), size, percent).collect()}
    assert got == brute.jaccard(docs, size, percent)


def test_quality_keeps_clean_rows_and_drops_bad_ones(spark):
    d = "/root/testdata/sf0.1"
    got = QUERIES["op8_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    s = got.groupBy(((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean")).agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {r["clean"]: r["kept"] for r in s}
    assert kept[True] > 0.99 and kept[False] < 0.5


def test_queries_return_the_contracts_columns(spark):
    want = {"op1_url_filter": "page_id host path rule verdict", "op3_mixing": "doc_id size source_size target taken", "op6_nearest": "query_id rank vec_id score", "op9_jaccard_join": "doc_id n_shingles component_id", "op10_secrets": "doc_id n_assign n_access n_hex base_sha256 spans"}
    for name, columns in want.items():
        assert set(columns.split()) <= set(QUERIES[name](spark, DIR).columns)
