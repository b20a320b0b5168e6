"""Jobs on copies of small tables: reruns, broken runs, growing input; and their queries against SQL."""

from __future__ import annotations

import glob
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import association_study as study
from jobs import text_evaluation as texts
from jobs.queries import ORACLE_SQL, QUERIES
from spanloom.plans import jobs as plans
from spanloom.plans.stages import Stages
from tests.oracle import database, differences

DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
CONFIG = {"bins": "2.1.2.1.3", "distance": 3000, "bin_width": 5000, "method": "pearson", "seed": 1, "strict": False, "target": 0.1, "parts": 4, "parts_at_a_time": 1}


@pytest.fixture()
def tables(tmp_path):
    for name in ("lineitem", "orders", "customer"):
        shutil.copy(f"{DIR}/{name}.parquet", tmp_path / f"{name}.parquet")
    return str(tmp_path)


def files(out):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{out}/**/*.parquet", recursive=True)}


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_job_query_agrees_with_sql(spark, name):
    assert differences(QUERIES[name](spark, DIR), ORACLE_SQL[name], database(DIR)) == []


def test_study_writes_nothing_again(spark, tables, tmp_path):
    out = str(tmp_path / "out")
    first = rows(study.run(spark, tables, out, CONFIG))
    before = files(out)
    assert first and rows(study.run(spark, tables, out, CONFIG | {"parts_at_a_time": 3})) == first
    assert files(out) == before
    assert {p.split("chrom=")[1].split("/")[0] for p in before if "/pvalues/" in p} == {f"chr{k}" for k in range(5)}


def test_study_broken_after_half_its_control_parts(spark, tables, tmp_path, monkeypatch):
    whole = rows(study.run(spark, tables, str(tmp_path / "whole"), CONFIG))
    fit, asked = plans.fit, []

    def breaking(links, *args):
        asked.append((("ctrl_rank" in links.columns), {r["part"] for r in links.select("part").distinct().collect()}))
        if len(asked) == 7:
            raise RuntimeError("lost")
        return fit(links, *args)

    monkeypatch.setattr(plans, "fit", breaking)
    out = str(tmp_path / "broken")
    with pytest.raises(RuntimeError):
        study.run(spark, tables, out, CONFIG)
    kept = files(f"{out}/ctrl")
    done = set().union(*(p for ctrl, p in asked[:6] if ctrl))
    assert len(done) == 2 and kept
    asked.clear()
    monkeypatch.setattr(plans, "fit", lambda links, *args: (asked.append(("ctrl_rank" in links.columns, {r["part"] for r in links.select("part").distinct().collect()})), fit(links, *args))[1])
    assert rows(study.run(spark, tables, out, CONFIG)) == whole
    assert all(ctrl for ctrl, _ in asked) and set().union(*(p for _, p in asked)) == {0, 1, 2, 3} - done
    assert kept.items() <= files(f"{out}/ctrl").items()


def test_study_starts_anew_for_other_settings_and_tables(spark, tables, tmp_path):
    out = str(tmp_path / "out")
    study.run(spark, tables, out, CONFIG)
    other = CONFIG | {"seed": 2, "parts": 2}
    assert rows(study.run(spark, tables, out, other)) == rows(study.run(spark, tables, str(tmp_path / "fresh"), other))
    more = spark.read.parquet(f"{DIR}/lineitem.parquet")
    more.unionByName(more.limit(500)).write.parquet(f"{tables}/grown.parquet")
    shutil.rmtree(f"{tables}/lineitem.parquet", ignore_errors=True)
    os.path.exists(f"{tables}/lineitem.parquet") and os.remove(f"{tables}/lineitem.parquet")
    os.rename(f"{tables}/grown.parquet", f"{tables}/lineitem.parquet")
    assert rows(study.run(spark, tables, out, other)) == rows(study.run(spark, tables, str(tmp_path / "grown"), other))


def test_study_by_stages(spark, tables, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="unknown stages"):
        study.run(spark, tables, out, CONFIG, ("fits",))
    with pytest.raises(ValueError, match="has not been run"):
        study.run(spark, tables, out, CONFIG, ("cis",))
    for stage in study.STAGES[:-1]:
        assert study.run(spark, tables, out, CONFIG, (stage,)) is None
    assert rows(study.run(spark, tables, out, CONFIG, ("pvalues",))) == rows(study.run(spark, tables, str(tmp_path / "whole"), CONFIG))


def test_one_sided_study(spark, tables, tmp_path):
    config = CONFIG | {"bins": "2.1.inf.inf.2"}
    found = study.run(spark, tables, str(tmp_path / "out"), config)
    assert found.filter("mcpval is null").count() == 0 and found.count() == spark.read.parquet(str(tmp_path / "out/links")).count()


def test_parts_that_are_short_or_gone_are_made_again(spark, tmp_path):
    work = spark.range(20).withColumn("part", (F.col("id") % 4).cast("int"))
    work.select("id").write.parquet(str(tmp_path / "in.parquet"))
    made = []

    def make(some):
        made.append({r["part"] for r in some.select("part").distinct().collect()})
        return some.withColumn("twice", F.col("id") * 2)

    def again():
        made.clear()
        return rows(Stages(spark, str(tmp_path / "s"), {"a": 1}, [str(tmp_path / "in.parquet")]).in_parts("t", work, make, 3))

    want = again()
    assert made == [{0, 1, 2}, {3}] and again() == want and made == []
    shutil.rmtree(tmp_path / "s/t/part=2")
    assert again() == want and made == [{2}]
    assert Stages(spark, str(tmp_path / "s"), {"a": 1}, [str(tmp_path / "in.parquet")]).in_parts("none", work.filter("false"), make, 3).count() == 0


def test_study_from_the_command_line(tables, tmp_path):
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.checkpoint.dir=file://{tmp_path}/shared pyspark-shell"}
    config = tmp_path / "config.json"
    config.write_text(__import__("json").dumps(CONFIG))
    done = subprocess.run([sys.executable, str(ROOT / "jobs/association_study.py"), "--tables", tables, "--out", str(tmp_path / "out"), "--config", str(config), "--stages", "counts,links"], env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read lineitem" in done.stderr and "wrote links" in done.stderr and glob.glob(str(tmp_path / "out/links/*.parquet"))


EVALUATION = {"label_threshold": 0.5, "least_rows": 20, "least_gold": 5, "word_edges": [50, 200], "files_at_a_time": 1}


@pytest.fixture()
def arriving(spark, tmp_path):
    """Documents and labels of sf0.01 as a folder that begins with one of three files, and the other two."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("_w", F.lit("?")).withColumn("kind", F.lit("?"))
    for k in range(3):
        docs.filter(F.col("doc_id") % 3 == k).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    (tmp_path / "documents").mkdir()

    def arrive(k, name=None):
        source = glob.glob(str(tmp_path / f"part{k}/*.parquet"))[0]
        shutil.copy(source, tmp_path / "documents" / (name or f"{k}.parquet"))

    arrive(0)
    return str(tmp_path / "documents"), "/root/testdata/sf0.01/labels.parquet", arrive


def test_evaluation_takes_only_what_is_new(spark, arriving, tmp_path, caplog):
    documents, labels, arrive = arriving
    out = str(tmp_path / "out")
    caplog.set_level("INFO", "spanloom.text_evaluation")
    first = rows(texts.run(spark, documents, labels, out, EVALUATION))
    held = files(f"{out}/scores")
    arrive(1)
    arrive(2)
    second = rows(texts.run(spark, documents, labels, out, EVALUATION))
    assert second != first and held.items() <= files(f"{out}/scores").items()
    assert rows(texts.run(spark, documents, labels, out, EVALUATION)) == second
    assert rows(texts.run(spark, documents, labels, str(tmp_path / "fresh"), EVALUATION)) == second
    arrive(1, "again.parquet")  # documents that were there before change nothing
    assert rows(texts.run(spark, documents, labels, out, EVALUATION)) == second
    n = [spark.read.parquet(str(tmp_path / f"part{k}")).count() for k in range(3)]
    assert [int(m.split(": ")[1].split()[0]) for m in caplog.messages if "new documents" in m] == [n[0], n[1] + n[2], 0, sum(n), n[1]]


def test_evaluation_broken_between_its_steps(spark, arriving, tmp_path, monkeypatch):
    documents, labels, _ = arriving
    out = str(tmp_path / "out")
    with monkeypatch.context() as m:
        m.setattr(texts, "evaluated", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            texts.run(spark, documents, labels, out, EVALUATION)
    assert rows(texts.run(spark, documents, labels, out, EVALUATION)) == rows(texts.run(spark, documents, labels, str(tmp_path / "fresh"), EVALUATION))


def test_evaluation_of_odd_documents(spark, tmp_path):
    texts_in = [None, "", " \n", "a", "a a a", "!?!", "é ü 日本", "x " * 50_000]
    docs = spark.createDataFrame([(k // 2, t, None if k % 2 else "de", None) for k, t in enumerate(texts_in * 2)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(k, k % 2) for k in range(20)] + [(1, None), (2, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "l"))
    found = texts.run(spark, str(tmp_path / "d"), str(tmp_path / "l"), str(tmp_path / "out"), EVALUATION | {"least_rows": 1, "least_gold": 1}).collect()
    whole = {r["method"]: r for r in found if r["kind"] == "all"}
    assert set(whole) == set(texts.METHODS) and all(r["n"] == 8 and r["n_gold"] == 5 for r in whole.values())
    assert {r["stratum"] for r in found if r["kind"] == "source"} == {""}
    got = {r["doc_id"]: r for r in texts.scored(docs.dropDuplicates(["text"])).collect() if r["words"] > 3}
    assert [(r["words"], round(r["repeats"], 5)) for r in got.values()] == [(50_000, 0.99998)]
    none = texts.run(spark, str(tmp_path / "d"), str(tmp_path / "l"), str(tmp_path / "none"), EVALUATION | {"least_rows": 1000})
    assert none.count() == 0
    docs.filter("false").coalesce(1).write.parquet(str(tmp_path / "e"))
    assert texts.run(spark, str(tmp_path / "e"), str(tmp_path / "l"), str(tmp_path / "empty"), EVALUATION).count() == 0


def test_evaluation_from_the_command_line(arriving, tmp_path):
    documents, labels, _ = arriving
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.checkpoint.dir=file://{tmp_path}/shared pyspark-shell"}
    done = subprocess.run([sys.executable, str(ROOT / "jobs/text_evaluation.py"), "--documents", documents, "--labels", labels, "--out", str(tmp_path / "out")], env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "new documents" in done.stderr and {p.split("kind=")[1].split("/")[0] for p in glob.glob(str(tmp_path / "out/metrics/*/*.parquet"))} >= {"all", "lang", "length"}
