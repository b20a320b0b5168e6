"""The jobs as queries: each runs twice into one new folder and gives back what stands there after the second run."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.plans.study_sql import study_sql
from spanloom.sources.shared import shared_dir

from . import association_study, text_evaluation
from .sql import evaluation_sql

#: Columns of the study, and the digits that its numbers are rounded to.
STUDY = ("link_id", "x_id", "y_id", "grp", "ctrl_short")
NUMBERS = ("beta", "se", "stud", "mcpval_z", "ppval_z", "zpval_z", "mcpval", "ppval", "zpval", "q_value", "bh_q")
DIGITS = 5


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_association_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = folder(spark, "job1"), association_study.settings(spark, association_study.CONFIG)
    for _ in range(2):
        association_study.run(spark, sf_dir, out, config)
    rows = spark.read.parquet(f"{out}/pvalues")
    return rows.select("chrom", *STUDY, *[(F.round(F.col(c), DIGITS) + 0.0).alias(c) for c in NUMBERS])


def job2_text_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = folder(spark, "job2"), text_evaluation.settings(spark, text_evaluation.CONFIG)
    for _ in range(2):
        found = text_evaluation.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out, config)
    return found.select("kind", "stratum", "method", "n", "n_gold", *[(F.round(F.col(c), DIGITS) + 0.0).alias(c) for c in ("auerc", "auorc", "ap")])


def defaults(path: str) -> dict:
    """The settings that come with a job, as its SQL needs them too."""
    with open(path) as f:
        return json.load(f)


STUDY_CONFIG, EVALUATION_CONFIG = defaults(association_study.CONFIG), defaults(text_evaluation.CONFIG)
QUERIES = {"job1_association_study": job1_association_study, "job2_text_evaluation": job2_text_evaluation}
ORACLE_SQL = {
    "job1_association_study": study_sql(STUDY_CONFIG["bins"], STUDY_CONFIG["distance"], STUDY_CONFIG["seed"], DIGITS),
    "job2_text_evaluation": evaluation_sql(EVALUATION_CONFIG, DIGITS),
}
