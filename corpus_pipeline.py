"""A training corpus from raw documents: five stages, each one operator, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import bounded_batches, cleared, deleted, shared_dir, table
from spanloom.llm.contamination import decontaminated
from spanloom.llm.jaccard import without_near_copies
from spanloom.llm.mixing import mix_documents
from spanloom.llm.pii import find_pii, redacted
from spanloom.llm.quality import resample


#: Columns that stages work on; others pass under names of their own, so that none clashes.
CORE = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carrying(stage: Stage) -> Stage:
    """A stage that carries columns beyond CORE through whatever their names are.

    If the stage adds a column of the same name, its own stays.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        inner = {c: f"carried{i}__" for i, c in enumerate(docs.columns) if c not in CORE}
        out = stage(spark, docs.withColumnsRenamed(inner), sf_dir)
        names = {v: k for k, v in inner.items()}
        return out.select(*[F.col(c).alias(names.get(c, c)) for c in out.columns if names.get(c) not in out.columns])

    return run


@carrying
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    names = tuple(docs.columns)
    return resample(docs, table(spark, sf_dir, "labels"), names).filter("keep").select(*names)


@carrying
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: five words a shingle, similarity of 0.8 or more."""
    return without_near_copies(docs)


@carrying
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


@carrying
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    names = tuple(docs.columns)
    found = find_pii(docs, names)
    found = found.withColumn("text", redacted(F.col("text"), F.col("spans")))
    if "n_chars" in names:
        found = found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*names)


@carrying
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often (copies) and how many words that makes (taken)."""
    return mix_documents(docs, tuple(docs.columns)).filter("copies > 0")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: Importance weights and metric regions are beyond SQL; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's own tables, and its input from the stage before, are deleted once its output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            deleted(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
