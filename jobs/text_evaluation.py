"""Standing evaluation of text scores against gold labels, over documents that keep arriving.

    python jobs/text_evaluation.py --documents PATH --labels PATH --out DIR [--config FILE]

A file stream takes the documents that no earlier run took, scores each text in three ways, and
appends the scores to OUT/scores; Spark's checkpoint at OUT/checkpoint is the mark. Texts are read
once in their life. Then all scores so far are ranked against the labels, and enrichment, odds and
precision of every method go to OUT/metrics for all documents, by language, by source and by
length, partitioned by that kind. Without new documents or labels a further run gives the same rows.

Of documents of one id the best (least) score counts, so files may repeat. A null text has no
scores and ranks behind all others; null languages and sources are strata named ''. Strata with
less support than the settings ask are left out.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import metrics
from spanloom.operators.binning import above
from spanloom.operators.dedup import merged_duplicates
from spanloom.plans import evaluation
from spanloom.sources.shared import stored
from spanloom.streaming.arrivals import append_new, arriving

log = logging.getLogger("spanloom.text_evaluation")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "text_evaluation.json")
METHODS = ("repeats", "marks", "brevity")
SCORES = "doc_id long, lang string, source string, words long, repeats double, marks double, brevity double"
METRICS = "stratum string, method string, n long, n_gold long, auerc double, auorc double, ap double, kind string"
WORD, MARK = r"[^\x20\x09-\x0D]+", r"[^A-Za-z0-9\x20\x09-\x0D\x{80}-\x{10FFFF}]"


def settings(spark: SparkSession, path: str) -> dict:
    """A config file, read through Spark, so its path may be remote."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, words, and three scores of the whole text, smaller ones better: the share of
    repeated words, the share of ASCII marks among characters, and one over the number of words and one."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    n = F.size("_w")
    whole = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text", words.alias("_w"))
    return whole.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.when(F.col("text").isNotNull(), n).otherwise(0).cast("long").alias("words"),
        F.try_divide((n - F.size(F.array_distinct("_w"))).cast("double"), n.cast("double")).alias("repeats"),
        F.try_divide(F.regexp_count("text", F.lit(MARK)).cast("double"), F.length("text").cast("double")).alias("marks"),
        F.when(F.col("text").isNotNull(), 1 / (n + 1).cast("double")).alias("brevity"),
    )


def ingest(spark: SparkSession, documents: str, out: str, files_at_a_time: int) -> int:
    """Scores the documents that are new since the checkpoint and appends them; returns how many there were."""
    rows = append_new(scored(arriving(spark, documents, files_at_a_time)), f"{out}/scores", f"{out}/checkpoint")
    log.info("read %s: %s new documents", documents, rows)
    return rows


def stratified(rows: DataFrame, word_edges: list[int]) -> DataFrame:
    """Each row once for every kind of stratum: kind, stratum."""
    length = above(F.col("words").cast("double"), [float("-inf"), *map(float, word_edges), float("inf")]).cast("string")

    def one(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("stratum"))

    kinds = F.array(one("all", F.lit("")), one("lang", F.col("lang")), one("source", F.col("source")), one("length", length))
    return rows.withColumn("_s", F.explode(kinds)).select("*", "_s.kind", "_s.stratum").drop("_s")


def evaluated(scores: DataFrame, labels: DataFrame, config: dict) -> DataFrame:
    """kind, stratum, method, n, n_gold, auerc, auorc, ap of all scores that have a label."""
    best = scores.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("source").alias("source"), F.max("words").alias("words"), *[F.min(m).alias(m) for m in METHODS])
    gold = evaluation.labelled(labels.withColumn("_q", F.col("quality").cast("double")), "_q", "qtl", config["label_threshold"]).filter("label is not null")
    gold = merged_duplicates(gold, ["doc_id"], "label", []).select("doc_id", (F.col("label") > 0).alias("label"))
    rows = stratified(best.join(gold, "doc_id"), config["word_edges"])
    rows = evaluation.supported(rows, "label", ["kind", "stratum"], config["least_rows"], config["least_gold"])
    within = ["kind", "stratum", "method"]
    long = stored(evaluation.long_form(rows, list(METHODS), ["doc_id", "label", "kind", "stratum"]), "scores")
    n = long.groupBy(*within).agg(F.count("*").alias("n"), F.count_if("label").alias("n_gold"))
    flipped = long.withColumn("_s", -F.col("score"))
    for m in (metrics.auerc(long, "score", "label", "doc_id", within=within), metrics.auorc(long, "score", "label", "doc_id", within=within), metrics.average_precision(flipped, "_s", "label", within)):
        n = n.join(m, within, "left")
    return n


def run(spark: SparkSession, documents: str, labels: str, out: str, config: dict) -> DataFrame:
    """Takes what is new, evaluates all, and returns OUT/metrics as it stands."""
    out = out.rstrip("/")
    ingest(spark, documents, out, config["files_at_a_time"])
    scores, gold = spark.read.schema(SCORES).parquet(f"{out}/scores"), spark.read.parquet(labels)
    log.info("read %s scores so far and %s labels", scores.count(), gold.count())
    evaluated(scores, gold, config).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("kind").parquet(f"{out}/metrics")
    found = spark.read.schema(METRICS).parquet(f"{out}/metrics")
    log.info("wrote %s/metrics: %s rows", out, found.count())
    return found


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--documents", required=True, help="folder of Parquet files: doc_id, text, lang, source")
    p.add_argument("--labels", required=True, help="Parquet table: doc_id, quality")
    p.add_argument("--out", required=True)
    p.add_argument("--config", default=CONFIG)
    a = p.parse_args()
    logging.basicConfig(format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("spanloom").setLevel(logging.INFO)
    spark = SparkSession.builder.appName("text evaluation").getOrCreate()
    try:
        run(spark, a.documents, a.labels, a.out, settings(spark, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
