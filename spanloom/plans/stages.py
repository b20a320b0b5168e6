"""Stages whose finished work outlives a broken run.

A stage writes a table below one folder, in parts, a few parts a write; Spark's dynamic partition
overwrite replaces just those. After each write the parts go into a manifest, with their rows and
the fingerprint of what they were made from. A later run reads the manifest and the rows that are
there, and makes only the parts that are missing, short, or of another fingerprint. Everything is
read and written by Spark, so folders may be remote.
"""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import missing

log = logging.getLogger("spanloom.stages")

#: The part of a stage that is written as a whole.
WHOLE = 0


def files_of(spark: SparkSession, path: str) -> list[tuple]:
    """Name, size, time and rows of the files of a Parquet table, from their footers alone."""
    m = "_metadata."
    seen = spark.read.parquet(path).groupBy(F.col(m + "file_name").alias("name"), F.col(m + "file_size").alias("size"), F.col(m + "file_modification_time").cast("string").alias("time")).count()
    total = seen.agg(F.count("*"), F.sum("count"), F.sum("size"), F.max("time"), F.bit_xor(F.xxhash64("name", "size", "time", "count"))).first()
    return [path.rstrip("/").rsplit("/", 1)[-1], *total]


class Stages:
    """A folder of stages, all made from the same inputs with the same settings."""

    def __init__(self, spark: SparkSession, folder: str, settings: dict, inputs: list[str]):
        self.spark, self.folder = spark, folder.rstrip("/")
        read = [files_of(spark, p) for p in inputs]
        for name, files, rows, *_ in read:
            log.info("read %s: %s files, %s rows", name, files, rows)
        self.print = hashlib.sha256(json.dumps([settings, read], sort_keys=True, default=str).encode()).hexdigest()

    def path(self, stage: str) -> str:
        return f"{self.folder}/{stage}"

    def read(self, stage: str) -> DataFrame:
        if self._rows(self.path(stage)) is None:
            raise ValueError(f"stage {stage} has not been run")
        return self.spark.read.parquet(self.path(stage))

    def _rows(self, path: str) -> DataFrame | None:
        """The table at a path, or None before anything was written there."""
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _finished(self, stage: str, part: str | None) -> DataFrame | None:
        """part, rows of the parts that the manifest has with this fingerprint and whose rows are all there."""
        told, held = self._rows(self.path("manifest")), self._rows(self.path(stage))
        if told is None or held is None:
            return None
        told = told.filter((F.col("stage") == stage) & (F.col("fingerprint") == self.print)).select("part", "rows")
        if part is None:
            counted = held.agg(F.lit(WHOLE).alias("part"), F.count("*").alias("rows"))
        elif part in held.columns:
            counted = held.groupBy(F.col(part).cast("int").alias("part")).agg(F.count("*").alias("rows"))
        else:
            return None
        return told.join(counted, ["part", "rows"])

    def _note(self, stage: str, parts: DataFrame) -> None:
        rows = parts.select(F.col("rows").cast("long").alias("rows"), F.lit(self.print).alias("fingerprint"), F.lit(stage).alias("stage"), F.col("part").cast("int").alias("part"))
        rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage", "part").parquet(self.path("manifest"))

    def whole(self, stage: str, make: Callable[[], DataFrame], *by: str) -> DataFrame:
        """The stage's table, made unless it is finished; written as a whole, partitioned by columns."""
        done = self._finished(stage, None)
        if done is None or done.isEmpty():
            writer = make().write.mode("overwrite").option("partitionOverwriteMode", "static")
            (writer.partitionBy(*by) if by else writer).parquet(self.path(stage))
            rows = self.spark.read.parquet(self.path(stage)).agg(F.lit(WHOLE).alias("part"), F.count("*").alias("rows"))
            self._note(stage, rows)
            log.info("wrote %s: %s rows", stage, rows.first()["rows"])
        else:
            log.info("kept %s", stage)
        return self.spark.read.parquet(self.path(stage))

    def in_parts(self, stage: str, work: DataFrame, make: Callable[[DataFrame], DataFrame], at_a_time: int) -> DataFrame:
        """The stage's table: ``make`` of the rows of ``work``, part by part; both have a row for each row and the column ``part``.

        ``at_a_time`` parts are made by one write. Parts that an earlier run finished stay as they are.
        """
        expected = work.groupBy("part").agg(F.count("*").alias("rows"))
        done = self._finished(stage, "part")
        if done is not None and done.isEmpty():
            done = None
        todo = expected if done is None else missing(expected, done, ["part", "rows"])
        parts = sorted(r["part"] for r in todo.collect())  # as many as the settings ask for
        log.info("%s: %s parts to make", stage, len(parts))
        for k in range(0, len(parts), at_a_time):
            some = parts[k : k + at_a_time]
            made = make(work.filter(F.col("part").isin(some)))
            # the first write of a fresh stage also clears what other settings left there
            mode = "static" if done is None and not k else "dynamic"
            made.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("part").parquet(self.path(stage))
            self._note(stage, expected.filter(F.col("part").isin(some)))
            log.info("wrote %s: parts %s", stage, some)
        return self.spark.read.parquet(self.path(stage)) if parts or done is not None else make(work)
