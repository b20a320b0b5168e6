"""Association inputs made from the star-schema tables.

Cells are customers. The first matrix counts ordered parts in 40 classes, the second suppliers in
20; peaks and genes are places laid out from the class numbers. SQL of the same tables, for the
oracles, is in :mod:`spanloom.plans.oracles`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored

N_X, N_Y = 40, 20


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _counts(self, feature: F.Column) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", feature.cast("long").alias("feature_id"))
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("cell_id"))
        return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).groupBy("cell_id", "feature_id").agg(F.count("*").cast("double").alias("value"))

    def x(self) -> DataFrame:
        return self._counts(F.col("l_partkey") % N_X)

    def y(self) -> DataFrame:
        return self._counts(F.col("l_suppkey") % N_Y)

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """:meth:`x` and :meth:`y` from one pass, stored: lines move once to their cell, and are counted there class by class."""
        lines = self.table("lineitem").select("l_orderkey", (F.col("l_partkey") % N_X).cast("long").alias("x"), (F.col("l_suppkey") % N_Y).cast("long").alias("y"))
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("cell_id"))
        kinds = {c: sorted(v) for c, v in lines.agg(F.collect_set("x").alias("x"), F.collect_set("y").alias("y")).first().asDict().items()}  # fewer than 2 N_X and 2 N_Y
        counted = [F.array(*[F.count_if(F.col(c) == k).cast("double") for k in kinds[c]]).cast("array<double>").alias(c) for c in kinds]
        moved = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("cell_id", "x", "y").repartition("cell_id")
        held = stored(moved.groupBy("cell_id").agg(*counted), "classes")
        long = lambda c: held.select("cell_id", F.inline(F.zip_with(F.array(*[F.lit(k) for k in kinds[c]]).cast("array<long>"), c, lambda k, v: F.struct(k.alias("feature_id"), v.alias("value"))))).filter("value > 0")
        return long("x"), long("y")

    def cells(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("celltype"), F.col("c_nationkey").alias("batch"), F.col("c_acctbal").alias("balance"))

    def n_cells(self) -> int:
        return self.table("customer").count()

    def peaks(self) -> DataFrame:
        f = self.table("lineitem").select((F.col("l_partkey") % N_X).cast("long").alias("peak_id")).distinct()
        return f.select("peak_id", F.concat(F.lit("chr"), (F.col("peak_id") % 5).cast("string")).alias("chrom"), (F.col("peak_id") * 1000).alias("start"), (F.col("peak_id") * 1000 + 300).alias("end"))

    def genes(self) -> DataFrame:
        f = self.table("lineitem").select((F.col("l_suppkey") % N_Y).cast("long").alias("gene_id")).distinct()
        return f.select("gene_id", F.concat(F.lit("chr"), (F.col("gene_id") % 5).cast("string")).alias("g_chrom"), (F.col("gene_id") * 2000).alias("g_start"), (F.col("gene_id") * 2000 + 1500).alias("g_end"))

    def pairs(self) -> DataFrame:
        """Every first feature with the second feature of its number, modulo, where there is one, as link_id, x_id, y_id."""
        rows = self.peaks().select(F.col("peak_id").alias("link_id"), F.col("peak_id").alias("x_id"), (F.col("peak_id") % N_Y).alias("y_id"))
        return rows.join(self.genes().select(F.col("gene_id").alias("y_id")), "y_id", "left_semi").select("link_id", "x_id", "y_id")

    def parts_and_suppliers(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Matrices whose features grow with the data: ordered parts, and suppliers in classes of N_Y; and links of every part with five classes."""
        x, y = self._counts(F.col("l_partkey")), self._counts(F.col("l_suppkey") % N_Y)
        parts = self.table("lineitem").select(F.col("l_partkey").cast("long").alias("x_id")).distinct()
        links = parts.select("x_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select((F.col("x_id") * 5 + F.col("k")).alias("link_id"), "x_id", ((F.col("x_id") + F.col("k") * 4) % N_Y).alias("y_id"))
        return links, x, y

    def spans(self) -> DataFrame:
        """Events as intervals of their user's time, in whole seconds."""
        start = F.unix_timestamp("ts")
        return self.table("events").select("event_id", F.col("user_id").alias("chrom"), start.alias("start"), (start + 60 + F.floor(F.col("value") * 20)).alias("end"), "event_type", "value")

    def scores(self) -> DataFrame:
        """Labelled documents: doc_id, label, the score of two methods (smaller is better), lang, source."""
        d, l = self.table("documents"), self.table("labels")
        words = F.coalesce(F.size(F.split(F.trim("text"), " ")), F.lit(0))
        rows = d.join(l, "doc_id")
        return rows.select("doc_id", (F.col("quality") == 1).alias("label"), F.col("n_chars").cast("double").alias("m1"), (F.col("doc_id") * 7919 % 1009).cast("double").alias("m2"), "lang", "source")

    def controls(self) -> tuple[DataFrame, DataFrame]:
        """Observations (key, grp, value) and controls (grp, ctrl): prices of parts against those of their brand's ordered lines."""
        obs = self.table("part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("grp"), (F.col("p_retailprice") % 97).alias("value"))
        part = self.table("part").select("p_partkey", "p_brand")
        ctrl = self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("grp"), (F.floor(F.col("l_extendedprice")) % 101).cast("double").alias("ctrl"))
        return obs, ctrl
