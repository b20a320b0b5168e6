"""Readers of the file kinds that link analysis uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strings import gtf_attribute, link_parts


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(row, column, value), counted from 0, of a coordinate Matrix Market file; the header and the size line are skipped."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("%"))
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(F.get(parts, F.lit(0)).cast("long").alias("r"), F.get(parts, F.lit(1)).cast("long").alias("c"), F.get(parts, F.lit(2)).cast("double").alias("v"), F.monotonically_increasing_id().alias("n"))
    first = rows.agg(F.min("n")).first()[0]
    return rows.filter(F.col("n") != first).select((F.col("r") - 1).alias("row"), (F.col("c") - 1).alias("column"), F.col("v").alias("value"))


def split_modalities(features: DataFrame, counts: DataFrame, kind: str = "feature_types") -> dict[str, DataFrame]:
    """Counts of each of the two feature types, 'ATAC' and 'GEX'."""
    return {k: counts.join(features.filter(F.col(kind) == k).select("feature_id"), "feature_id", "left_semi") for k in ("ATAC", "GEX")}


def table(spark: SparkSession, path: str, schema: str, separator: str = "\t", header: bool = True) -> DataFrame:
    """A delimited table with a fixed schema; gzip is told by the file's name."""
    return spark.read.schema(schema).option("sep", separator).option("header", header).csv(path)


def bed(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """A BED file without header: chrom, start, end and further columns."""
    return table(spark, path, "chrom string, start long, end long" + (", " + extra if extra else ""), header=False)


def validation_overlaps(spark: SparkSession, path: str, names: list[str], same_gene: bool = True) -> DataFrame:
    """Nine-column overlap files of truth against links; the truth's id is unpacked into ``names`` at semicolons.

    ``score`` becomes a double (true and false count as 1 and 0). With ``same_gene``, the truth's gene
    must be the link's.
    """
    raw = table(spark, path, "gt_chr string, gt_start long, gt_end long, gt_id string, chr string, start long, end long, id string, bp_overlap long", header=False)
    raw = raw.withColumn("_parts", F.split("gt_id", ";"))
    for k, name in enumerate(names):
        value = F.get("_parts", F.lit(k))
        if name == "score":
            value = F.when(F.lower(value) == "true", 1.0).when(F.lower(value) == "false", 0.0).otherwise(value.try_cast("double"))
        raw = raw.withColumn(f"gt_{name}", value)
    peak, gene = link_parts(F.col("id"))
    raw = raw.withColumns({"peak": peak, "gene": gene}).drop("_parts")
    return raw.filter(F.col("gt_gene") == F.col("gene")) if same_gene and "gene" in names else raw


def gene_starts(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, gene_name, chrom, start, end, strand, tss of the genes of a GTF file, the first of each gene_id; raises without any."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in ((0, "chrom"), (2, "kind"), (3, "s"), (4, "e"), (6, "strand"), (8, "a"))], F.monotonically_increasing_id().alias("n")).filter("kind = 'gene'")
    chrom = F.when(F.col("chrom").startswith("chr"), F.col("chrom")).otherwise(F.concat(F.lit("chr"), "chrom"))
    genes = rows.select(F.substring_index(gtf_attribute(F.col("a"), "gene_id"), ".", 1).alias("gene_id"), gtf_attribute(F.col("a"), "gene_name").alias("gene_name"), chrom.alias("chrom"), F.col("s").try_cast("long").alias("start"), F.col("e").try_cast("long").alias("end"), "strand", "n").filter("gene_id is not null")
    genes = genes.withColumn("_r", F.row_number().over(Window.partitionBy("gene_id").orderBy("n"))).filter("_r = 1")
    genes = genes.select("gene_id", "gene_name", "chrom", "start", "end", "strand", F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end")).alias("tss"))
    if genes.isEmpty():
        raise ValueError("no genes found")
    return genes


def attributes(genes: DataFrame, reference: DataFrame, key: str = "gene") -> DataFrame:
    """Genes with the columns of a reference table (no network look-up); unknown ones get nulls."""
    return genes.join(reference.dropDuplicates([key]), key, "left")


def chunk_ranges(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """start, end, file of chunk files named ``prefix_<start>_<end>``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}_*").load(path).select(F.col("path").alias("file"))
    found = lambda k: F.regexp_extract("file", rf"{prefix}_([0-9]+)_([0-9]+)[^/]*$", k).try_cast("long")
    return files.select(found(1).alias("start"), found(2).alias("end"), "file").filter("start is not null")


def gaps(ranges: DataFrame) -> DataFrame:
    """start, end of what is missing between ranges (start, end), and overlaps as negative lengths: start, end, length."""
    before = F.lag("end").over(Window.orderBy("start", "end"))  # one row a chunk
    return ranges.withColumn("_e", before).filter(F.col("_e").isNotNull() & (F.col("_e") != F.col("start"))).select(F.col("_e").alias("gap_start"), F.col("start").alias("gap_end"), (F.col("start") - F.col("_e")).alias("gap_length"))


def consolidated(chunks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key of accumulated chunks: the last written one (by ``order``) wins."""
    return chunks.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")
