"""Cleaning of truth and gene tables, and annotation of intervals with the features that they overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import overlap_join

#: Kinds of regions at most that become columns.
MOST_KINDS = 200


def clean_truth(rows: DataFrame, prefix: str = "ENSG") -> DataFrame:
    """Rows with a region and a gene whose id begins with ``prefix``; start and end as whole numbers, the end being the start where there is no such column.

    Places that are no numbers become null.
    """
    rows = rows if "end" in rows.columns else rows.withColumn("end", F.col("start"))
    kept = rows.filter(F.col("region").isNotNull() & F.coalesce(F.col("gene").startswith(prefix), F.lit(False)))
    return kept.withColumns({c: F.col(c).try_cast("double").try_cast("long") for c in ("start", "end")})


def clean_genes(genes: DataFrame, columns: tuple[str, ...] = ("chrom", "start", "end")) -> DataFrame:
    """Genes on chromosomes whose names begin with chr; the other columns named as whole numbers."""
    kept = genes.filter(F.coalesce(F.col(columns[0]).startswith("chr"), F.lit(False)))
    return kept.withColumns({c: F.col(c).try_cast("double").try_cast("long") for c in columns[1:]})


def _paired(query: DataFrame, features: DataFrame, key: str, bin_width: int, fraction: float) -> DataFrame:
    named = features.select(F.col("chrom").alias("f_chrom"), F.col("start").alias("f_start"), F.col("end").alias("f_end"), *[F.col(c).alias(f"f_{c}") for c in features.columns if c not in ("chrom", "start", "end")])
    return overlap_join(query.select(key, "chrom", "start", "end"), named, bin_width, right_cols=("f_chrom", "f_start", "f_end"), min_left_fraction=fraction)


def typed_overlaps(query: DataFrame, regions: DataFrame, key: str, kind: str, bin_width: int, fraction: float = 0.0, kinds: list[str] | None = None) -> DataFrame:
    """key, chrom, start, end, f_chrom, f_start, f_end, f_kind and a column is_<kind> of 0 or 1 for each kind, for every overlap of (chrom, start, end).

    ``fraction``: least share of the query that is covered. The kinds are those of ``regions`` in
    order, MOST_KINDS at most, unless they are given; a null kind has zeros only.
    """
    if kinds is None:
        kinds = [r[0] for r in regions.select(F.col(kind).cast("string")).filter(F.col(kind).isNotNull()).distinct().orderBy(kind).limit(MOST_KINDS + 1).collect()]
        if len(kinds) > MOST_KINDS:
            raise ValueError(f"more than {MOST_KINDS} kinds")
    pairs = _paired(query, regions.select("chrom", "start", "end", F.col(kind).cast("string").alias("kind")), key, bin_width, fraction).drop("overlap")
    return pairs.withColumns({f"is_{k}": F.coalesce((F.col("f_kind") == k).cast("int"), F.lit(0)) for k in kinds})


def annotated(query: DataFrame, features: DataFrame, key: str, packed: str, label: str, bin_width: int, names: list[str] | None = None, separator: str = ";") -> DataFrame:
    """``query`` with <label>_sum, how many features overlap each interval, and lists of what these say.

    ``packed`` is a column of ``features``: a name and further fields between separators. <label>_hits
    are the names; <label>_<name> for each of ``names`` the fields after it, null where a feature
    has fewer. All lists of a row are in one order: by name, then by the packed text. Intervals
    without a feature keep a sum of 0 and empty lists; null names of intervals get none.
    """
    names = names or []
    pairs = _paired(query, features.select("chrom", "start", "end", F.col(packed).alias("packed")), key, bin_width, 0.0)
    parts = F.split("f_packed", rf"\Q{separator}\E")
    hit = F.struct(F.get(parts, F.lit(0)).alias("hits"), F.col("f_packed").alias("_packed"), *[F.get(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    lists = pairs.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_sum"), F.array_sort(F.collect_list(hit)).alias("_l"))
    out = query.join(lists, F.col(key) == F.col("_key"), "left")
    columns = {f"{label}_{n}": F.coalesce(F.col(f"_l.{n}"), F.array().cast("array<string>")) for n in ("hits", *names)}
    return out.withColumns({f"{label}_sum": F.coalesce("_sum", F.lit(0)).cast("long"), **columns}).drop("_key", "_sum", "_l")
