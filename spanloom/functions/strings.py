"""Names of features and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols that the name of a peak's chromosome is made of, in either case.
CHROMOSOME = "0123456789XYMT"


def normal_chromosome(chrom: Column) -> Column:
    """chr in front of numbers, X and Y; MT and M become chrM; anything else stays as it is, also in other cases; null is null."""
    return F.when(chrom.isin("MT", "M"), "chrM").when(chrom.isin("X", "Y") | chrom.rlike("^[0-9]+$"), F.concat(F.lit("chr"), chrom)).otherwise(chrom)


def canonical_peak(name: Column) -> Column:
    """chrN:start-end from N:start-end and N-start-end, each with or without chr in front, in any case; what is no such place stays, without blanks at its ends."""
    text = F.trim(name)
    bare = F.when(F.lower(F.substring(text, 1, 3)) == "chr", F.substring(text, F.lit(4), F.length(text))).otherwise(text)
    # at most one colon, and that after the chromosome
    parts = F.split(F.when(F.locate(":", bare) < F.locate("-", bare), F.regexp_replace(bare, "^([^:]*):", "$1-")).otherwise(bare), "-", -1)
    chrom, start, end = (F.get(parts, F.lit(i)) for i in range(3))
    number = lambda c: (c != "") & (F.translate(c, "0123456789", "") == "")
    place_ = (F.size(parts) == 3) & (chrom != "") & (F.translate(F.upper(chrom), CHROMOSOME, "") == "") & number(start) & number(end)
    return F.when(place_, F.concat(F.lit("chr"), F.upper(chrom), F.lit(":"), start, F.lit("-"), end)).otherwise(text)


def place(name: Column) -> Column:
    """struct(chrom, start, end) from chrom, start and end between colons, hyphens or underscores; a missing end is the start."""
    parts = F.split(F.translate(name, ":_", "--"), "-")
    start = F.try_to_number(F.get(parts, F.lit(1)), F.lit("999999999999")).cast("long")
    end = F.try_to_number(F.get(parts, F.lit(2)), F.lit("999999999999")).cast("long")
    return F.struct(F.get(parts, F.lit(0)).alias("chrom"), start.alias("start"), F.coalesce(end, start).alias("end"))


def without_version(gene: Column) -> Column:
    return F.substring_index(gene, ".", 1)


def gtf_attribute(attributes: Column, name: str) -> Column:
    """The value of one attribute of a GTF line; null without it."""
    found = F.regexp_extract(attributes, f'(?:^|[; ]){name} "([^"]*)"', 1)
    return F.when(found != "", found)


def link_id(peak: Column, gene: Column) -> Column:
    return F.concat_ws(";", peak, gene)


def link_parts(link: Column) -> tuple[Column, Column]:
    """Peak and gene of a link id: the first semicolon divides."""
    parts = F.split(link, ";", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def number(text: Column) -> Column:
    """A double where the text is one, else null."""
    return text.try_cast("double")


def significance(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
