"""Sequences of FASTA files in pieces with their places, and what share of an interval is G or C."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored

#: Bases of a piece at most.
PIECE = 8192

CUT = "file string, block long, segment long, name string, at long, bases string"


def cut_lines(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the sequences in each split of a file. A split's first segment goes on with what the split before ended with."""
    where, segment, at, held, size = None, 0, 0, [], 0
    out: list[tuple] = []

    def flush(all_of_it: bool) -> None:
        nonlocal at, held, size
        text = "".join(held)
        done = len(text) if all_of_it else len(text) - len(text) % piece
        for k in range(0, done, piece):
            out.append((*where, segment, None, at + k, text[k : min(k + piece, done)]))
        at, text = at + done, text[done:]
        held, size = ([text] if text else []), len(text)

    def made() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["file", "block", "segment", "name", "at", "bases"])
        out.clear()
        return batch

    for batch in batches:
        for file, block, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
            if (file, block) != where:
                if where is not None:
                    flush(True)
                where, segment, at = (file, block), 0, 0
            if line.startswith(">"):
                flush(True)
                segment, at = segment + 1, 0
                out.append((*where, segment, (line[1:].split() or [""])[0], 0, ""))
            else:
                held.append(line.strip())
                size += len(held[-1])
                if size >= piece:
                    flush(False)
        yield made()
    if where is not None:
        flush(True)
    yield made()


def sequences(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """chrom, start, end, bases: the sequences in pieces, places counted from 0, end exclusive.

    Files are read by Spark's text reader, so long sequences are many tasks; each split counts from
    its own beginning, and lengths of the splits before, one row each, are added afterwards. The
    name is the header's first word; lines before the first header are dropped; a name that stands
    twice is an error. A sequence without lines has no pieces.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    cut = stored(lines.mapInArrow(lambda batches: cut_lines(batches, piece), CUT), "fasta-pieces")
    segments = cut.groupBy("file", "block", "segment").agg(F.max("name").alias("name"), F.sum(F.length("bases")).cast("long").alias("size"))
    order = Window.partitionBy("file").orderBy("block", "segment")  # a row a header or split
    told = segments.withColumn("_of", F.count("name").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    told = told.withColumn("chrom", F.last("name", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("file", "_of").orderBy("block", "segment").rowsBetween(Window.unboundedPreceding, -1)
    told = stored(told.filter("_of > 0").withColumn("carried", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long")), "fasta-segments")
    twice = told.filter("name is not null").groupBy("name").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"sequence {twice[0]['name']} stands twice")
    start = F.col("carried") + F.col("at")
    found = cut.filter("bases <> ''").drop("name").join(told.select("file", "block", "segment", "chrom", "carried"), ["file", "block", "segment"])
    return found.select("chrom", start.alias("start"), (start + F.length("bases")).alias("end"), "bases")


def _counts(bases: Column, kinds: str) -> Column:
    return F.length(F.regexp_replace(bases, f"[^{kinds}{kinds.lower()}]", "")).cast("long")


def gc_content(peaks: DataFrame, pieces: DataFrame, key: str = "peak_id", piece: int = PIECE) -> DataFrame:
    """``peaks`` (key, chrom, start, end) with ``gc``: the share of G, C and S among known bases (these, A, T, U and W); 0 without any.

    Each end of a peak meets one piece, whatever the peak's length: counts up to the piece stand
    beside it, those inside are made from its bases. Parts beyond the sequence don't count; peaks on
    unknown sequences have null.
    """
    order = Window.partitionBy("chrom").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    p = pieces.withColumns({"_g": _counts(F.col("bases"), "GCS"), "_k": _counts(F.col("bases"), "GCSATUW")})
    p = p.withColumns({"_g_before": F.coalesce(F.sum("_g").over(order), F.lit(0)), "_k_before": F.coalesce(F.sum("_k").over(order), F.lit(0))})
    p = stored(p.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), "bases", "_g_before", "_k_before"), "gc-pieces")
    ends = p.groupBy(F.col("_c").alias("_ec")).agg(F.max("_e").alias("_size"))
    slots = p.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_s") / piece), F.floor((F.col("_e") - 1) / piece))))  # two at most
    mine = peaks.join(ends, F.col("chrom") == F.col("_ec"), "left").drop("_ec")
    mine = mine.withColumns({"_a": F.greatest(F.least("start", "_size"), F.lit(0)), "_z": F.greatest(F.least("end", "_size"), F.lit(0))})
    both = mine.filter("_size is not null and _z > _a").select(key, "chrom", F.inline(F.array(F.struct(F.lit(-1).alias("_sign"), F.col("_a").alias("_at")), F.struct(F.lit(1).alias("_sign"), F.col("_z").alias("_at")))))
    # the base before the cut: its piece holds the cut, also at the sequence's end; nothing is before 0
    both = both.filter("_at > 0").withColumn("_last", F.col("_at") - 1).withColumn("_slot", F.floor(F.col("_last") / piece))
    met = both.join(slots, (F.col("chrom") == F.col("_c")) & (both["_slot"] == slots["_slot"]) & (F.col("_last") >= F.col("_s")) & (F.col("_last") < F.col("_e")))
    inside = F.col("bases").substr(F.lit(1), (F.col("_at") - F.col("_s")).cast("int"))
    sums = met.groupBy(key).agg(F.sum(F.col("_sign") * (F.col("_g_before") + _counts(inside, "GCS"))).alias("_g"), F.sum(F.col("_sign") * (F.col("_k_before") + _counts(inside, "GCSATUW"))).alias("_k"))
    return mine.join(sums, key, "left").withColumn("gc", F.when(F.col("_size").isNotNull(), F.coalesce(F.try_divide(F.col("_g"), F.col("_k")), F.lit(0.0)))).drop("_size", "_a", "_z", "_g", "_k")
