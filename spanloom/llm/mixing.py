"""Mixing sources to target weights with hash-threshold histograms.

Each row gets a uniform 48-bit hash of its id. A source's budget is met by taking the rows whose
hash lies under a threshold, so no row is ever sorted. The threshold is found by nested
histograms: sizes are summed by (source, leading hash bits), the bucket in which the running sum
passes the budget becomes the boundary, and only rows of boundary buckets enter the next, finer
histogram. Every histogram has at most 2**BITS rows a source, summed map-side, so a source that
holds a third of all rows costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HASH_BITS, key_hash, stored, table

#: Separators of words: blank, and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash bits resolved by each histogram.
BITS = 12
#: Weights of the sources in code point order, repeating.
CYCLE = (5, 2, 1)
#: Total size of the mix in percent of all sizes, and the most copies of a row.
TOTAL_PERCENT, MOST_COPIES = 150, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, by: str, turn: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """Adds the number of each row (from 1) in order of ``by``, null last, and running ``sums``, by ranges of the order.

    Only the totals of the ranges, one row each, go through a window without partitions.
    """
    sums = {turn: F.lit(1)} | (sums or {})
    rows = stored(df.repartitionByRange(F.col(by).asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    parts = rows.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    order = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(order), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inner = Window.partitionBy("_range").orderBy(F.col(by).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(parts), "_range").withColumns({k: F.sum(c).over(inner) + F.col(f"_b_{k}") for k, c in sums.items()}).drop("_range", *[f"_b_{k}" for k in sums])


def source_targets(sizes: DataFrame, total_percent: int = TOTAL_PERCENT, most: int = MOST_COPIES, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """Targets of the sources by water filling: source, source_size, weight, target.

    ``sizes`` holds one row a source (source, source_size). Sources in code point order, null last,
    take the weights of ``cycle`` in turn and share ``total_percent`` of all sizes; whatever a source
    would get beyond ``most`` times its size is shared again by weight until no target is above.
    An empty table gives no rows; sources of size 0 get a target of 0.
    """
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    w = ranked(sizes, "source", "_turn").withColumn("weight", F.get(weights, ((F.col("_turn") - 1) % len(cycle)).cast("int"))).drop("_turn")
    w = stored(w.withColumn("cap", (F.col("source_size") * most).cast("double")), "mix-sources")
    total, caps, all_weights = w.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("cap"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    budget = total * total_percent / 100
    # the level at which the capped sources' caps and the others' shares make up the budget: sources
    # are capped in order of cap / weight, and a source is capped if the budget reaches its edge
    edges = w.groupBy((F.col("cap") / F.col("weight")).alias("edge")).agg(F.sum("cap").alias("_cap"), F.sum("weight").alias("_weight"))
    upto = ranked(edges, "edge", "_turn", {"fixed": F.col("_cap"), "gone": F.col("_weight")})
    reached = upto.withColumn("need", F.col("fixed") + F.col("edge") * (F.lit(all_weights) - F.col("gone"))).filter(F.col("need") <= budget)
    fixed, gone = reached.agg(F.coalesce(F.max("fixed"), F.lit(0.0)), F.coalesce(F.max("gone"), F.lit(0.0))).first()
    rest = all_weights - gone
    level = (budget - fixed) / rest if rest > 0 and caps > budget else float("inf")
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return w.select("source", "source_size", "weight", target.alias("target"))


def mix_plan(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a source: _s, source_size, target, base, cut.

    ``rows``: source, size, ``h`` (48-bit hash). ``targets``: as of :func:`source_targets`. Every
    row is to be taken ``base = floor(target / source_size)`` times, and rows whose hash is under
    ``cut`` once more. A run of rows with one same hash (repeated ids) is taken or left as a whole,
    whichever comes nearer to the target.
    """
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    need = targets.select(F.col("source").alias("_s"), "source_size", "target", base.alias("base")).withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
    # (source, prefix of the boundary bucket, budget left inside it)
    edge = need.select("_s", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    step = Window.partitionBy("_s").orderBy("bucket")  # over at most 2**BITS histogram rows a source
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        inside = rows.join(F.broadcast(edge) if _small(edge) else edge, rows["source"].eqNullSafe(edge["_s"]) & (F.shiftright(rows["h"], shift + BITS) == edge["prefix"]))
        hist = inside.groupBy("_s", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = hist.withColumn("upto", F.sum("words").over(step)).withColumn("before", F.col("upto") - F.col("words"))
        first = F.row_number().over(step)
        inner = run.filter((F.col("before") <= F.col("left")) & (F.col("upto") > F.col("left")) & (F.col("words") > 0))
        edge = stored(inner.withColumn("_n", first).filter("_n = 1").select("_s", F.col("bucket").alias("prefix"), (F.col("left") - F.col("before")).alias("left"), "words"), "mix-edge")
        last = edge
        edge = edge.select("_s", "prefix", "left")
    # the boundary is now one hash value: take it where that comes nearer
    cut = last.select(F.col("_s").alias("_t"), (F.col("prefix") + F.when(F.col("left") * 2 >= F.col("words"), 1).otherwise(0)).alias("cut"))
    return stored(need.join(cut, need["_s"].eqNullSafe(cut["_t"]), "left").select("_s", "source_size", "target", "base", F.coalesce("cut", F.when(F.col("budget") > 0, F.lit(1 << HASH_BITS)).otherwise(F.lit(0))).alias("cut")), "mix-plan")


def taken(rows: DataFrame, plan: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of each row with source_size, target, copies and taken, its words times its copies.

    ``rows`` has source, and size and hash as ``_size`` and ``_h``.
    """
    own = plan.select("_s", *[F.col(c).alias(f"_{c}") for c in ("source_size", "target", "base", "cut")])
    out = rows.join(F.broadcast(own) if _small(own) else own, rows["source"].eqNullSafe(own["_s"]))
    copies = F.col("_base") + F.when(F.col("_h") < F.col("_cut"), 1).otherwise(0)
    return out.select(*columns, F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), copies.cast("int").alias("copies"), (copies * F.col("_size")).cast("long").alias("taken"))


#: Rows of a source table up to which it is broadcast (under 10 MB); larger ones are joined by shuffle.
BROADCAST_SOURCES = 50_000


def _small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def mix_documents(docs: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """``columns`` (doc_id and source, unless named) with size, source_size, target, copies and taken for every row of ``docs``.

    Null or empty texts have size 0 and are taken with 0 words; a null source is a source of its
    own; repeated ids share one hash and so one fate; an empty table gives an empty result. Only
    doc_id, text, source and ``columns`` are read; further columns of any name do no harm.
    """
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key_hash(F.col("doc_id"), "mix").alias("h"))
    slim = stored(slim, "mix-rows")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = mix_plan(slim, stored(source_targets(sizes), "mix-targets"))
    if columns is None:  # no second pass over the texts
        return taken(slim.select("doc_id", "source", F.col("size").alias("_size"), F.col("h").alias("_h")), plan, ("doc_id", "source"))
    rows = docs.withColumns({"_size": word_count(docs["text"]), "_h": key_hash(docs["doc_id"], "mix")})
    return taken(rows, plan, columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
