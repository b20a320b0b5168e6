"""Bins: quantiles of ranks, nested quantiles, widths, percentiles and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import running, with_totals


def rank_quantile(rank: Column, n: Column, q: int) -> Column:
    """The quantile bin (from 0) of a rank among 1..n when the ranks are cut into q quantiles.

    Edges lie at linear quantiles of the ranks 1..n, computed in this order of operations, as
    neighbours of an edge depend on it; ntile cuts elsewhere.
    """

    def edge(k: Column) -> Column:
        p = F.when(k == q, 1.0).otherwise(k * (1.0 / q))
        v = (n - 1) * ((p * 100) / 100)
        low = F.floor(v)
        g, a, b = v - low, low + 1, F.least(low + 2, n)
        return F.when(g >= 0.5, b - (b - a) * (1 - g)).otherwise(a + (b - a) * g)

    below = F.aggregate(F.sequence(F.lit(0), F.lit(q)), F.lit(0), lambda s, k: s + F.when(edge(k) < rank, 1).otherwise(0))
    return F.greatest(below - 1, F.lit(0)).cast("int")


def quantile_bins(df: DataFrame, value: str, key: str, q: int, out: str, within: str | None = None) -> DataFrame:
    """Adds ``out``: the quantile bin of ``value`` by first rank (ties by ``key``), over all rows or within a group.

    Ranks over all rows are running counts by ranges of the value, so no task sorts everything.
    """
    if within is None:
        rows = running(df, value, key, True, [], {"_r": F.lit(1)})
        n = df.agg(F.count("*").alias("_n"))  # one row
        rows = with_totals(rows, n, [])
    else:
        part = Window.partitionBy(F.col(within))
        rows = df.withColumns({"_r": F.row_number().over(part.orderBy(value, key)), "_n": F.count("*").over(part)})
    return rows.withColumn(out, rank_quantile(F.col("_r"), F.col("_n"), q)).drop("_r", "_n")


def nested_bins(df: DataFrame, group: str, value: str, key: str, q: int, out: str) -> DataFrame:
    """Adds ``out``: group and quantile bin within it as one label, with a point between."""
    df = quantile_bins(df, value, key, q, "_sub", within=group)
    return df.withColumn(out, F.concat_ws(".", F.col(group).cast("string"), F.col("_sub").cast("string"))).drop("_sub")


def whitened(df: DataFrame, x: str, y: str) -> DataFrame:
    """Adds z1 and z2: (x, y) solved against the upper Cholesky factor of their covariance (no centring)."""
    s = df.agg(F.var_samp(x).alias("_s11"), F.covar_samp(x, y).alias("_s12"), F.var_samp(y).alias("_s22"))  # one row
    u12 = F.col("_s12") / F.sqrt("_s11")
    z2 = F.col(y) / F.sqrt(F.col("_s22") - u12 * u12)
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(s.withColumn("_k", F.lit(1))), "_k").withColumns({"z2": z2, "z1": (F.col(x) - u12 * z2) / F.sqrt("_s11")}).drop("_k", "_s11", "_s12", "_s22")


def above(value: Column, edges: list[float]) -> Column:
    """The right-closed bin (from 0) between rising edges; the lowest edge belongs to the first."""
    return F.greatest(sum((F.when(value > e, 1).otherwise(0) for e in edges[:-1]), F.lit(0)) - 1, F.lit(0)).cast("int")


def value_quantiles(df: DataFrame, value: str, q: int) -> list[float]:
    """The distinct linear quantiles of a column that cut it into q parts."""
    found = df.agg(F.percentile(value, [i / q for i in range(q + 1)])).first()[0]
    return sorted(set(found or []))


def width_bins(df: DataFrame, value: str, key: str, q: int, least: int, out: str) -> DataFrame:
    """Adds ``out``: bins of the value by equal width that hold ``least`` rows each, as far as that can be had.

    q bins of equal width come first. While one that isn't empty holds too few rows, the range is cut
    into m times as many (m = 1, 2, ...); the lowest q - q // 2 of these stay and all rows above are cut
    into as many quantiles again. When m passes the number of distinct values over ``least``, quantiles
    of all rows are taken. Null stays null. The loop looks at bin counts only.
    """
    rows = df.withColumn("_v", F.col(value).cast("double"))
    known = rows.filter("_v is not null")
    lo, hi, distinct = known.agg(F.min("_v"), F.max("_v"), F.count_distinct("_v")).first()
    v = F.col("_v")

    def cut(k: int) -> Column:
        return above(v, [lo + i * ((hi - lo) / k) for i in range(k + 1)])

    def smallest(label: Column) -> int:
        return known.groupBy(label.alias("_b")).count().agg(F.min("count")).first()[0]

    def done(label: Column) -> DataFrame:
        return rows.withColumn(out, F.when(v.isNotNull(), label)).drop("_v")

    if lo is None or hi == lo:
        return done(F.lit(0 if lo is None else q // 2 if q % 2 else q // 2 - 1).cast("int"))
    label, low, m = cut(q), q - q // 2, 1
    while smallest(label) < least:
        if m > distinct // least:
            return done(above(v, value_quantiles(known, "_v", q)))
        fine = cut(q * m)
        edges = value_quantiles(known.filter(fine >= low), "_v", low)
        label = F.when(fine >= low, low + above(v, edges) if edges else F.lit(low)).otherwise(fine)
        m += 1
    return done(label)


def percent_rank_average(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds ``out``: the average rank of equal values, as a share of the number of non-null ones; null stays null."""
    levels = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    ranked = with_totals(running(levels, value, value, True, [], {"_upto": F.col("_c")}), levels.agg(F.sum("_c").alias("_n")), [])
    share = (F.col("_upto") - (F.col("_c") - 1) / 2) / F.col("_n")
    return df.join(ranked.select(F.col(value).alias("_at"), share.alias(out)), F.col(value) == F.col("_at"), "left").drop("_at")


def edges_label(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins with the lowest edge included; null outside and for null."""
    out = F.when((value >= edges[0]) & (value <= edges[1]), labels[0])
    for low, high, label in zip(edges[1:-1], edges[2:], labels[1:]):
        out = out.when((value > low) & (value <= high), label)
    return out


def percentile_bins(df: DataFrame, value: str, edges: list[float], labels: list[str], out: str) -> DataFrame:
    return percent_rank_average(df, value, "_pct").withColumn(out, edges_label(F.col("_pct"), edges, labels)).drop("_pct")


def threshold_label(value: Column, threshold: float, low: str, high: str) -> Column:
    return F.when(value <= threshold, low).when(value > threshold, high)


def count_label(value: Column, bins: list[tuple[int, int | None]]) -> Column:
    """Ranges of counts: (a, b) is 'a-b', (a, a) is 'a', (a, None) is 'a+'. Ranges mustn't overlap."""
    ordered = sorted(bins, key=lambda b: b[0])
    for (_, high), (low, _) in zip(ordered, ordered[1:]):
        if high is None or low <= high:
            raise ValueError("ranges overlap")
    out = F.lit(None).cast("string")
    for low, high in ordered:
        label = f"{low}+" if high is None else f"{low}" if low == high else f"{low}-{high}"
        out = F.when((value >= low) & (F.lit(True) if high is None else value <= high), label).otherwise(out)
    return out


def combined_label(first: Column, second: Column) -> Column:
    """Both labels with an underscore between, null if either is missing."""
    return F.concat(first.cast("string"), F.lit("_"), second.cast("string"))
