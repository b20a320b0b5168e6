"""How far data sets agree on links: sizes, joint sizes, odds ratios and chi-squared tests for all pairs, from one reading of the links.

Links are dealt into buckets by hash. In a bucket each data set is a bitmap over the bucket's own
links, one for the links that it has and one for its positive ones, and joint sizes are set bits of
their conjunctions. Only counts leave a bucket, a few for each pair of data sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_sf
from ..sources.shared import stored
from .metrics import odds_ratio

#: Links of a bucket, about, and data sets at most (pairs of them are what is counted).
BUCKET, MOST_SETS = 16_384, 1000

COUNTS = "a int, b int, common long, pos_both long, pos_any long, any_pos long"


def bucket_counts(part: pa.Table, n_sets: int) -> pa.Table:
    """Joint counts of all pairs a <= b of data sets in one bucket; pairs without a common link are left out."""
    link = np.unique(part.column("link").to_numpy(), return_inverse=True)[1]
    owner, positive = part.column("set").to_numpy(), part.column("positive").to_numpy(zero_copy_only=False).astype(bool)
    bits = np.zeros((2, n_sets, int(link.max()) + 1), bool)
    bits[0, owner, link] = True
    bits[1, owner[positive], link[positive]] = True
    every, pos = np.packbits(bits, axis=2)
    here = np.unique(owner)
    count = lambda one, others: np.bitwise_count(one[None, :] & others).sum(axis=1, dtype=np.int64)
    out: list[np.ndarray] = []
    for k, a in enumerate(here):
        b = here[k:]
        both = count(every[a], every[b])
        rows = np.stack([np.full(len(b), a), b, both, count(pos[a], pos[b]), count(pos[a], every[b]), count(every[a], pos[b])], axis=1)
        out.append(rows[both > 0])
    found = np.concatenate(out)
    return pa.table({n: pa.array(found[:, i], pa.int32() if i < 2 else pa.int64()) for i, n in enumerate(("a", "b", "common", "pos_both", "pos_any", "any_pos"))})


def pair_counts(links: DataFrame, dataset: str, link: str, positive: str) -> DataFrame:
    """a, b, common, pos_both, pos_any, any_pos for data sets a <= b: links that both have, that are positive in both, in a, and in b among these.

    Repeated links of a data set count once, positive if any is; a null ``positive`` isn't; null
    links and data sets are left out. Pairs without a common link don't come up.
    """
    rows = links.filter(F.col(dataset).isNotNull() & F.col(link).isNotNull())
    rows = stored(rows.groupBy(F.xxhash64(link).alias("link"), F.col(dataset).cast("string").alias("name")).agg(F.max(F.coalesce(F.col(positive).cast("boolean"), F.lit(False))).alias("positive")), "agreement-links")
    names = [r["name"] for r in rows.select("name").distinct().orderBy("name").limit(MOST_SETS + 1).collect()]
    if len(names) > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} data sets")
    numbered = rows.join(rows.sparkSession.createDataFrame(list(enumerate(names)), "set int, name string"), "name")
    n = max(1, -(-rows.count() // BUCKET))
    numbered = numbered.select("link", "set", "positive", F.pmod(F.xxhash64("link"), F.lit(n)).alias("bucket"))
    width = len(names)
    found = numbered.groupBy("bucket").applyInArrow(lambda part: bucket_counts(part, width), COUNTS).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("common", "pos_both", "pos_any", "any_pos")])
    told = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return found.select(F.get(told, F.col("a")).alias("a"), F.get(told, F.col("b")).alias("b"), "common", "pos_both", "pos_any", "any_pos")


def paired_sizes(counts: DataFrame, first: str, second: str) -> DataFrame:
    """category, first, second, joint: own and common sizes of two data sets, of all links and of positive ones; 0 where there are none."""
    own = lambda name, c: F.coalesce(F.max(F.when((F.col("a") == name) & (F.col("b") == name), F.col(c))), F.lit(0))
    pair = lambda c: F.coalesce(F.max(F.when((F.col("a") == min(first, second)) & (F.col("b") == max(first, second)), F.col(c))), F.lit(0))
    kinds = [F.struct(F.lit(kind).alias("category"), own(first, c).alias("first"), own(second, c).alias("second"), pair(c).alias("joint")) for kind, c in (("links", "common"), ("positive", "pos_both"))]
    return counts.agg(F.array(*kinds).alias("_k")).select(F.inline("_k"))


def odds_matrix(counts: DataFrame, corrected: bool = True) -> DataFrame:
    """a, b, odds_ratio, chi_squared, p_value of positive links for data sets a < b, of the table [[positive in both, only in b], [only in a, common links]].

    The last cell is all common links, not the rest of them. ``corrected``: if a cell is 0, all get
    another 0.5 for the odds, and chi-squared is corrected for continuity. Where a row or a column
    of the table is empty, chi-squared is null.
    """
    n3 = F.col("pos_both").cast("double")
    n4, n2, n1 = F.col("any_pos") - n3, F.col("pos_any") - n3, F.col("common").cast("double")
    shift = F.when(F.least(n1, n2, n3, n4) == 0, 0.5).otherwise(0.0) if corrected else F.lit(0.0)
    total = n1 + n2 + n3 + n4
    cells = [(n3, n3 + n4, n3 + n2), (n4, n3 + n4, n4 + n1), (n2, n2 + n1, n3 + n2), (n1, n2 + n1, n4 + n1)]
    chi = F.lit(0.0)
    for seen, row, column in cells:
        expected = row * column / total
        off = F.abs(seen - expected)
        off = off - F.least(off, F.lit(0.5)) if corrected else off
        chi = chi + F.try_divide(off * off, expected)
    rows = counts.filter("a < b").select("a", "b", odds_ratio(n3 + shift, n4 + shift, n2 + shift, n1 + shift).alias("odds_ratio"), chi.alias("chi_squared"))
    return rows.withColumn("p_value", 2 * normal_sf(F.sqrt("chi_squared")))
