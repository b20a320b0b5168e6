"""Meta-analysis of effects over data sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import clean, draw, normal_sf
from ..sources.shared import stored
from .metrics import drawn


def combined(effects: DataFrame, effect: str, se: str, within: list[str] | None = None, random: bool = True) -> DataFrame:
    """within, estimate, se, z, p, q, tau2: inverse-variance weights; with ``random``, the variance between sets (DerSimonian and Laird) is added."""
    within = within or []
    w, y = 1 / (F.col(se) * F.col(se)), F.col(effect)
    s = effects.filter(F.col(effect).isNotNull() & (F.col(se) > 0)).groupBy(*within).agg(F.sum(w).alias("_w"), F.sum(w * y).alias("_wy"), F.sum(w * w).alias("_ww"), F.sum(w * y * y).alias("_wyy"), F.count("*").alias("n"))
    q = F.greatest(F.col("_wyy") - F.col("_wy") * F.col("_wy") / F.col("_w"), F.lit(0.0))
    scale = F.col("_w") - F.col("_ww") / F.col("_w")
    tau = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(q - (F.col("n") - 1), F.when(scale > 1e-12, scale)), F.lit(0.0)))
    s = s.select(*within, "n", q.alias("q"), (tau if random else F.lit(0.0)).alias("tau2"))
    on = effects.filter(F.col(effect).isNotNull() & (F.col(se) > 0))
    both = on.join(F.broadcast(s), within) if within else on.withColumn("_k", F.lit(1)).join(F.broadcast(s.withColumn("_k", F.lit(1))), "_k")
    v = 1 / (F.col(se) * F.col(se) + F.col("tau2"))
    out = both.groupBy(*within, "n", "q", "tau2").agg((F.sum(v * y) / F.sum(v)).alias("estimate"), F.sqrt(1 / F.sum(v)).alias("se"))
    z = F.col("estimate") / F.col("se")
    return out.select(*within, "n", "q", "tau2", "estimate", "se", z.alias("z"), (2 * normal_sf(F.abs(z))).alias("p"))


def slope(df: DataFrame, x: str, y: str, within: list[str], weight: str | None = None) -> DataFrame:
    """within, intercept, slope of a weighted line by its normal equations."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    s = df.groupBy(*within).agg(F.sum(w).alias("_n"), F.sum(w * F.col(x)).alias("_x"), F.sum(w * F.col(y)).alias("_y"), F.sum(w * F.col(x) * F.col(x)).alias("_xx"), F.sum(w * F.col(x) * F.col(y)).alias("_xy"))
    b = F.try_divide(F.col("_n") * F.col("_xy") - F.col("_x") * F.col("_y"), F.col("_n") * F.col("_xx") - F.col("_x") * F.col("_x"))
    return s.select(*within, ((F.col("_y") - b * F.col("_x")) / F.col("_n")).alias("intercept"), b.alias("slope"))


def bootstrap_slope(df: DataFrame, x: str, y: str, dataset: str, n: int = 2000, weight: str | None = None, seed: int = 1) -> DataFrame:
    """rep, intercept, slope: the line fitted to whole data sets drawn with replacement, rep 0 being all of them once."""
    sets = df.select(dataset).distinct().withColumn("_key", F.xxhash64(dataset))
    reps = drawn(sets, n, "_key", [], seed).select(dataset, "rep", F.col("weight").alias("_times"))
    rows = df.join(F.broadcast(reps), dataset).withColumn("_times", F.col("_times") * (F.lit(1.0) if weight is None else F.col(weight)))
    return slope(rows, x, y, ["rep"], "_times")


#: Levels of a factor at most.
MOST_LEVELS = 100


def terms_of(formula: str) -> tuple[str, list[tuple[str, ...]]]:
    """The outcome and the terms of 'y ~ a + b + a:b' or 'y ~ a * b', each a tuple of columns; 1 is always among them."""
    outcome, _, right = formula.partition("~")
    terms: list[tuple[str, ...]] = []
    for term in right.split("+"):
        parts = [p.strip() for p in term.split("*")]
        for chosen in range(1, 1 << len(parts)):
            names = tuple(n.strip() for k, p in enumerate(parts) if chosen >> k & 1 for n in p.split(":"))
            if names != ("1",) and names not in terms:
                terms.append(names)
    return outcome.strip(), sorted(terms, key=len)


def expanded(df: DataFrame, terms: list[tuple[str, ...]]) -> list[tuple[str, Column]]:
    """Names and columns of the intercept and the terms: factors (strings and booleans) become an indicator for each level but the first, interactions all products."""
    kinds, out = dict(df.dtypes), [("Intercept", F.lit(1.0))]
    levels: dict[str, list] = {}
    for name in {n for t in terms for n in t if kinds[n] in ("string", "boolean")}:
        found = [r[0] for r in df.select(name).filter(F.col(name).isNotNull()).distinct().orderBy(name).limit(MOST_LEVELS + 1).collect()]
        if len(found) > MOST_LEVELS:
            raise ValueError(f"{name} has more than {MOST_LEVELS} levels")
        levels[name] = found[1:]
    for term in terms:
        made: list[tuple[str, Column]] = [("", F.lit(1.0))]
        for name in term:
            own = [(f"{name}[{v}]", F.when(F.col(name) == v, 1.0).otherwise(0.0)) for v in levels[name]] if name in levels else [(name, F.col(name).cast("double"))]
            made = [(f"{a}:{b}" if a else b, x * y) for a, x in made for b, y in own]
        out += made
    return out


def bootstrap_formula(df: DataFrame, formula: str, dataset: str, n: int = 2000, weight: str | None = None, seed: int = 1) -> DataFrame:
    """rep, term, coefficient of a (weighted) linear model fitted to whole data sets drawn with replacement, rep 0 being all of them once.

    Every data set gives one matrix of sums of products; a replicate is a sum of these with its
    multiplicities, so rows are read once and never copied. Rows with a null or NaN in any column of
    the model are left out; data sets without other rows aren't drawn. Where a replicate doesn't
    tell coefficients apart, they are those of least length, each in units of its column.
    """
    outcome, terms = terms_of(formula)
    used = sorted({outcome, dataset, *([weight] if weight else []), *(c for t in terms for c in t)})
    numbers = [c for c in used if dict(df.dtypes)[c] in ("double", "float")]
    rows = df.select(*used).dropna(subset=used)
    for c in numbers:
        rows = rows.filter(~F.isnan(c))
    named = expanded(rows, terms)
    names, k = [t for t, _ in named], len(named)
    z, y, w = [c for _, c in named], F.col(outcome).cast("double"), F.lit(1.0) if weight is None else F.col(weight).cast("double")
    sums = [F.sum(w * z[i] * z[j]) for i in range(k) for j in range(i, k)] + [F.sum(w * z[i] * y) for i in range(k)]
    gram = stored(rows.groupBy(F.col(dataset).alias("_set")).agg(F.array(*sums).alias("_g")), "formula-sums")  # a row a data set
    order = Window.orderBy("_set")  # one row a data set
    sets = gram.select("_set", (F.row_number().over(order) - 1).cast("long").alias("_pos"))
    m = gram.count()
    slots = sets.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n)))) if n else None
    first = gram.select("_g", F.lit(0).alias("rep"), F.lit(1).cast("long").alias("_times"))
    every = first
    if n and m:
        hits = slots.groupBy("rep", F.pmod(draw(F.col("_pos"), F.col("rep"), seed), F.lit(m)).alias("_pos")).agg(F.count("*").alias("_times"))
        every = first.unionByName(hits.join(sets, "_pos").join(gram, "_set").select("_g", "rep", "_times"))
    size = k * (k + 1) // 2 + k
    total = every.groupBy("rep").agg(F.array(*[F.sum(F.col("_times") * F.get("_g", F.lit(i))) for i in range(size)]).alias("_g"))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(k)
        for batch in batches:
            g = batch.column("_g").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            a = np.zeros((len(g), k, k))
            a[:, i, j] = a[:, j, i] = g[:, : len(i)]
            scale = np.sqrt(np.maximum(np.diagonal(a, axis1=1, axis2=2), 1e-300))  # columns of one length, so that pinv judges them alike
            b = (np.linalg.pinv(a / scale[:, :, None] / scale[:, None, :], hermitian=True, rcond=1e-12) @ (g[:, len(i) :] / scale)[:, :, None])[:, :, 0] / scale
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("rep").to_numpy(), k), pa.int32()), pa.array(names * len(g)), pa.array(b.ravel())], names=["rep", "term", "coefficient"])

    return total.mapInArrow(solved, "rep int, term string, coefficient double")


def coefficient_summary(coefficients: DataFrame, level: float = 0.95) -> DataFrame:
    """term, estimate, bootstrap_sd, ci_lower, ci_upper, p_value of coefficients by ``rep``; p is two-sided about 0."""
    boot, a = F.when(F.col("rep") > 0, clean(F.col("coefficient"))), (1 - level) / 2
    p = 2 * F.least(F.avg((boot <= 0).cast("int")), F.avg((boot >= 0).cast("int")))
    return coefficients.groupBy("term").agg(F.max(F.when(F.col("rep") == 0, F.col("coefficient"))).alias("estimate"), F.stddev_samp(boot).alias("bootstrap_sd"), F.percentile(boot, F.lit(a)).alias("ci_lower"), F.percentile(boot, F.lit(1 - a)).alias("ci_upper"), F.least(F.lit(1.0), p).alias("p_value"))
