"""The jobs of an association study as functions on tables, from links to p-values.

Each takes DataFrames and returns DataFrames; ids are join keys, so nothing depends on the order
of rows, and results can be written by partition and read again at any point.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.binning import combined_label, nested_bins, quantile_bins, whitened
from ..operators.intervals import overlap_flag, window_links
from ..operators.matrix import feature_moments
from ..operators.nulls import control_features, control_pairs, refuse, short_features, short_pairs
from ..operators.pairs import histograms, pearson, poisson_fit, spearman
from ..operators.pvalues import benjamini_hochberg, empirical_fdr, monte_carlo, pooled, studentised, z_scores
from ..sources.shared import stored


@dataclass(frozen=True)
class Bins:
    """Numbers of bins and controls, as in '5.5.5.5.1000'; 'inf' for both of the second side means controls of the first side only."""

    first: int
    first_nested: int
    second: int | None
    second_nested: int | None
    controls: int

    @classmethod
    def parse(cls, text: str) -> Bins:
        a, b, c, d, n = text.split(".")
        return cls(int(a), int(b), None if c == "inf" else int(c), None if d == "inf" else int(d), int(n))

    @property
    def one_sided(self) -> bool:
        return self.second is None


def generate_links(peaks: DataFrame, genes: DataFrame, distance: int, bin_width: int) -> DataFrame:
    """link_id, x_id, y_id, overlap."""
    links = window_links(peaks, genes, distance, bin_width)
    return links.select(F.concat_ws(";", F.col("peak_id").cast("string"), F.col("gene_id").cast("string")).alias("link_id"), F.col("peak_id").alias("x_id"), F.col("gene_id").alias("y_id"), "overlap")


def feature_bins(counts: DataFrame, n_cells: int, main: int, nested: int, second: str = "var", extra: DataFrame | None = None) -> DataFrame:
    """feature_id, bin: quantiles of the mean, cut again by a second column (the variance, or one of ``extra``)."""
    m = feature_moments(counts, n_cells)
    m = m if extra is None else m.join(extra, "feature_id")
    m = quantile_bins(m, "mean", "feature_id", main, "mean_bin")
    return nested_bins(m, "mean_bin", second, "feature_id", nested, "bin").select("feature_id", "mean_bin", "bin")


def whitened_gc_bins(counts: DataFrame, n_cells: int, gc: DataFrame, main: int, nested: int) -> DataFrame:
    """feature_id, main_bin, bin: quantiles of the log total, whitened with the GC content (feature_id, gc), cut again by the whitened GC content."""
    m = feature_moments(counts, n_cells).join(gc.select("feature_id", "gc"), "feature_id").filter("gc is not null")
    m = stored(whitened(m, "log_total", "gc").select("feature_id", "z1", "z2"), "whitened")
    m = quantile_bins(m, "z1", "feature_id", main, "main_bin")
    return nested_bins(m, "main_bin", "z2", "feature_id", nested, "bin").select("feature_id", "main_bin", "bin")


def promoter_peaks(peaks: DataFrame, genes: DataFrame, distance: int = 2000, bin_width: int = 100_000) -> DataFrame:
    """``peaks`` (peak_id, chrom, start, end) with ``promoter``: 1 where a peak overlaps the surroundings of a gene's start (chrom, tss), else 0.

    Chromosomes of genes may lack the prefix chr. Genes without a start don't count.
    """
    name = F.when(F.col("chrom").startswith("chr"), F.col("chrom")).otherwise(F.concat(F.lit("chr"), "chrom"))
    starts = genes.filter("tss is not null").select(name.alias("r_chrom"), F.greatest(F.col("tss") - distance, F.lit(0)).cast("long").alias("r_start"), (F.col("tss") + distance).cast("long").alias("r_end")).distinct()
    return overlap_flag(peaks, starts, "peak_id", bin_width).withColumnRenamed("flag", "promoter")


def with_promoter(bins: DataFrame, peaks: DataFrame) -> DataFrame:
    """``bins`` (feature_id, bin) with the promoter flag of each peak as the last part of the bin, so that controls are drawn among peaks of one kind."""
    flag = peaks.select(F.col("peak_id").alias("feature_id"), "promoter")
    return bins.join(flag, "feature_id", "left").withColumn("bin", F.concat_ws(".", "bin", F.coalesce("promoter", F.lit(0)).cast("string"))).drop("promoter")


def generate_controls(x: DataFrame, y: DataFrame, n_cells: int, bins: Bins, seed: int = 0, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Control table and the bins of both sides. One-sided: (feature_id, ctrl_rank, ctrl_id); else (bin, ctrl_rank, left_id, right_id).

    A bin that has fewer controls than asked is an error, or without ``strict`` has all that there are.
    """
    xb = stored(feature_bins(x, n_cells, bins.first, bins.first_nested), "x-bins")
    if bins.one_sided:
        if strict:
            refuse(short_features(xb, "bin", bins.controls))
        return control_features(xb, "bin", bins.controls, seed), xb, None
    yb = stored(feature_bins(y, n_cells, bins.second, bins.second_nested), "y-bins")
    pair = lambda df: df.select(F.col("feature_id").alias("id"), "bin")
    if strict:
        refuse(short_pairs(pair(xb), pair(yb), bins.controls))
    return control_pairs(pair(xb), pair(yb), bins.controls, seed), xb, yb


def with_shortfall(links: DataFrame, xb: DataFrame, yb: DataFrame | None, bins: Bins) -> DataFrame:
    """Adds ``ctrl_short``: how many of the controls asked the link's bin lacks, which makes its p-values coarser."""
    missing = (F.col("asked") - F.col("available")).alias("_short")
    if yb is None:
        short = short_features(xb, "bin", bins.controls).select("bin", missing)
        short = xb.select("feature_id", F.col("bin").cast("string").alias("bin")).join(short, "bin").select(F.col("feature_id").alias("x_id"), "_short")
        out = links.join(short, "x_id", "left")
    else:
        pair = lambda df: df.select(F.col("feature_id").alias("id"), "bin")
        out = links.join(short_pairs(pair(xb), pair(yb), bins.controls).select(F.col("bin").alias("grp"), missing), "grp", "left")
    return out.withColumn("ctrl_short", F.coalesce("_short", F.lit(0).cast("long"))).drop("_short")


def control_links(links: DataFrame, controls: DataFrame, bins: Bins) -> DataFrame:
    """link_id, grp, ctrl_rank, x_id, y_id: the pairs to be fitted for the null."""
    if bins.one_sided:
        out = links.select(F.col("link_id").alias("grp"), "x_id", "y_id").join(controls, F.col("x_id") == F.col("feature_id")).select("grp", "ctrl_rank", F.col("ctrl_id").alias("x_id"), "y_id")
    else:
        out = controls.select(F.col("bin").alias("grp"), "ctrl_rank", F.col("left_id").alias("x_id"), F.col("right_id").alias("y_id"))
    return out.withColumn("link_id", F.concat_ws("#", "grp", F.col("ctrl_rank").cast("string")))


def fit(links: DataFrame, x: DataFrame, y: DataFrame, n_cells: int, method: str = "poisson") -> DataFrame:
    """``links`` with beta and se (Poisson) or beta alone (Pearson, Spearman); also for control links, whose ``grp`` is the bin."""
    pairs = links.select("x_id", "y_id").distinct().withColumn("link_id", F.concat_ws(";", F.col("x_id").cast("string"), F.col("y_id").cast("string")))  # equal pairs are fitted once
    if method in ("pearson", "spearman"):
        got = (pearson if method == "pearson" else spearman)(pairs, x, y, n_cells).select("x_id", "y_id", F.col("corr").alias("beta"), F.lit(None).cast("double").alias("se"))
    else:
        got = poisson_fit(histograms(pairs, x, y, n_cells)).select("x_id", "y_id", F.col("b1").alias("beta"), "se")
    return links.join(got, ["x_id", "y_id"], "left")


def p_values(cis: DataFrame, ctrl: DataFrame, group: str) -> DataFrame:
    """Monte Carlo, pooled and z p-values of beta and of beta / se (suffix _z), and empirical and step-up false discovery rates.

    ``link_id`` tells the rows of ``cis`` apart. Each p-value is made from the same small stored table
    and joined once; made one on top of the other, plans would double with every step.
    """
    cis = stored(cis.withColumn("stud", studentised(F.col("beta"), F.col("se"))), "p-links")
    c = stored(ctrl.select(group, "beta", studentised(F.col("beta"), F.col("se")).alias("stud")), "p-controls")
    obs = cis.select("link_id", group, "beta", "stud")
    found = []
    for value, suffix in (("stud", "_z"), ("beta", "")):
        own, ctl = obs.select("link_id", group, value), c.select(group, F.col(value).alias("_c"))
        found += [
            monte_carlo(own, ctl, value, "_c", "link_id", group).select("link_id", F.col("mcpval").alias(f"mcpval{suffix}")),
            pooled(own, ctl, value, "_c", "link_id", group).select("link_id", F.col("ppval").alias(f"ppval{suffix}")),
            z_scores(own, ctl, value, "_c", group).select("link_id", F.col("zpval").alias(f"zpval{suffix}")),
        ]
    found.append(empirical_fdr(obs.select("link_id", "stud"), c.select(F.col("stud").alias("_c")), "stud", "_c", "link_id").select("link_id", "q_value"))
    out = stored(reduce(lambda a, b: a.join(b, "link_id", "left"), found, cis), "p-values")
    return benjamini_hochberg(out, "mcpval", "link_id")


def associate(x: DataFrame, y: DataFrame, peaks: DataFrame, genes: DataFrame, n_cells: int, config: str, distance: int, bin_width: int, method: str = "poisson", seed: int = 0) -> DataFrame:
    """The whole study: links, their statistics, controls (``ctrl_short``: how many a link's bin lacks), p-values. Counts, links and fits are written once, as every p-value reads them again."""
    bins = Bins.parse(config)
    x, y = stored(x, "x"), stored(y, "y")
    links = generate_links(peaks, genes, distance, bin_width)
    controls, xb, yb = generate_controls(x, y, n_cells, bins, seed, strict=False)
    if bins.one_sided:
        links = links.withColumn("grp", F.col("link_id"))
    else:
        a, b = xb.select(F.col("feature_id").alias("x_id"), F.col("bin").alias("_xb")), yb.select(F.col("feature_id").alias("y_id"), F.col("bin").alias("_yb"))
        links = links.join(a, "x_id").join(b, "y_id").withColumn("grp", combined_label(F.col("_xb"), F.col("_yb"))).drop("_xb", "_yb")
    links = stored(with_shortfall(links, xb, yb, bins), "links")
    cis = stored(fit(links, x, y, n_cells, method), "cis")
    ctrl = stored(fit(control_links(links, controls, bins), x, y, n_cells, method), "ctrl")
    return p_values(cis, ctrl, "grp")


#: Groups of cells at most that are told apart.
MOST_GROUPS = 1000


def by_group(x: DataFrame, y: DataFrame, cells: DataFrame, group: str, links: DataFrame, least: int = 10) -> DataFrame:
    """Links fitted again within each group of cells with at least ``least`` cells: adds the group's column, beta and se.

    The group is part of each feature's key, so all groups are one plan. Cells without a group, and
    counts of unknown cells, are left out.
    """
    known = cells.filter(F.col(group).isNotNull())
    sizes = known.groupBy(group).count().filter(F.col("count") >= least).orderBy(group).limit(MOST_GROUPS + 1).collect()  # one row a cell type
    if len(sizes) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups of cells")
    kind = cells.schema[group].dataType
    names = F.array(*[F.struct(F.lit(r[group]).cast(kind).alias("g"), F.lit(r["count"]).cast("long").alias("n")) for r in sizes]) if sizes else F.array().cast(f"array<struct<g:{kind.simpleString()},n:bigint>>")
    own = known.select("cell_id", F.col(group).alias("_g"))
    keyed = lambda m: m.join(own, "cell_id").select("cell_id", F.struct(F.col("feature_id").alias("f"), F.col("_g").alias("g")).alias("feature_id"), "value")
    both = lambda c: F.struct(F.col(c).alias("f"), F.col("_k.g").alias("g")).alias(c)
    pairs = links.select("x_id", "y_id").distinct().withColumn("_k", F.explode(names)).select(both("x_id"), both("y_id"), F.col("_k.n").alias("_n"))
    pairs = pairs.withColumn("link_id", F.struct("x_id", "y_id"))
    fits = poisson_fit(histograms(pairs, stored(keyed(x), "x"), stored(keyed(y), "y"), "_n"))
    fits = fits.select(F.col("x_id.f").alias("x_id"), F.col("y_id.f").alias("y_id"), F.col("x_id.g").alias(group), F.col("b1").alias("beta"), "se")
    return links.join(fits, ["x_id", "y_id"])


