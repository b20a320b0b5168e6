"""The registered queries over the operators of link analysis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..functions.special import cauchy_combined
from ..operators import agreement, annotation, binning, causal, dedup, intervals, jackknife, matrix, meta, metrics, neighbourhoods, nulls, pairs, pvalues, residuals, specificity, ties
from ..sources import readers
from ..sources.shared import stored
from . import evaluation, jobs
from .inputs import N_X, N_Y, Inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(make: Callable[[Inputs], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(Inputs(spark, sf_dir))

    QUERIES[make.__name__] = run
    return run


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded as the oracles round; minus zero is zero."""
    return F.round(c, digits) + 0.0


def sides(tag: str) -> tuple[str, str, str]:
    return (f"{tag}chrom", f"{tag}start", f"{tag}end")


def renamed(df: DataFrame, tag: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{tag}{c}") for c in df.columns])


@query
def cis_window_links(t: Inputs) -> DataFrame:
    links = jobs.generate_links(t.peaks(), t.genes(), distance=3000, bin_width=5000)
    got = pairs.pearson(links, t.x(), t.y(), t.n_cells())
    return links.join(got.select("link_id", "corr"), "link_id").select("link_id", "x_id", "y_id", "overlap", r("corr").alias("corr"))


@query
def interval_semi_flag(t: Inputs) -> DataFrame:
    windows = t.spans().filter("event_type = 'purchase'").select(F.col("chrom").alias("w_chrom"), (F.col("start") - 3600).alias("w_start"), (F.col("start") + 3600).alias("w_end"))
    out = intervals.overlap_flag(t.spans(), windows, "event_id", 7200, right_cols=sides("w_"))
    return out.select("event_id", "flag")


@query
def interval_left_count(t: Inputs) -> DataFrame:
    other = renamed(t.spans().filter("event_type = 'error'").select("chrom", "start", "end"), "r_")
    return intervals.overlap_count(t.spans(), other, "event_id", 3600).select("event_id", "n_overlaps")


@query
def interval_reciprocal_overlap(t: Inputs) -> DataFrame:
    got = intervals.overlap_join(t.spans(), renamed(t.spans(), "r_"), 3600, min_left_fraction=0.5, reciprocal=True).filter("event_id < r_event_id")
    return got.select("event_id", "r_event_id", "overlap")


@query
def interval_fraction_overlap(t: Inputs) -> DataFrame:
    got = intervals.overlap_join(t.spans(), renamed(t.spans().filter("event_type = 'view'"), "r_"), 3600, min_left_fraction=0.25)
    return got.groupBy("event_id").agg(F.count("*").alias("n_views"), F.sum("overlap").alias("seconds"))


@query
def nearest_signed_distance(t: Inputs) -> DataFrame:
    first = t.spans().filter("event_type = 'purchase'").groupBy(F.col("chrom").alias("c")).agg(F.min("start").alias("tss"))
    got = t.spans().join(first, F.col("chrom") == F.col("c"), "left")
    d = intervals.signed_distance(F.col("start"), F.col("end"), F.col("tss"))
    return got.select("event_id", d.alias("signed_distance"), F.abs(d).alias("distance"))


@query
def body_gap_distance(t: Inputs) -> DataFrame:
    body = t.spans().filter("event_type = 'signup'").groupBy(F.col("chrom").alias("c")).agg(F.min("start").alias("s"), F.max("end").alias("e"))
    return t.spans().join(body, F.col("chrom") == F.col("c"), "left").select("event_id", intervals.gap(F.col("start"), F.col("end"), F.col("s"), F.col("e")).alias("gap"))


@query
def gene_activity(t: Inputs) -> DataFrame:
    got = intervals.activity(t.x(), t.peaks(), t.genes(), upstream=500, bin_width=2000)
    return got.groupBy("gene_id").agg(F.sum("value").alias("total"), F.count("*").alias("cells"))


@query
def sparse_feature_moments(t: Inputs) -> DataFrame:
    m = matrix.feature_moments(t.x(), t.n_cells())
    return m.select("feature_id", "nnz", "total", r("mean").alias("mean"), r("var").alias("var"), r("log_total").alias("log_total"))


@query
def group_moments(t: Inputs) -> DataFrame:
    m = matrix.group_moments(t.x(), t.cells(), "celltype")
    return m.select("celltype", "feature_id", r("mean").alias("mean"), r("var").alias("var"))


@query
def group_mean_pivot(t: Inputs) -> DataFrame:
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    wide = matrix.group_means_wide(t.x(), t.cells(), "celltype", names)
    return wide.select("feature_id", *[r(n).alias(n.lower()) for n in names])


@query
def feature_sparsity_filter(t: Inputs) -> DataFrame:
    kept = matrix.sparse_enough(t.x(), t.n_cells(), 0.6)
    return kept.groupBy("feature_id").agg(F.count("*").alias("cells"), F.sum("value").alias("total"))


@query
def qc_filter_chain(t: Inputs) -> DataFrame:
    rna, atac = matrix.quality_chain(t.y(), t.x(), t.n_cells(), min_features=8, min_cells=10, min_peak_cells=10, depth=(20, 60), features=(10, 38), sparsity=0.05)
    out = rna.select(F.lit("rna").alias("side"), "*").unionByName(atac.select(F.lit("atac").alias("side"), "*"))
    return out.groupBy("side", "feature_id").agg(F.count("*").alias("cells"), F.sum("value").alias("total"))


@query
def qc_summary_grouping_sets(t: Inputs) -> DataFrame:
    s = matrix.cell_summary(t.x(), t.cells(), "celltype", N_X)
    return s.select("cell_group", "n_cells", *[r(c).alias(c) for c in ("mean_depth", "median_depth", "mean_detected", "detect_rate", "sparsity")])


@query
def top_fraction_signal(t: Inputs) -> DataFrame:
    return matrix.top_share(t.x(), t.n_cells(), 0.1).select("n_top", r("top_share").alias("top_share"))


@query
def log_normalised_counts(t: Inputs) -> DataFrame:
    return matrix.normalised(t.y()).groupBy("feature_id").agg(r(F.sum("value"), 4).alias("total"))


@query
def rank_qcut_bins(t: Inputs) -> DataFrame:
    p = t.table("part").select("p_partkey", "p_brand", "p_retailprice")
    return binning.quantile_bins(p, "p_retailprice", "p_partkey", 7, "bin", within="p_brand").select("p_partkey", "p_brand", "bin")


@query
def nested_mean_var_bins(t: Inputs) -> DataFrame:
    return jobs.feature_bins(t.x().select("cell_id", "feature_id", "value"), t.n_cells(), 5, 3).select("feature_id", "mean_bin", "bin")


@query
def whitened_bins(t: Inputs) -> DataFrame:
    p = t.table("part").select("p_partkey", F.log10(F.col("p_retailprice")).alias("a"), (F.col("p_size") / 50.0).alias("b"))
    return binning.whitened(p, "a", "b").select("p_partkey", r("z1").alias("z1"), r("z2").alias("z2"))


@query
def value_bins(t: Inputs) -> DataFrame:
    d = t.table("events").select("event_id", (F.col("value") * F.col("value") * F.col("value")).alias("value"))  # skewed, so that equal widths don't do
    return binning.width_bins(d, "value", "event_id", 6, 20, "bin").groupBy("bin").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query
def percentile_rank_bins(t: Inputs) -> DataFrame:
    d = t.table("documents").select("doc_id", F.col("n_chars").cast("double").alias("v"))
    return binning.percentile_bins(d, "v", [0.0, 0.25, 0.5, 0.75, 1.0], ["q1", "q2", "q3", "q4"], "bin").select("doc_id", "bin")


@query
def bins_2d(t: Inputs) -> DataFrame:
    d = t.table("events").select("event_id", "value", F.col("user_id").cast("double").alias("u"))
    d = binning.percentile_bins(d, "value", [0.0, 0.5, 1.0], ["low", "high"], "a")
    d = binning.percentile_bins(d, "u", [0.0, 0.5, 1.0], ["low", "high"], "b")
    return d.groupBy(binning.combined_label(F.col("a"), F.col("b")).alias("bin")).agg(F.count("*").alias("n"))


@query
def threshold_bins(t: Inputs) -> DataFrame:
    label = binning.threshold_label(F.col("value"), 50.0, "low", "high")
    return t.table("events").groupBy("event_type", label.alias("bin")).agg(F.count("*").alias("n"))


@query
def count_bins(t: Inputs) -> DataFrame:
    n = t.table("orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    return n.groupBy(binning.count_label(F.col("k"), [(1, 1), (2, 5), (6, 10), (11, None)]).alias("bin")).agg(F.count("*").alias("n"))


@query
def distance_bins(t: Inputs) -> DataFrame:
    label = binning.edges_label(F.col("o_totalprice"), [0.0, 50000.0, 150000.0, 250000.0, 1e18], ["near", "mid", "far", "distal"])
    return t.table("orders").groupBy(label.alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"))


@query
def keep_best_dedup(t: Inputs) -> DataFrame:
    return dedup.keep_best(t.table("orders"), ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query
def label_consensus_dedup(t: Inputs) -> DataFrame:
    s = dedup.merged_duplicates(t.scores(), ["source"], "label", ["m1"], how="consensus", score="min", tie="half")
    s2 = t.scores().groupBy("source").agg(dedup.label_of("label", "any").alias("any_label"), r(dedup.label_of("label", "proportion")).alias("share"))
    return s.join(s2, "source").select("source", "label", "m1", "any_label", "share")


@query
def score_dedup_agg(t: Inputs) -> DataFrame:
    v = t.table("lineitem").groupBy("l_partkey")
    return v.agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), r(F.avg("l_discount")).alias("mean"), r(F.percentile("l_quantity", F.lit(0.5))).alias("median"))


@query
def outer_merge_methods(t: Inputs) -> DataFrame:
    a = t.table("orders").filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("urgent"))
    b = t.table("orders").filter("o_orderpriority = '5-LOW'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("low"))
    c = t.table("orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.min("o_totalprice").alias("pending"))
    return dedup.outer_merge([a, b, c], ["o_custkey"])


@query
def left_merge_unique(t: Inputs) -> DataFrame:
    return dedup.left_merge(t.table("documents").select("doc_id", "lang"), t.table("labels"), ["doc_id"])


@query
def replaced_score_column(t: Inputs) -> DataFrame:
    left = t.table("labels").select("doc_id", "quality", "toxic")
    right = t.table("documents").select("doc_id", F.col("n_chars").alias("toxic"))
    return dedup.replaced_column(left, right, ["doc_id"], "toxic")


@query
def union_distinct_links(t: Inputs) -> DataFrame:
    a = t.table("lineitem").filter("l_quantity > 25").select(F.col("l_partkey").alias("peak"), F.col("l_suppkey").alias("gene"))
    b = t.table("lineitem").filter("l_discount > 0.05").select(F.col("l_partkey").alias("peak"), F.col("l_suppkey").alias("gene"))
    return dedup.distinct_union([a, b])


@query
def missing_bins_anti(t: Inputs) -> DataFrame:
    return dedup.missing(t.table("part").select("p_partkey"), t.table("lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@query
def set_overlap_jaccard(t: Inputs) -> DataFrame:
    s = t.table("orders").select("o_orderpriority", "o_custkey").distinct()
    n = s.select(F.col("o_orderpriority").alias("a"), "o_custkey").join(s.select(F.col("o_orderpriority").alias("b"), "o_custkey"), "o_custkey").groupBy("a", "b").agg(F.count("*").alias("n"))
    return dedup.jaccard_matrix(n).select("a", "b", r("jaccard").alias("jaccard"))


@query
def control_peaks_hash(t: Inputs) -> DataFrame:
    f = t.table("part").select(F.col("p_partkey").alias("feature_id"), F.col("p_brand").alias("bin"))
    return nulls.control_features(f, "bin", 5, seed=3)


@query
def control_pairs_decode(t: Inputs) -> DataFrame:
    a = t.table("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("bin"))
    b = t.table("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 4).cast("string").alias("bin"))
    return nulls.control_pairs(a, b, 50, seed=11)


@query
def cross_group_null_pairs(t: Inputs) -> DataFrame:
    a = t.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).cast("long").alias("grp"))
    b = t.table("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).cast("long").alias("grp"))
    return nulls.other_group_partner(a, b, seed=5)


@query
def pearson_pairs(t: Inputs) -> DataFrame:
    return pairs.pearson(t.pairs(), t.x(), t.y(), t.n_cells()).select("link_id", r("corr").alias("corr"))


@query
def spearman_pairs(t: Inputs) -> DataFrame:
    return pairs.spearman(t.pairs(), t.x(), t.y(), t.n_cells()).select("link_id", r("corr").alias("corr"))


@query
def poisson_binary_mle(t: Inputs) -> DataFrame:
    return pairs.binary_fit(t.pairs(), t.x(), t.y(), t.n_cells()).select("link_id", r("b0").alias("b0"), r("b1").alias("b1"), r("se").alias("se"))


@query
def poisson_irls_hist(t: Inputs) -> DataFrame:
    h = pairs.histograms(t.pairs(), t.x(), t.y(), t.n_cells())
    return pairs.poisson_fit(h, rounds=25, tolerance=1e-10).select("link_id", r("b0", 5).alias("b0"), r("b1", 5).alias("b1"), r("se", 5).alias("se"))


@query
def poisson_fits_by_part(t: Inputs) -> DataFrame:
    links, x, y = t.parts_and_suppliers()
    x, y = stored(x, "x"), stored(y, "y")
    fits = pairs.poisson_fit(pairs.histograms(stored(links, "links"), x, y, t.n_cells()), rounds=12, tolerance=1e-10)
    return fits.groupBy("y_id").agg(F.count("*").alias("fits"), F.count_if(F.col("b1").isNotNull() & ~F.isnan("b1")).alias("finite"), r(F.min("b0"), 4).alias("least_b0"), r(F.max("b1"), 4).alias("most_b1"))


@query
def poisson_ridge(t: Inputs) -> DataFrame:
    h = pairs.histograms(t.pairs(), t.x(), t.y(), t.n_cells())
    return pairs.poisson_fit(h, rounds=50, tolerance=1e-10, ridge=1.0).select("link_id", r("b1", 5).alias("b1"))


@query
def poisson_likelihood_ratio(t: Inputs) -> DataFrame:
    fits = pairs.poisson_fit(pairs.histograms(t.pairs(), t.x(), t.y(), t.n_cells()), rounds=25, tolerance=1e-10)
    full = pairs.log_likelihood(fits, pairs.log_factorials(t.y()))
    both = full.join(pairs.reduced_log_likelihood(t.y(), t.n_cells()), "y_id")
    return both.select("link_id", r(2 * (F.col("ll") - F.col("ll0")), 3).alias("lr"))


@query
def poisson_reduced_ll(t: Inputs) -> DataFrame:
    return pairs.reduced_log_likelihood(t.y(), t.n_cells()).select("y_id", r("ll0", 3).alias("ll0"))


@query
def mc_pvalue(t: Inputs) -> DataFrame:
    obs, ctrl = t.controls()
    return pvalues.monte_carlo(obs, ctrl, "value", "ctrl", "key").select("key", r("mcpval", 9).alias("mcpval"))


@query
def binned_mc_pvalue(t: Inputs) -> DataFrame:
    obs, ctrl = t.controls()
    return pvalues.monte_carlo(obs, ctrl, "value", "ctrl", "key", "grp").select("key", r("mcpval", 9).alias("mcpval"))


@query
def two_sided_mc_pvalue(t: Inputs) -> DataFrame:
    obs, ctrl = t.controls()
    obs, ctrl = obs.withColumn("value", F.col("value") - 48), ctrl.withColumn("ctrl", F.col("ctrl") - 50)
    return pvalues.monte_carlo(obs, ctrl, "value", "ctrl", "key", "grp", two_sided=True).select("key", r("mcpval", 9).alias("mcpval"))


@query
def pooled_pvalue(t: Inputs) -> DataFrame:
    obs, ctrl = t.controls()
    # one value of a lattice for each group, so that rounding can't move a tie
    return pvalues.pooled(obs.withColumn("value", F.col("value") + 0.3137), ctrl, "value", "ctrl", "key", "grp").select("key", r("ppval", 4).alias("ppval"))


@query
def zscore(t: Inputs) -> DataFrame:
    obs, ctrl = t.controls()
    return pvalues.z_scores(obs, ctrl, "value", "ctrl", "grp").select("key", r("z").alias("z"), r("zpval").alias("zpval"))


@query
def studentised_pvalue(t: Inputs) -> DataFrame:
    obs, ctrl = t.controls()
    obs = obs.withColumn("value", pvalues.studentised(F.col("value"), (F.col("key") % 7).cast("double")))
    ctrl = ctrl.withColumn("ctrl", pvalues.studentised(F.col("ctrl"), (F.col("ctrl") % 5)))
    return pvalues.monte_carlo(obs, ctrl, "value", "ctrl", "key", "grp").select("key", r("mcpval", 9).alias("mcpval"))


@query
def empirical_fdr(t: Inputs) -> DataFrame:
    obs, ctrl = t.controls()
    return pvalues.empirical_fdr(obs, ctrl, "value", "ctrl", "key").select("key", r("q_value").alias("q_value"))


@query
def binned_empirical_fdr(t: Inputs) -> DataFrame:
    obs, ctrl = t.controls()
    return pvalues.empirical_fdr(obs, ctrl, "value", "ctrl", "key", "grp").select("key", r("q_value").alias("q_value"))


@query
def bh_fdr(t: Inputs) -> DataFrame:
    obs, ctrl = t.controls()
    return pvalues.benjamini_hochberg(pvalues.monte_carlo(obs, ctrl, "value", "ctrl", "key", "grp"), "mcpval", "key").select("key", r("bh_q").alias("bh_q"))


@query
def cauchy_combine(t: Inputs) -> DataFrame:
    p = t.table("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_discount") + 0.01).alias("ps"))
    return p.select("l_orderkey", r(cauchy_combined(F.col("ps"))).alias("p"))


@query
def contingency_log_or(t: Inputs) -> DataFrame:
    c = metrics.contingency(t.scores(), F.col("m1") <= 1500, F.col("label"), ["lang"])
    args = [F.col(x) for x in ("tp", "fp", "fn", "tn")]
    return c.select("lang", "tp", "fp", "fn", "tn", r(F.log(metrics.odds_ratio(*args, 0.5))).alias("log_or"))


@query
def fisher_exact_p(t: Inputs) -> DataFrame:
    c = metrics.contingency(t.scores(), F.col("m1") <= 1500, F.col("label"), ["lang"])
    return c.select("lang", r(metrics.fisher_p(*[F.col(x) for x in ("tp", "fp", "fn", "tn")])).alias("p"))


@query
def enrichment_recall(t: Inputs) -> DataFrame:
    c = metrics.enrichment_curve(t.scores(), "m1", "label", "doc_id")
    return c.select("doc_id", r("recall").alias("recall"), r("enrichment").alias("enrichment"))


@query
def auerc(t: Inputs) -> DataFrame:
    long = evaluation.long_form(t.scores(), ["m1", "m2"], ["doc_id", "label", "lang"])
    return metrics.auerc(long, "score", "label", "doc_id", within=["method", "lang"]).select("method", "lang", r("auerc").alias("auerc"))


@query
def topk_log_or(t: Inputs) -> DataFrame:
    return metrics.top_k_log_odds(t.scores(), "m1", "label", "doc_id").select("k", r("log_or").alias("log_or"))


@query
def auorc(t: Inputs) -> DataFrame:
    return metrics.auorc(t.scores(), "m1", "label", "doc_id", within=["lang"]).select("lang", r("auorc").alias("auorc"))


@query
def average_precision(t: Inputs) -> DataFrame:
    return metrics.average_precision(t.scores(), "m1", "label", ["lang"]).select("lang", r("ap").alias("ap"))


@query
def partial_ap(t: Inputs) -> DataFrame:
    return metrics.partial_average_precision(t.scores(), "m1", "label", 0.2).select(r("pap").alias("pap"))


def link_sets(t: Inputs) -> DataFrame:
    """Parts with suppliers as links; years of shipping as data sets; positive where enough was ordered."""
    line = t.table("lineitem")
    link = F.concat_ws(";", (F.col("l_partkey") % 200).cast("string"), (F.col("l_suppkey") % 20).cast("string"))
    return line.select(F.year("l_shipdate").cast("string").alias("dataset"), link.alias("link"), (F.col("l_quantity") > 40).alias("positive"))


@query
def dataset_agreement(t: Inputs) -> DataFrame:
    return agreement.pair_counts(link_sets(t), "dataset", "link", "positive")


@query
def dataset_odds_matrix(t: Inputs) -> DataFrame:
    found = agreement.odds_matrix(agreement.pair_counts(link_sets(t), "dataset", "link", "positive"))
    return found.select("a", "b", *[r(c).alias(c) for c in ("odds_ratio", "chi_squared", "p_value")])


@query
def formula_bootstrap(t: Inputs) -> DataFrame:
    """Prices of parts by size, brand class and their interaction; brands are the data sets that are drawn."""
    part = t.table("part").select("p_brand", (F.col("p_retailprice") / 100).alias("price"), (F.col("p_size") / 10.0).alias("size"), F.when(F.col("p_partkey") % 3 == 0, "late").otherwise("early").alias("kind"))
    found = meta.coefficient_summary(meta.bootstrap_formula(part, "price ~ size * kind", "p_brand", 200, seed=4))
    return found.select("term", *[r(c, 5).alias(c) for c in ("estimate", "bootstrap_sd", "ci_lower", "ci_upper", "p_value")])


@query
def tie_block_tops(t: Inputs) -> DataFrame:
    """Scores in tens, so that many are equal."""
    rows = t.scores().withColumn("tens", F.floor(F.col("m2") / 100).cast("double"))
    found = ties.expected_tops(rows, "tens", "label", [5, 20, 50, 100], ["lang"])
    return found.select("lang", "top", *[r(c).alias(c) for c in ("tp", "precision", "recall", "odds_ratio", "ci_lower", "ci_upper")])


@query
def tie_block_curve(t: Inputs) -> DataFrame:
    rows = t.scores().withColumn("tens", F.when(F.col("m2") < 900, F.floor(F.col("m2") / 100).cast("double")))
    return ties.curve(rows, "tens", "label", ["lang"], extrapolate=True).select("lang", r("recall").alias("recall"), r("enrichment").alias("enrichment"))


@query
def odds_by_regime(t: Inputs) -> DataFrame:
    rows = t.scores().withColumn("tens", F.floor(F.col("m2") / 50).cast("double"))
    found = ties.regime_odds(rows, "tens", "label", ["source"], 30)
    return found.select("source", "tp", "fp", "fn", "tn", r("smoothed").alias("smoothed"), r("ci_lower").alias("ci_lower"), r("ci_upper").alias("ci_upper"))


@query
def points_in_intervals(t: Inputs) -> DataFrame:
    """Orders of each day and status in the ninety days around an order of the same status."""
    days = t.table("orders").select("o_orderkey", "o_orderstatus", F.floor(F.unix_timestamp("o_orderdate") / 86400).alias("day"))
    spans = days.select("o_orderkey", F.col("o_orderstatus").alias("chrom"), (F.col("day") - 45).alias("start"), (F.col("day") + 45).alias("end"))
    return causal.counts_between(spans, days.select(F.col("o_orderstatus").alias("chrom"), F.col("day").alias("pos")), "o_orderkey")


@query
def causal_variant_enrichment(t: Inputs) -> DataFrame:
    """Customers stand for genes, their orders for variants, lines for causal variants in annotated places."""
    orders = t.table("orders").select("o_orderkey", F.col("o_custkey").alias("gene"), F.col("o_orderstatus").alias("chrom"), F.floor(F.unix_timestamp("o_orderdate") / 86400).alias("pos"))
    lines = t.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    found = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("gene").alias("eqtl_gene"), F.when(F.col("l_partkey") % 3 == 0, F.col("gene") + 1).otherwise(F.col("gene")).alias("annotated_gene"), F.col("l_discount").alias("probability"), F.col("l_tax").alias("p"))
    windows = orders.groupBy("gene").agg(F.min("chrom").alias("chrom"), F.min("pos").alias("start"), F.max("pos").alias("end"))
    reference = lines.filter(F.col("l_suppkey") % 5 > 0).select("gene", F.col("l_discount").alias("probability"))
    out = causal.causal_enrichment(found, found.filter("id % 7 = 0"), orders.filter(F.col("o_orderkey") % 4 > 0).select("gene"), reference, orders, windows, "p", 0.05)
    return out.select("gene", r("pip_annotated").alias("pip_annotated"), "n_annotated", r("pip_total").alias("pip_total"), "n_window", r("enrichment").alias("enrichment"))


@query
def permutation_null(t: Inputs) -> DataFrame:
    """The spread of permuted correlations by link, rounded to what a hash doesn't change."""
    found = nulls.permutation_null(t.pairs(), t.x(), t.y(), t.n_cells(), 50, seed=3)
    return found.groupBy("link_id").agg(F.count("*").alias("n"), r(F.avg("corr")).alias("mean"), r(F.stddev_samp("corr")).alias("deviation"))


@query
def chromatin_potential(t: Inputs) -> DataFrame:
    """Cells by their counts of supplier classes, against cells by their counts of as many classes of parts."""
    orders = t.table("orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    lines = t.table("lineitem").select("l_orderkey", (F.col("l_suppkey") % N_Y).alias("_s"), (F.col("l_partkey") % N_Y).alias("_p"))
    counted = lambda c: F.array(*[F.count_if(F.col(c) == k).cast("double") for k in range(N_Y)])
    # lines move once to their cell and are counted there, for both profiles
    held = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("id", "_s", "_p").repartition("id").groupBy("id").agg(counted("_s").alias("_o"), counted("_p").alias("_e"))
    profile = lambda c: F.coalesce(c, F.array(*[F.lit(0.0)] * N_Y))
    both = t.cells().select(F.col("cell_id").alias("id")).join(held, "id", "left").select("id", profile("_o").alias("observed"), profile("_e").alias("predicted"))
    both = stored(both, "profiles")
    found = neighbourhoods.chromatin_potential(both.select("id", F.col("observed").alias("v")), both.select("id", F.col("predicted").alias("v")), 3).rows
    return found.select(F.col("id").alias("cell_id"), "rank", r("distance").alias("distance"))


@query
def seed_averaged_bootstrap(t: Inputs) -> DataFrame:
    """Scores in hundreds, so that jitter decides among many ties."""
    rows = t.scores().withColumns({m: -F.floor(F.col(m) / 100) for m in ("m1", "m2")})
    found = evaluation.seed_averaged(rows, ["m1", "m2"], "label", "doc_id", "m1", 20, 4, 0.5, seed=17, least=None, specs=[evaluation.Metric("ap", lambda d, s, l, k, w, m=None: metrics.average_precision(d, s, l, w, m))])
    numbers = ("estimate", "seed_sd", "bootstrap_sd", "ci_lower", "ci_upper", "diff_estimate", "diff_ci_lower", "diff_ci_upper", "p_value")
    return found.select("method", "n_seeds", "n_bootstrap", *[r(c, 5).alias(c) for c in numbers])


def gc_of(t: Inputs) -> DataFrame:
    return t.peaks().select(F.col("peak_id").alias("feature_id"), (F.col("peak_id") * 37 % 101 / 101).alias("gc"))


@query
def mean_gc_bins(t: Inputs) -> DataFrame:
    """Bins by mean and GC content, and within them by whether a peak is at a gene's start."""
    bins = jobs.feature_bins(t.x(), t.n_cells(), 4, 2, "gc", gc_of(t))
    genes = t.genes().select(F.substring("g_chrom", 4, 10).alias("chrom"), F.col("g_start").alias("tss"))
    return jobs.with_promoter(bins, jobs.promoter_peaks(t.peaks(), genes, 700, 5000)).select("feature_id", "mean_bin", "bin")


@query
def whitened_gc_bins(t: Inputs) -> DataFrame:
    return jobs.whitened_gc_bins(t.x(), t.n_cells(), gc_of(t), 4, 2)


@query
def annotated_intervals(t: Inputs) -> DataFrame:
    """Purchases with the errors that they overlap, as a count and lists of what these say."""
    spans = t.spans()
    errors = spans.filter("event_type = 'error'").select("chrom", "start", "end", F.concat_ws(";", F.col("event_id").cast("string"), F.floor("value").cast("string")).alias("packed"))
    found = annotation.annotated(spans.filter("event_type = 'purchase'"), errors, "event_id", "packed", "err", 3600, ["value"])
    return found.select("event_id", "err_sum", F.array_join("err_hits", ",").alias("err_hits"), F.array_join("err_value", ",").alias("err_value"))


@query
def typed_overlaps(t: Inputs) -> DataFrame:
    spans = t.spans()
    found = annotation.typed_overlaps(spans.filter("event_type = 'purchase'"), spans.filter("event_type <> 'purchase'"), "event_id", "event_type", 3600, 0.3)
    return found.groupBy("event_id").agg(*[F.sum(f"is_{k}").alias(k) for k in ("click", "error", "signup", "view")])


@query
def odds_ratio_jackknife(t: Inputs) -> DataFrame:
    long = evaluation.long_form(t.scores(), ["m1", "m2"], ["doc_id", "label", "lang"])
    found = jackknife.odds_jackknife(long, "score", "label", "lang", "doc_id", [40, 80, 160], ["method"], epsilon=0.5)
    return found.select("method", "top", *[r(c).alias(c) for c in ("odds_ratio", "fisher_p", "ci_lower", "ci_upper", "jackknife_sd")], "n_blocks")


@query
def enrichment_area_jackknife(t: Inputs) -> DataFrame:
    """Word counts as the gold value, so that rows differ in it."""
    long = evaluation.long_form(t.scores(), ["m1", "m2"], ["doc_id", "label", "lang"]).withColumn("gold", F.col("label").cast("double") + F.col("doc_id") % 7 / 10)
    found = jackknife.area_jackknife(long, "score", "gold", "lang", "doc_id", [10, 20, 40, 70], ["method"])
    return found.select("method", *[r(c).alias(c) for c in ("area", "ci_lower", "ci_upper", "jackknife_sd")], "n_blocks")


@query
def bin_contributions(t: Inputs) -> DataFrame:
    rows = t.scores().withColumns({"gold": F.col("label").cast("double") + F.col("doc_id") % 7 / 10, "bin": (F.col("doc_id") % 3).cast("string")})
    found = jackknife.bin_contributions(rows, "m1", "gold", "lang", "bin", "doc_id", [10, 20, 40, 70])
    return found.select("bin", r("contribution").alias("contribution"), r("se").alias("se"))


@query
def bootstrap_metric_ci(t: Inputs) -> DataFrame:
    reps = metrics.replicates(t.scores(), 50, "doc_id", seed=17)
    est = metrics.average_precision(reps, "m1", "label", ["rep"], weight="weight")
    s = metrics.bootstrap_summary(est, "ap", [])
    return s.select(r("estimate").alias("estimate"), r("bootstrap_sd", 5).alias("bootstrap_sd"), r("ci_lower", 5).alias("ci_lower"), r("ci_upper", 5).alias("ci_upper"), "n_bootstrap")


@query
def bootstrap_paired_difference(t: Inputs) -> DataFrame:
    long = evaluation.long_form(t.scores(), ["m1", "m2"], ["doc_id", "label"])
    est = metrics.average_precision(metrics.replicates(long, 50, "doc_id", seed=17), "score", "label", ["method", "rep"], weight="weight")
    d = metrics.paired_difference(est, "ap", "method", "m2")
    return d.select("method", *[r(c, 5).alias(c) for c in ("diff_estimate", "diff_ci_lower", "diff_ci_upper", "p_value")])


@query
def stratified_bootstrap_evaluation(t: Inputs) -> DataFrame:
    return evaluation.bootstrap(t.scores(), ["m1", "m2"], "label", "doc_id", 20, stratum=F.col("lang"), seed=5)


@query
def entropy_specificity(t: Inputs) -> DataFrame:
    m = matrix.group_moments(t.x(), t.cells(), "celltype").select("feature_id", "celltype", "mean")
    s = specificity.by_group(m, "feature_id", "celltype", "mean", 5)
    return s.select("feature_id", r("specificity").alias("specificity"), "dominant")


@query
def joint_specificity(t: Inputs) -> DataFrame:
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    a = matrix.group_means_wide(t.x(), t.cells(), "celltype", names).select(F.col("feature_id").alias("x_id"), F.array(*names).alias("a"))
    b = matrix.group_means_wide(t.y(), t.cells(), "celltype", names).select(F.col("feature_id").alias("y_id"), F.array(*names).alias("b"))
    got = t.pairs().join(a, "x_id").join(b, "y_id")
    return got.select("link_id", r(specificity.joint_specificity(F.col("a"), F.col("b"))).alias("specificity"))


@query
def pip_specificity(t: Inputs) -> DataFrame:
    p = t.table("lineitem").groupBy("l_suppkey").agg(*[F.count_if(F.col("l_returnflag") == k).cast("double").alias(k.lower()) for k in "ANR"])
    return p.select("l_suppkey", r(specificity.probability_specificity(F.array("a", "n", "r"))).alias("specificity"))


@query
def link_specificity(t: Inputs) -> DataFrame:
    spec = lambda m: specificity.by_group(matrix.group_moments(m, t.cells(), "celltype").select("feature_id", "celltype", "mean"), "feature_id", "celltype", "mean", 5)
    links = intervals.window_links(t.peaks(), t.genes(), 3000, 5000).select("peak_id", "gene_id")
    got = specificity.attach_pairs(links, spec(t.x()), spec(t.y()))
    return got.select("peak_id", "gene_id", r("min_specificity").alias("min_specificity"), r("mean_specificity").alias("mean_specificity"), "concordant")


def _effects(t: Inputs) -> DataFrame:
    got = t.table("orders").join(t.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return got.groupBy("c_nationkey", "c_mktsegment").agg(F.avg(F.col("o_totalprice") / 1000).alias("effect"), (F.stddev_samp(F.col("o_totalprice") / 1000) / F.sqrt(F.count("*").cast("double"))).alias("err"))


@query
def meta_fixed(t: Inputs) -> DataFrame:
    m = meta.combined(_effects(t), "effect", "err", ["c_mktsegment"], random=False)
    return m.select("c_mktsegment", r("estimate", 4).alias("estimate"), r("se", 4).alias("se"), r("q", 3).alias("q"))


@query
def meta_random(t: Inputs) -> DataFrame:
    m = meta.combined(_effects(t), "effect", "err", ["c_mktsegment"])
    return m.select("c_mktsegment", r("estimate", 4).alias("estimate"), r("se", 4).alias("se"), r("tau2", 4).alias("tau2"))


@query
def regression_slopes(t: Inputs) -> DataFrame:
    s = meta.slope(t.table("lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return s.select("l_returnflag", r("intercept", 3).alias("intercept"), r("slope", 4).alias("slope"))


def _knn(t: Inputs, k: int) -> DataFrame:
    return neighbourhoods.nearest(t.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), k)


@query
def knn_cosine(t: Inputs) -> DataFrame:
    return _knn(t, 5).select(F.col("id").alias("vec_id"), "rank", "neighbour", r("distance").alias("distance"))


@query
def knn_smooth(t: Inputs) -> DataFrame:
    values = t.table("embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("value"))
    return neighbourhoods.smoothed(values, _knn(t, 5)).select(F.col("id").alias("vec_id"), r("smooth").alias("smooth"))


@query
def gearys_c(t: Inputs) -> DataFrame:
    edges = _knn(t, 5).select(F.col("id").alias("i"), F.col("neighbour").alias("j"), F.lit(1.0).alias("w"))
    values = t.table("embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("x"), F.col("embedding")[0].cast("double").alias("y"))
    auto = neighbourhoods.gearys_c(edges, values, "x").select(F.lit("auto").alias("kind"), r("gearys_c").alias("c"))
    return auto.unionByName(neighbourhoods.gearys_c(edges, values, "x", "y").select(F.lit("cross").alias("kind"), r("gearys_c").alias("c")))


@query
def embedding_arrows(t: Inputs) -> DataFrame:
    e = t.table("embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    return neighbourhoods.arrows(e, _knn(t, 5)).select(F.col("id").alias("vec_id"), r(F.aggregate("arrow", F.lit(0.0), lambda s, v: s + v * v), 5).alias("squared_length"))


@query
def residual_pearson_alpha(t: Inputs) -> DataFrame:
    res = residuals.depth_residuals(t.y(), t.cells())
    return res.groupBy("feature_id").agg(r(F.max("alpha")).alias("alpha"), r(F.sum(F.col("residual") * F.col("residual")), 3).alias("squares"), F.count("*").alias("n"))


def with_depth(t: Inputs, counts: DataFrame) -> DataFrame:
    """cell_id, offset (the log of a cell's counts), batch (three of them)."""
    depth = counts.groupBy("cell_id").agg(F.sum("value").alias("_d"))
    return t.cells().join(depth, "cell_id", "left").select("cell_id", F.log(F.greatest(F.coalesce("_d", F.lit(0.0)), F.lit(1.0))).alias("offset"), (F.col("batch") % 3).alias("batch"))


@query
def nb_residuals(t: Inputs) -> DataFrame:
    _, y = t.classes()
    found = residuals.count_residuals(y, with_depth(t, y), whole=True)
    return found.select("cell_id", "feature_id", r("mu", 4).alias("mu"), r("alpha", 5).alias("alpha"), r("residual", 4).alias("residual"))


@query
def nb_residuals_standardised(t: Inputs) -> DataFrame:
    """Alphas of features with few counts drawn to the median, quantile residuals standardised; one row a feature."""
    _, y = t.classes()
    found = residuals.count_residuals(y, with_depth(t, y), kind="quantile", shrink=True, standardise=True, seed=9)
    return found.groupBy("feature_id").agg(F.count("*").alias("cells"), r(F.min("residual"), 4).alias("least"), r(F.max("residual"), 4).alias("most"), r(F.avg("residual"), 6).alias("mean"), r(F.stddev_samp("residual"), 6).alias("deviation"))


@query
def poisson_multi_irls(t: Inputs) -> DataFrame:
    cov = t.cells().select("cell_id", F.array((F.col("balance") / 10000).cast("double"), (F.col("batch") % 2).cast("double")).alias("c"))
    return residuals.poisson_multi(t.pairs(), *t.classes(), cov).select("link_id", r("beta", 5).alias("beta"), r("se", 5).alias("se"))


@query
def negative_binomial_pairs(t: Inputs) -> DataFrame:
    found = pairs.negative_binomial_fit(pairs.joint_histograms(t.pairs(), *t.classes(), t.n_cells()))
    return found.select("link_id", r("b0", 5).alias("b0"), r("b1", 5).alias("b1"), r("alpha", 5).alias("alpha"), r("se", 5).alias("se"))


@query
def chunk_gap_check(t: Inputs) -> DataFrame:
    c = t.table("orders").groupBy((F.col("o_orderkey") / 500).cast("long").alias("c")).agg(F.min("o_orderkey").alias("start"), (F.max("o_orderkey") + F.when(F.col("c") % 7 == 3, 0).otherwise(1)).alias("end"))
    return readers.gaps(c.select("start", "end"))


@query
def consolidated_chunks(t: Inputs) -> DataFrame:
    return readers.consolidated(t.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], "l_partkey").select("l_orderkey", "l_partkey")


@query
def canonical_peak(t: Inputs) -> DataFrame:
    p = t.table("part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, " CHR").otherwise(""), F.when(F.col("p_size") > 22, "x").otherwise(F.col("p_size").cast("string")), F.when(F.col("p_partkey") % 3 == 0, ":").otherwise("-"), F.col("p_partkey").cast("string"), F.lit("-"), (F.col("p_partkey") + 500).cast("string")).alias("name"))
    return p.select("p_partkey", strings.canonical_peak(F.col("name")).alias("peak"))


@query
def strip_version(t: Inputs) -> DataFrame:
    return t.table("part").select("p_partkey", strings.without_version(F.concat(F.lit("ENSG"), F.col("p_partkey").cast("string"), F.lit("."), F.col("p_size").cast("string"))).alias("gene"))


@query
def coord_parse(t: Inputs) -> DataFrame:
    n = F.concat(F.lit("chr"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ":").otherwise("_"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("-"), (F.col("p_partkey") + 9).cast("string"))))
    got = t.table("part").select("p_partkey", strings.place(n).alias("p"))
    return got.select("p_partkey", "p.chrom", "p.start", "p.end")


@query
def chromosome_names(t: Inputs) -> DataFrame:
    c = F.when(F.col("p_size") > 45, "MT").when(F.col("p_size") > 40, "x").when(F.col("p_size") > 35, "GL000").otherwise(F.col("p_size").cast("string"))
    return t.table("part").groupBy(strings.normal_chromosome(c).alias("chrom")).agg(F.count("*").alias("n"))


@query
def link_id_parts(t: Inputs) -> DataFrame:
    links = t.table("lineitem").select(strings.link_id(F.col("l_partkey").cast("string"), F.concat_ws(";", F.col("l_suppkey").cast("string"), "l_returnflag")).alias("id")).distinct()
    peak, gene = strings.link_parts(F.col("id"))
    return links.select("id", peak.alias("peak"), gene.alias("gene"))


def study_columns(found: DataFrame) -> DataFrame:
    return found.select("link_id", "x_id", "y_id", "grp", "ctrl_short", *[r(c, 5).alias(c) for c in ("beta", "se", "stud", "mcpval_z", "ppval_z", "zpval_z", "mcpval", "ppval", "zpval", "q_value", "bh_q")])


@query
def association_study(t: Inputs) -> DataFrame:
    return study_columns(jobs.associate(t.x(), t.y(), t.peaks(), t.genes(), t.n_cells(), "3.2.3.2.20", 3000, 5000))


@query
def one_sided_association(t: Inputs) -> DataFrame:
    return study_columns(jobs.associate(t.x(), t.y(), t.peaks(), t.genes(), t.n_cells(), "3.1.inf.inf.5", 3000, 5000, method="pearson"))


@query
def association_by_celltype(t: Inputs) -> DataFrame:
    links = jobs.generate_links(t.peaks(), t.genes(), 1000, 5000)
    return jobs.by_group(t.x(), t.y(), t.cells(), "celltype", links).select("link_id", "x_id", "y_id", "celltype", r("beta", 5).alias("beta"), r("se", 5).alias("se"))
