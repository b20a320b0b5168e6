"""DuckDB SQL of blocks of ties, counts in intervals and causal enrichment."""

from __future__ import annotations

from .oracles import SCORES, SPANS, ap, base, draw, reps

Z = 1.959963984540054


def _wald(tp: str, fp: str, fn: str, tn: str) -> str:
    a, b, c, d = (f"({x} + 0.5)" for x in (tp, fp, fn, tn))
    odds, half = f"({a} * {d} / ({b} * {c}))", f"{Z} * sqrt(1 / {a} + 1 / {b} + 1 / {c} + 1 / {d})"
    return f"round({odds}, 6) AS {{odds}}, round({odds} * exp(-{half}), 6) AS ci_lower, round({odds} * exp({half}), 6) AS ci_upper"


def _blocks(score: str, by: str) -> str:
    return f"""WITH {SCORES}, rw AS (SELECT *, {score} AS s FROM sc), tt AS (SELECT {by}, count(*) AS total, count(*) FILTER (label) AS total_g, count(s) AS scored, count(*) FILTER (label AND s IS NOT NULL) AS scored_g FROM rw GROUP BY 1),
bl AS (SELECT {by}, s, count(*) AS n, count(*) FILTER (label) AS g FROM rw WHERE s IS NOT NULL GROUP BY ALL), up AS (SELECT *, sum(n) OVER w AS un, sum(g) OVER w AS ug FROM bl WINDOW w AS (PARTITION BY {by} ORDER BY s)), bk AS (SELECT * FROM up JOIN tt USING ({by}))"""


def tops_sql(tops: list[int]) -> str:
    tail = _wald("tp", "(top - tp)", "(scored_g - tp)", "(scored - top - (scored_g - tp))").format(odds="odds_ratio")
    return _blocks("floor(m2 / 100)", "lang") + f""", c AS (SELECT *, ug - g + (top - (un - n)) * g / n AS tp FROM bk, (SELECT unnest({tops})::BIGINT AS top) WHERE top > un - n AND top <= un)
SELECT lang, top, round(tp, 6) AS tp, round(tp / top, 6) AS precision, round(tp / scored_g, 6) AS recall, {tail} FROM c"""


def curve_sql() -> str:
    return _blocks("CASE WHEN m2 < 900 THEN floor(m2 / 100) END", "lang") + """, p AS (SELECT lang, ug / total_g AS r, ug / un / (total_g / total) AS e, un AS place, un = scored AS fin, total_g - scored_g AS k, total FROM bk WHERE total_g > 0),
q AS (SELECT lang, r, e, place FROM p UNION ALL SELECT lang, r + (1 - r) * i / k, e - (e - 1) * i / k, total + i FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM p WHERE fin AND k > 0 AND r < 1))
SELECT lang, round(r, 6) AS recall, round(arg_min(e, place), 6) AS enrichment FROM q GROUP BY lang, r"""


def regime_sql() -> str:
    tail = _wald("tp", "fp", "fn", "tn").format(odds="smoothed")
    return _blocks("floor(m2 / 50)", "source") + f""", s AS (SELECT source, coalesce(sum(g) FILTER (un - n + (n + 1) / 2 <= least(30, total)), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (un - n + (n + 1) / 2 <= least(30, total)), 0)::BIGINT AS k, any_value(total_g) AS tg, any_value(total) AS total FROM bk GROUP BY 1),
c AS (SELECT source, tp, k - tp AS fp, tg - tp AS fn, total - k - (tg - tp) AS tn FROM s) SELECT source, tp, fp, fn, tn, {tail} FROM c"""


DAY = "CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT)"


def seed_sql(n: int, seeds: int, amount: float, seed: int) -> str:
    noise = f"(({draw('doc_id', 'seed', 0)} + 0.5) / 2147483647 * 2 - 1) * {amount}"
    return f"""WITH {SCORES}, sx AS (SELECT doc_id, label, -floor(m1 / 100) AS m1, -floor(m2 / 100) AS m2 FROM sc), {reps("sx", n, seed)},
sd AS (SELECT rp.*, seed, {noise} AS e FROM rp, (SELECT unnest(range(0, {seeds})) AS seed)),
lg AS (SELECT label, rep, weight, seed, 'm1' AS method, m1 + e AS score FROM sd UNION ALL SELECT label, rep, weight, seed, 'm2', m2 + e FROM sd),
{ap("lg", "score", "method, rep, seed", "weight")},
me AS (SELECT method, rep, avg(ap) AS v, stddev_samp(ap) AS sd FROM apt GROUP BY ALL), df AS (SELECT me.*, r.v - me.v AS d FROM me JOIN me r ON r.method = 'm1' AND r.rep = me.rep),
q AS (SELECT method, max(v) FILTER (rep = 0) AS estimate, max(sd) FILTER (rep = 0) AS seed_sd, stddev_samp(v) FILTER (rep > 0) AS bootstrap_sd, quantile_cont(v, 0.025) FILTER (rep > 0) AS ci_lower, quantile_cont(v, 0.975) FILTER (rep > 0) AS ci_upper, count(v) FILTER (rep > 0) AS n_bootstrap,
 max(d) FILTER (rep = 0) AS diff_estimate, quantile_cont(d, 0.025) FILTER (rep > 0) AS diff_ci_lower, quantile_cont(d, 0.975) FILTER (rep > 0) AS diff_ci_upper, least(1.0, 2 * least(avg(CAST(d <= 0 AS INTEGER)) FILTER (rep > 0), avg(CAST(d >= 0 AS INTEGER)) FILTER (rep > 0))) AS p_value FROM df GROUP BY 1)
SELECT method, CAST({seeds} AS INTEGER) AS n_seeds, n_bootstrap, {", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in ("estimate", "seed_sd", "bootstrap_sd", "ci_lower", "ci_upper", "diff_estimate", "diff_ci_lower", "diff_ci_upper", "p_value"))} FROM q"""


BLOCKS_SQL: dict[str, str] = {
    "annotated_intervals": f"WITH {SPANS}, j AS (SELECT a.event_id, CAST(b.event_id AS VARCHAR) AS h, CAST(CAST(floor(b.value) AS BIGINT) AS VARCHAR) AS v FROM spans a JOIN spans b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e AND a.event_type = 'purchase' AND b.event_type = 'error') SELECT a.event_id, count(h) AS err_sum, coalesce(string_agg(h, ',' ORDER BY h, v), '') AS err_hits, coalesce(string_agg(v, ',' ORDER BY h, v), '') AS err_value FROM spans a LEFT JOIN j USING (event_id) WHERE event_type = 'purchase' GROUP BY 1",
    "typed_overlaps": f"WITH {SPANS} SELECT a.event_id, " + ", ".join(f"count(*) FILTER (b.event_type = '{k}') AS {k}" for k in ("click", "error", "signup", "view")) + " FROM spans a JOIN spans b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e AND a.event_type = 'purchase' AND b.event_type <> 'purchase' WHERE least(a.e, b.e) - greatest(a.s, b.s) >= 0.3 * (a.e - a.s) GROUP BY 1",
    "seed_averaged_bootstrap": seed_sql(20, 4, 0.5, 17),
    "tie_block_tops": tops_sql([5, 20, 50, 100]),
    "tie_block_curve": curve_sql(),
    "odds_by_regime": regime_sql(),
    "points_in_intervals": f"WITH d AS (SELECT o_orderstatus AS c, {DAY} AS d, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT x.c, x.d, sum(y.n) AS n FROM d x JOIN d y ON x.c = y.c AND y.d BETWEEN x.d - 45 AND x.d + 45 GROUP BY ALL) SELECT o_orderkey, CAST(n AS BIGINT) AS n_points FROM orders JOIN s ON c = o_orderstatus AND d = {DAY}",
    "causal_variant_enrichment": f"""WITH o AS (SELECT o_orderkey, o_custkey AS gene, o_orderstatus AS chrom, {DAY} AS pos FROM orders),
l AS (SELECT l_orderkey * 10 + l_linenumber AS id, gene, CASE WHEN l_partkey % 3 = 0 THEN gene + 1 ELSE gene END AS ann, l_discount AS prob, l_tax AS p, l_suppkey FROM lineitem JOIN o ON l_orderkey = o_orderkey),
g AS (SELECT DISTINCT gene FROM o WHERE o_orderkey % 4 > 0 AND gene IN (SELECT gene FROM l WHERE l_suppkey % 5 > 0)),
w AS (SELECT gene, min(chrom) AS chrom, min(pos) AS s, max(pos) AS e FROM o GROUP BY 1), v AS (SELECT chrom, pos, count(*) AS n FROM o GROUP BY ALL),
n AS (SELECT gene, CAST(coalesce(sum(v.n), 0) AS BIGINT) AS n_window FROM w LEFT JOIN v ON w.chrom = v.chrom AND v.pos BETWEEN s AND e GROUP BY 1),
a AS (SELECT gene, sum(prob) AS pip FROM l WHERE p < 0.05 AND ann = gene GROUP BY 1), c AS (SELECT ann AS gene, count(*) AS k FROM l WHERE id % 7 = 0 GROUP BY 1), t AS (SELECT gene, sum(prob) AS total FROM l WHERE l_suppkey % 5 > 0 GROUP BY 1),
j AS (SELECT gene, coalesce(pip, 0) AS pip, coalesce(k, 0) AS k, coalesce(total, 0) AS total, n_window FROM g LEFT JOIN a USING (gene) LEFT JOIN c USING (gene) LEFT JOIN t USING (gene) LEFT JOIN n USING (gene))
SELECT CAST(gene AS VARCHAR) AS gene, round(pip, 6) AS pip_annotated, k AS n_annotated, round(total, 6) AS pip_total, n_window, round(CASE WHEN total = 0 OR k = 0 THEN 0 WHEN n_window > 0 THEN (pip / k) / (total / n_window) END, 6) AS enrichment FROM j""",
    # cells without a direction are 1 away from all others
    "chromatin_potential": base() + """, xp AS (SELECT cell_id, l_partkey % 20 AS feature_id, CAST(count(*) AS DOUBLE) AS value FROM lo GROUP BY ALL), f AS (SELECT unnest(range(0, 20)) AS feature_id),
yo AS (SELECT cell_id, feature_id, coalesce(value, 0) AS v FROM cells CROSS JOIN f LEFT JOIN y USING (cell_id, feature_id)), yp AS (SELECT cell_id, feature_id, coalesce(value, 0) AS v FROM cells CROSS JOIN f LEFT JOIN xp USING (cell_id, feature_id)),
so AS (SELECT cell_id, feature_id, CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0 END AS v FROM yo WINDOW w AS (PARTITION BY feature_id)),
sp AS (SELECT cell_id, feature_id, CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0 END AS v FROM yp WINDOW w AS (PARTITION BY feature_id)),
co AS (SELECT cell_id, list(v - m ORDER BY feature_id) AS l FROM (SELECT *, avg(v) OVER (PARTITION BY cell_id) AS m FROM so) GROUP BY 1), cp AS (SELECT cell_id, list(v - m ORDER BY feature_id) AS l FROM (SELECT *, avg(v) OVER (PARTITION BY cell_id) AS m FROM sp) GROUP BY 1),
d AS (SELECT a.cell_id, round(1 - list_dot_product(a.l, b.l) / greatest(sqrt(list_dot_product(a.l, a.l)) * sqrt(list_dot_product(b.l, b.l)), 1e-300), 12) AS d, b.cell_id AS o FROM co a, cp b),
k AS (SELECT cell_id, d, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY d, o) AS INTEGER) AS rank FROM d) SELECT cell_id, rank, round(d, 6) AS distance FROM k WHERE rank <= 3""",
}
