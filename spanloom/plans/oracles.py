"""DuckDB SQL with the same meaning as the registered queries."""

from __future__ import annotations

BASE = """lo AS (SELECT o_custkey AS cell_id, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
x AS (SELECT cell_id, l_partkey % 40 AS feature_id, CAST(count(*) AS DOUBLE) AS value FROM lo GROUP BY ALL),
y AS (SELECT cell_id, l_suppkey % 20 AS feature_id, CAST(count(*) AS DOUBLE) AS value FROM lo GROUP BY ALL),
cells AS (SELECT c_custkey AS cell_id, c_mktsegment AS celltype, c_nationkey AS batch, c_acctbal AS balance FROM customer),
nc AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM customer),
peaks AS (SELECT DISTINCT l_partkey % 40 AS peak_id FROM lineitem),
genes AS (SELECT DISTINCT l_suppkey % 20 AS gene_id FROM lineitem),
wl AS (SELECT peak_id, gene_id, least(peak_id * 1000 + 300, gene_id * 2000 + 1500 + {d}) - greatest(peak_id * 1000, greatest(gene_id * 2000 - {d}, 0)) AS overlap
  FROM peaks, genes WHERE peak_id % 5 = gene_id % 5 AND peak_id * 1000 < gene_id * 2000 + 1500 + {d} AND greatest(gene_id * 2000 - {d}, 0) < peak_id * 1000 + 300),
prs AS (SELECT peak_id AS link_id, peak_id AS x_id, peak_id % 20 AS y_id FROM peaks WHERE peak_id % 20 IN (SELECT gene_id FROM genes))"""

SUMS = """, xs AS (SELECT feature_id AS x_id, sum(value) AS sx, sum(value * value) AS sxx FROM {x} GROUP BY 1),
ys AS (SELECT feature_id AS y_id, sum(value) AS sy, sum(value * value) AS syy FROM {y} GROUP BY 1),
xy AS (SELECT x.feature_id AS x_id, y.feature_id AS y_id, sum(x.value * y.value) AS sxy FROM {x} x JOIN {y} y USING (cell_id) GROUP BY ALL)"""


def base(d: int = 3000) -> str:
    return "WITH RECURSIVE " + BASE.format(d=d)


def by_part() -> str:
    """The inputs with a feature for each part, five links a part, and the supplier classes as before."""
    whole = BASE[: BASE.index("prs AS")].replace("l_partkey % 40 AS feature_id", "l_partkey AS feature_id", 1).format(d=3000)
    return "WITH RECURSIVE " + whole + "prs AS (SELECT x_id * 5 + k AS link_id, x_id, (x_id + k * 4) % 20 AS y_id FROM (SELECT DISTINCT l_partkey AS x_id FROM lineitem), (SELECT unnest(range(0, 5)) AS k))"


SPANS = """spans AS (SELECT event_id, user_id AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + 60 + CAST(floor(value * 20) AS BIGINT) AS e, event_type, value FROM events)"""
SCORES = """sc AS (SELECT doc_id, quality = 1 AS label, CAST(n_chars AS DOUBLE) AS m1, CAST(doc_id * 7919 % 1009 AS DOUBLE) AS m2, lang, source FROM documents JOIN labels USING (doc_id))"""
CONTROLS = """obs AS (SELECT p_partkey AS key, p_brand AS grp, p_retailprice % 97 AS value FROM part),
ctrl AS (SELECT p_brand AS grp, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 101 AS DOUBLE) AS ctrl FROM lineitem JOIN part ON l_partkey = p_partkey)"""
#: Bin of a rank (rk of n) in q quantiles.
QCUT = """greatest(len(list_filter(list_transform(range(0, {q} + 1), lambda k: CASE WHEN ((n - 1) * (((CASE WHEN k = {q} THEN 1.0::DOUBLE ELSE k * (1.0::DOUBLE / {q}) END) * 100) / 100)) - floor((n - 1) * (((CASE WHEN k = {q} THEN 1.0::DOUBLE ELSE k * (1.0::DOUBLE / {q}) END) * 100) / 100)) >= 0.5
 THEN least(floor((n - 1) * (((CASE WHEN k = {q} THEN 1.0::DOUBLE ELSE k * (1.0::DOUBLE / {q}) END) * 100) / 100)) + 2, n) - (least(floor((n - 1) * (((CASE WHEN k = {q} THEN 1.0::DOUBLE ELSE k * (1.0::DOUBLE / {q}) END) * 100) / 100)) + 2, n) - (floor((n - 1) * (((CASE WHEN k = {q} THEN 1.0::DOUBLE ELSE k * (1.0::DOUBLE / {q}) END) * 100) / 100)) + 1)) * (1 - ((n - 1) * (((CASE WHEN k = {q} THEN 1.0::DOUBLE ELSE k * (1.0::DOUBLE / {q}) END) * 100) / 100) - floor((n - 1) * (((CASE WHEN k = {q} THEN 1.0::DOUBLE ELSE k * (1.0::DOUBLE / {q}) END) * 100) / 100))))
 ELSE floor((n - 1) * (((CASE WHEN k = {q} THEN 1.0::DOUBLE ELSE k * (1.0::DOUBLE / {q}) END) * 100) / 100)) + 1 + (least(floor((n - 1) * (((CASE WHEN k = {q} THEN 1.0::DOUBLE ELSE k * (1.0::DOUBLE / {q}) END) * 100) / 100)) + 2, n) - (floor((n - 1) * (((CASE WHEN k = {q} THEN 1.0::DOUBLE ELSE k * (1.0::DOUBLE / {q}) END) * 100) / 100)) + 1)) * ((n - 1) * (((CASE WHEN k = {q} THEN 1.0::DOUBLE ELSE k * (1.0::DOUBLE / {q}) END) * 100) / 100) - floor((n - 1) * (((CASE WHEN k = {q} THEN 1.0::DOUBLE ELSE k * (1.0::DOUBLE / {q}) END) * 100) / 100))) END), lambda e: e < rk)) - 1, 0)"""


def fr(name: str) -> str:
    """Average percentile rank of a column."""
    return f"CASE WHEN {name} IS NOT NULL THEN (rank() OVER (PARTITION BY {name} IS NULL ORDER BY {name}) + (count(*) OVER (PARTITION BY {name}) - 1) / 2) / count(*) OVER (PARTITION BY {name} IS NULL) END"


def mc(group: bool, digits: int = 9) -> str:
    g = "c.grp = o.grp AND " if group else ""
    n = "c.grp = o.grp" if group else "true"
    return f"SELECT key, round((1 + (SELECT count(*) FROM ctrl c WHERE {g}c.ctrl >= o.value)) / (1.0 + (SELECT count(*) FROM ctrl c WHERE {n})), {digits}) AS mcpval FROM obs o"


CURVE = """w AS (SELECT *, {s} IS NOT NULL AS scored, count(*) OVER o AS k, count({s}) OVER o AS linked, count(*) FILTER (label) OVER o AS gold, count(*) OVER p AS n, count(*) FILTER (label) OVER p AS g FROM {t} WINDOW o AS ({p} ORDER BY {s} NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING), p AS ({p})),
c AS (SELECT *, gold / g AS recall, (gold / linked) / (g / n) AS enrichment FROM w WHERE scored)"""
LONG = "lg AS (SELECT doc_id, label, lang, 'm1' AS method, m1 AS score FROM sc UNION ALL SELECT doc_id, label, lang, 'm2', m2 FROM sc)"


def draw(a: str, b: str, seed: int) -> str:
    """The integer hash of :func:`spanloom.functions.special.draw`."""
    p = 2147483647
    a, b = f"(CAST({a} AS BIGINT) % {p})", f"(CAST({b} AS BIGINT) % {p})"
    h = f"(({a} * 48271 + {b} * 69621 + {seed % p * 16807 + 1}) % {p})"
    for factor, other in ((39373, a), (40692, b), (62089, a), (25214, b)):
        h = f"(({h} * {h} + {other} * {factor} + 12345) % {p})"
    return h


def multiplicity(key: str, rep: str, seed: int) -> str:
    import math

    p, total, out = math.exp(-1), 0.0, []
    for k in range(8):
        total += p
        p /= k + 1
        out.append(f"WHEN u < {int(total * 2147483647)} THEN {k}")
    return f"(SELECT CASE {' '.join(out)} ELSE 8 END FROM (SELECT {draw(key, rep, seed)} AS u))"


def reps(table: str, n: int, seed: int) -> str:
    return f"rp AS (SELECT * FROM (SELECT t.*, r.rep, CASE WHEN r.rep = 0 THEN 1 ELSE {multiplicity('t.doc_id', 'r.rep', seed)} END AS weight FROM {table} t, (SELECT unnest(range(0, {n} + 1)) AS rep) r) WHERE weight > 0)"


def ap(table: str, score: str, within: str, weight: str = "1") -> str:
    by = within + ", " if within else ""
    part = f"PARTITION BY {within} " if within else ""
    return f"""lv AS (SELECT {by}{score} AS s, sum({weight}) AS c, sum(CASE WHEN label THEN {weight} ELSE 0 END) AS p FROM {table} GROUP BY ALL),
cu AS (SELECT {by}s, p, sum(c) OVER o AS n, sum(p) OVER o AS tp, sum(p) OVER ({part}) AS g FROM lv WINDOW o AS ({part}ORDER BY s DESC RANGE UNBOUNDED PRECEDING)),
pr AS (SELECT {by}s, tp / n AS pre, tp / g AS rec, p / g AS gain FROM cu),
apt AS (SELECT {by}sum(gain * pre) AS ap FROM pr {'GROUP BY ALL' if within else ''})"""


def spec(m: str, name: str) -> str:
    return f"""{name}m AS (SELECT feature_id, celltype, greatest(sum(value) / any_value(k.n), 1e-6) AS mean FROM {m} JOIN cells USING (cell_id) JOIN (SELECT celltype, count(*) AS n FROM cells GROUP BY 1) k USING (celltype) GROUP BY ALL),
{name}f AS (SELECT f.feature_id, g.celltype, coalesce(mean, 0) + 1e-6 AS v FROM (SELECT DISTINCT feature_id FROM {name}m) f CROSS JOIN (SELECT DISTINCT celltype FROM cells) g LEFT JOIN {name}m USING (feature_id, celltype)),
{name} AS (SELECT feature_id, 1 + sum(v / t * ln(v / t)) / ln(5) AS specificity, min(celltype) FILTER (v = mx) AS dominant FROM (SELECT *, sum(v) OVER (PARTITION BY feature_id) AS t, max(v) OVER (PARTITION BY feature_id) AS mx FROM {name}f) GROUP BY 1)"""


def fdr(group: bool) -> str:
    g = "grp" if group else "0"
    return f"""o AS (SELECT key, {g} AS grp, value FROM obs), k AS (SELECT {g} AS grp, ctrl FROM ctrl),
t AS (SELECT grp, value, count(*) AS c FROM o GROUP BY ALL),
r AS (SELECT t.grp, value, least(1.0, ((SELECT count(*) FROM k WHERE k.grp = t.grp AND ctrl >= value) / (SELECT count(*) FROM k WHERE k.grp = t.grp)) / ((sum(c) OVER (PARTITION BY t.grp ORDER BY value DESC)) / (sum(c) OVER (PARTITION BY t.grp)))) AS q FROM t),
m AS (SELECT grp, value, min(q) OVER (PARTITION BY grp ORDER BY value) AS q FROM r)
SELECT key, round(q, 6) AS q_value FROM o LEFT JOIN m USING (grp, value)"""


KNN = """kn AS (SELECT a.vec_id, b.vec_id AS neighbour, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
nn AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS INTEGER) AS rank FROM kn QUALIFY rank <= 5)"""
IRLS = """h AS (SELECT p.link_id, coalesce(a.value, 0) AS xv, CAST(count(*) AS DOUBLE) AS n, sum(coalesce(b.value, 0)) AS yv FROM prs p CROSS JOIN cells c LEFT JOIN x a ON a.cell_id = c.cell_id AND a.feature_id = p.x_id LEFT JOIN y b ON b.cell_id = c.cell_id AND b.feature_id = p.y_id GROUP BY ALL),
hh AS (SELECT link_id, list({{'x': xv, 'n': n, 'y': yv}}) AS l FROM h GROUP BY 1),
it AS (SELECT link_id, l, 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM hh
 UNION ALL
 SELECT link_id, l, i + 1, (wxx * wz - wx * wxz) / (w * wxx - wx * wx), (w * wxz - wx * wz) / (w * wxx - wx * wx) FROM (
  SELECT link_id, l, i, list_sum(list_transform(l, lambda b: b.n * exp(b0 + b1 * b.x))) AS w, list_sum(list_transform(l, lambda b: b.x * b.n * exp(b0 + b1 * b.x))) AS wx,
   list_sum(list_transform(l, lambda b: b.x * b.x * b.n * exp(b0 + b1 * b.x))) + {ridge} AS wxx,
   list_sum(list_transform(l, lambda b: b.n * exp(b0 + b1 * b.x) * (b0 + b1 * b.x) + b.y - b.n * exp(b0 + b1 * b.x))) AS wz,
   list_sum(list_transform(l, lambda b: b.x * (b.n * exp(b0 + b1 * b.x) * (b0 + b1 * b.x) + b.y - b.n * exp(b0 + b1 * b.x)))) AS wxz FROM it WHERE i < {k})),
fin AS (SELECT link_id, l, b0, b1, list_sum(list_transform(l, lambda b: b.n * exp(b0 + b1 * b.x))) AS w, list_sum(list_transform(l, lambda b: b.x * b.n * exp(b0 + b1 * b.x))) AS wx, list_sum(list_transform(l, lambda b: b.x * b.x * b.n * exp(b0 + b1 * b.x))) AS wxx FROM it WHERE i = {k})"""
PEARSON = "round((coalesce(sxy, 0) / n - sx / n * (sy / n)) / sqrt(greatest(sxx / n - (sx / n) * (sx / n), 1e-8) * greatest(syy / n - (sy / n) * (sy / n), 1e-8)), 6)"
NAMES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
OVER = "a.chrom = b.chrom AND a.s < b.e AND b.s < a.e"
PEAKNAME = "(CASE WHEN p_partkey % 2 = 0 THEN ' CHR' ELSE '' END || CASE WHEN p_size > 22 THEN 'x' ELSE CAST(p_size AS VARCHAR) END || CASE WHEN p_partkey % 3 = 0 THEN ':' ELSE '-' END || p_partkey || '-' || (p_partkey + 500))"

ORACLE_SQL: dict[str, str] = {
    "cis_window_links": base(3000) + SUMS.format(x="x", y="y") + f" SELECT CAST(peak_id AS VARCHAR) || ';' || CAST(gene_id AS VARCHAR) AS link_id, peak_id AS x_id, gene_id AS y_id, overlap, {PEARSON} AS corr FROM wl JOIN xs ON peak_id = xs.x_id JOIN ys ON gene_id = ys.y_id LEFT JOIN xy ON xy.x_id = peak_id AND xy.y_id = gene_id, nc",
    "interval_semi_flag": f"WITH {SPANS} SELECT event_id, CAST(EXISTS (SELECT 1 FROM spans b WHERE b.event_type = 'purchase' AND a.chrom = b.chrom AND a.s < b.s + 3600 AND b.s - 3600 < a.e) AS INTEGER) AS flag FROM spans a",
    "interval_left_count": f"WITH {SPANS} SELECT a.event_id, count(b.event_id) AS n_overlaps FROM spans a LEFT JOIN spans b ON b.event_type = 'error' AND {OVER} GROUP BY 1",
    "interval_reciprocal_overlap": f"WITH {SPANS} SELECT a.event_id, b.event_id AS r_event_id, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM spans a JOIN spans b ON {OVER} AND a.event_id < b.event_id WHERE overlap >= 0.5 * (a.e - a.s) AND overlap >= 0.5 * (b.e - b.s)",
    "interval_fraction_overlap": f"WITH {SPANS}, j AS (SELECT a.event_id, a.e - a.s AS len, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM spans a JOIN spans b ON {OVER} AND b.event_type = 'view') SELECT event_id, count(*) AS n_views, CAST(sum(overlap) AS BIGINT) AS seconds FROM j WHERE overlap >= 0.25 * len GROUP BY 1",
    "nearest_signed_distance": f"WITH {SPANS}, f AS (SELECT chrom, min(s) AS tss FROM spans WHERE event_type = 'purchase' GROUP BY 1) SELECT event_id, CASE WHEN e < tss THEN e - tss WHEN s > tss THEN s - tss ELSE 0 END AS signed_distance, abs(CASE WHEN e < tss THEN e - tss WHEN s > tss THEN s - tss ELSE 0 END) AS distance FROM spans LEFT JOIN f USING (chrom)",
    "body_gap_distance": f"WITH {SPANS}, f AS (SELECT chrom, min(s) AS bs, max(e) AS be FROM spans WHERE event_type = 'signup' GROUP BY 1) SELECT event_id, greatest(bs - e, s - be) AS gap FROM spans LEFT JOIN f USING (chrom)",
    "gene_activity": base() + ", b AS (SELECT peak_id, gene_id FROM peaks, genes WHERE peak_id % 5 = gene_id % 5 AND peak_id * 1000 < gene_id * 2000 + 1500 AND greatest(gene_id * 2000 - 500, 0) < peak_id * 1000 + 300), a AS (SELECT cell_id, gene_id, sum(value) AS value FROM x JOIN b ON feature_id = peak_id GROUP BY ALL) SELECT gene_id, sum(value) AS total, count(*) AS cells FROM a GROUP BY 1",
    "sparse_feature_moments": base() + " SELECT feature_id, count(*) AS nnz, sum(value) AS total, round(sum(value) / any_value(n), 6) AS mean, round(sum(value * value) / any_value(n) - (sum(value) / any_value(n)) * (sum(value) / any_value(n)), 6) AS var, round(log10(sum(value) + 1e-10), 6) AS log_total FROM x, nc GROUP BY 1",
    "group_moments": base() + ", g AS (SELECT celltype, feature_id, sum(value) AS s, sum(value * value) AS q, any_value(k.n) AS n FROM x JOIN cells USING (cell_id) JOIN (SELECT celltype, count(*) AS n FROM cells GROUP BY 1) k USING (celltype) GROUP BY ALL) SELECT celltype, feature_id, round(greatest(s / n, 1e-6), 6) AS mean, round(greatest(q / n - greatest(s / n, 1e-6) * greatest(s / n, 1e-6), greatest(s / n, 1e-6)), 6) AS var FROM g",
    "group_mean_pivot": base() + " SELECT feature_id, " + ", ".join(f"round(coalesce(sum(value) FILTER (celltype = '{n}'), 0) / (SELECT count(*) FROM cells WHERE celltype = '{n}'), 6) AS {n.lower()}" for n in NAMES) + " FROM x JOIN cells USING (cell_id) GROUP BY 1",
    "feature_sparsity_filter": base() + " SELECT feature_id, count(*) AS cells, sum(value) AS total FROM x, nc GROUP BY feature_id HAVING count(*) / any_value(n) >= 0.6",
    "qc_filter_chain": base() + """, r1 AS (SELECT * FROM y WHERE cell_id IN (SELECT cell_id FROM y GROUP BY 1 HAVING count(*) >= 8)), r2 AS (SELECT * FROM r1 WHERE feature_id IN (SELECT feature_id FROM r1 GROUP BY 1 HAVING count(*) >= 10)),
a1 AS (SELECT * FROM x WHERE feature_id IN (SELECT feature_id FROM x GROUP BY 1 HAVING count(*) >= 10)), a2 AS (SELECT * FROM a1 WHERE cell_id IN (SELECT cell_id FROM a1 GROUP BY 1 HAVING count(*) BETWEEN 10 AND 38 AND sum(value) BETWEEN 20 AND 60)),
r3 AS (SELECT * FROM r2 WHERE feature_id IN (SELECT feature_id FROM r2, nc GROUP BY 1 HAVING count(*) / any_value(n) >= 0.05)), a3 AS (SELECT cell_id, feature_id, round_even(value / 2, 0) AS value FROM a2 WHERE feature_id IN (SELECT feature_id FROM a2, nc GROUP BY 1 HAVING count(*) / any_value(n) >= 0.05)),
a4 AS (SELECT * FROM a3 WHERE value <> 0), u AS (SELECT 'rna' AS side, feature_id, cell_id, value FROM r3 WHERE cell_id IN (SELECT cell_id FROM a4) UNION ALL SELECT 'atac', feature_id, cell_id, value FROM a4 WHERE cell_id IN (SELECT cell_id FROM r3))
SELECT side, feature_id, count(*) AS cells, sum(value) AS total FROM u GROUP BY ALL""",
    "qc_summary_grouping_sets": base() + ", f AS (SELECT celltype, coalesce(sum(value), 0) AS d, count(value) AS k FROM cells LEFT JOIN x USING (cell_id) GROUP BY cell_id, celltype) SELECT CASE WHEN grouping(celltype) = 1 THEN 'all' ELSE celltype END AS cell_group, count(*) AS n_cells, round(avg(d), 6) AS mean_depth, round(quantile_cont(d, 0.5), 6) AS median_depth, round(avg(k), 6) AS mean_detected, round(avg(k) / 40, 6) AS detect_rate, round(1 - avg(k) / 40, 6) AS sparsity FROM f GROUP BY GROUPING SETS ((), (celltype))",
    "top_fraction_signal": base() + ", m AS (SELECT feature_id, sum(value) / any_value(n) AS m FROM x, nc GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY m DESC, feature_id) AS rk, count(*) OVER () AS n FROM m) SELECT count(*) FILTER (rk <= greatest(1, ceil(n * 0.1))) AS n_top, round(sum(m) FILTER (rk <= greatest(1, ceil(n * 0.1))) / sum(m), 6) AS top_share FROM k",
    "log_normalised_counts": base() + ", d AS (SELECT cell_id, sum(value) AS d FROM y GROUP BY 1) SELECT feature_id, round(sum(ln(1 + value * (SELECT quantile_cont(d, 0.5) FROM d) / d)), 4) AS total FROM y JOIN d USING (cell_id) GROUP BY 1",
    "rank_qcut_bins": "WITH k AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS rk, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_partkey, p_brand, CAST(" + QCUT.format(q=7) + " AS INTEGER) AS bin FROM k",
    "nested_mean_var_bins": base() + ", m AS (SELECT feature_id, sum(value) / any_value(n) AS mean, sum(value * value) / any_value(n) - (sum(value) / any_value(n)) * (sum(value) / any_value(n)) AS var FROM x, nc GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY mean, feature_id) AS rk, count(*) OVER () AS n FROM m), b AS (SELECT feature_id, var, CAST(" + QCUT.format(q=5) + " AS INTEGER) AS mean_bin FROM k), k2 AS (SELECT *, row_number() OVER (PARTITION BY mean_bin ORDER BY var, feature_id) AS rk, count(*) OVER (PARTITION BY mean_bin) AS n FROM b) SELECT feature_id, mean_bin, mean_bin || '.' || CAST(" + QCUT.format(q=3) + " AS INTEGER) AS bin FROM k2",
    "whitened_bins": "WITH p AS (SELECT p_partkey, log10(p_retailprice) AS a, p_size / 50.0::DOUBLE AS b FROM part), s AS (SELECT var_samp(a) AS s11, covar_samp(a, b) AS s12, var_samp(b) AS s22 FROM p), z AS (SELECT p_partkey, a, s11, s12 / sqrt(s11) AS u12, b / sqrt(s22 - (s12 / sqrt(s11)) * (s12 / sqrt(s11))) AS z2 FROM p, s) SELECT p_partkey, round((a - u12 * z2) / sqrt(s11), 6) AS z1, round(z2, 6) AS z2 FROM z",
    "value_bins": """WITH d AS (SELECT value * value * value AS v FROM events WHERE value IS NOT NULL), s AS (SELECT min(v) AS lo, max(v) AS hi, count(DISTINCT v) AS u FROM d),
c AS (SELECT v, m, greatest(len(list_filter(range(0, 6 * m), lambda i: v > lo + i * ((hi - lo) / (6 * m)))) - 1, 0) AS fine FROM d, s, (SELECT unnest(range(1, 9)) AS m)),
e AS (SELECT m, list_sort(list_distinct(quantile_cont(v, [0, 1 / 3.0::DOUBLE, 2 / 3.0::DOUBLE, 1]))) AS q FROM c WHERE fine >= 3 GROUP BY 1),
l AS (SELECT 0 AS m, v, fine AS bin FROM c WHERE m = 1 UNION ALL SELECT m, v, CASE WHEN fine >= 3 THEN 3 + greatest(len(list_filter(q[:-2], lambda x: v > x)) - 1, 0) ELSE fine END FROM c LEFT JOIN e USING (m)
 UNION ALL SELECT 99, v, greatest(len(list_filter(q[:-2], lambda x: v > x)) - 1, 0) FROM d, (SELECT list_sort(list_distinct(quantile_cont(v, [0, 1 / 6.0::DOUBLE, 2 / 6.0::DOUBLE, 3 / 6.0::DOUBLE, 4 / 6.0::DOUBLE, 5 / 6.0::DOUBLE, 1]))) AS q FROM d)),
z AS (SELECT m, min(n) AS least FROM (SELECT m, bin, count(*) AS n FROM l GROUP BY ALL) GROUP BY 1),
w AS (SELECT coalesce(min(m) FILTER (least >= 20 AND m < 99 AND m <= u // 20), 99) AS m FROM z, s)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, min(v) AS low, max(v) AS high FROM l JOIN w USING (m) GROUP BY 1""",
    "percentile_rank_bins": f"WITH d AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS v FROM documents), k AS (SELECT doc_id, {fr('v')} AS p FROM d) SELECT doc_id, CASE WHEN p <= 0.25 THEN 'q1' WHEN p <= 0.5 THEN 'q2' WHEN p <= 0.75 THEN 'q3' WHEN p <= 1 THEN 'q4' END AS bin FROM k",
    "bins_2d": f"WITH k AS (SELECT {fr('value')} AS a, {fr('user_id')} AS b FROM events) SELECT CASE WHEN a <= 0.5 THEN 'low' ELSE 'high' END || '_' || CASE WHEN b <= 0.5 THEN 'low' ELSE 'high' END AS bin, count(*) AS n FROM k GROUP BY 1",
    "threshold_bins": "SELECT event_type, CASE WHEN value <= 50 THEN 'low' WHEN value > 50 THEN 'high' END AS bin, count(*) AS n FROM events GROUP BY ALL",
    "count_bins": "WITH k AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) SELECT CASE WHEN k = 1 THEN '1' WHEN k BETWEEN 2 AND 5 THEN '2-5' WHEN k BETWEEN 6 AND 10 THEN '6-10' WHEN k >= 11 THEN '11+' END AS bin, count(*) AS n FROM k GROUP BY 1",
    "distance_bins": "SELECT CASE WHEN o_totalprice <= 50000 THEN 'near' WHEN o_totalprice <= 150000 THEN 'mid' WHEN o_totalprice <= 250000 THEN 'far' ELSE 'distal' END AS bin, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_f FROM orders GROUP BY 1",
    "keep_best_dedup": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) = 1",
    "label_consensus_dedup": f"WITH {SCORES} SELECT source, CASE WHEN avg(label::INT) > 0.5 THEN 1.0::DOUBLE WHEN avg(label::INT) < 0.5 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS label, min(m1) AS m1, CAST(max(label::INT) AS DOUBLE) AS any_label, round(avg(label::INT), 6) AS share FROM sc GROUP BY 1",
    "score_dedup_agg": "SELECT l_partkey, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(l_discount), 6) AS mean, round(quantile_cont(l_quantity, 0.5), 6) AS median FROM lineitem GROUP BY 1",
    "outer_merge_methods": "WITH a AS (SELECT o_custkey, max(o_totalprice) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), b AS (SELECT o_custkey, max(o_totalprice) AS low FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1), c AS (SELECT o_custkey, min(o_totalprice) AS pending FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT o_custkey, urgent, low, pending FROM a FULL JOIN b USING (o_custkey) FULL JOIN c USING (o_custkey)",
    "left_merge_unique": "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "replaced_score_column": "SELECT l.doc_id, l.quality, d.n_chars AS toxic FROM labels l LEFT JOIN documents d USING (doc_id)",
    "union_distinct_links": "SELECT l_partkey AS peak, l_suppkey AS gene FROM lineitem WHERE l_quantity > 25 UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.05",
    "missing_bins_anti": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "set_overlap_jaccard": "WITH s AS (SELECT DISTINCT o_orderpriority AS p, o_custkey FROM orders), n AS (SELECT a.p AS a, b.p AS b, count(*) AS n FROM s a JOIN s b USING (o_custkey) GROUP BY ALL) SELECT n.a, n.b, round(n.n / (x.n + y.n - n.n), 6) AS jaccard FROM n JOIN n x ON x.a = n.a AND x.b = n.a JOIN n y ON y.a = n.b AND y.b = n.b",
    "control_peaks_hash": "WITH r AS (SELECT p_partkey AS f, p_brand AS b, row_number() OVER o - 1 AS pos, count(*) OVER (PARTITION BY p_brand) AS n FROM part WINDOW o AS (PARTITION BY p_brand ORDER BY p_partkey)), t AS (SELECT *, unnest(range(0, CASE WHEN n - 1 > 10 THEN 55 ELSE n - 1 END)) AS turn FROM r WHERE n > 1), d AS (SELECT *, " + draw("f", "turn", 3) + " AS lot FROM t), e AS (SELECT f, b, pos, CASE WHEN n - 1 > 10 THEN lot % (n - 1) ELSE turn END AS place, CASE WHEN n - 1 > 10 THEN turn ELSE lot * 16777216 + turn END AS turn FROM d), g AS (SELECT f, b, place + (place >= pos)::INT AS at, min(turn) AS turn FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY turn) - 1 AS rk FROM g) SELECT k.f AS feature_id, CAST(rk AS INTEGER) AS ctrl_rank, r.f AS ctrl_id FROM k JOIN r ON r.b = k.b AND r.pos = k.at WHERE rk < 5",
    "control_pairs_decode": "WITH a AS (SELECT p_type AS bin, p_partkey AS id, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_type) AS n, min(p_partkey) OVER (PARTITION BY p_type) AS lo FROM part), b AS (SELECT CAST(s_nationkey % 4 AS VARCHAR) AS bin, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey % 4 ORDER BY s_suppkey) - 1 AS pos, count(*) OVER (PARTITION BY s_nationkey % 4) AS n, min(s_suppkey) OVER (PARTITION BY s_nationkey % 4) AS lo FROM supplier), t AS (SELECT a.bin AS ab, b.bin AS bb, a.n AS an, b.n AS bn, a.lo AS alo, b.lo AS blo, unnest(range(0, CASE WHEN a.n * b.n > 100 THEN 190 ELSE a.n * b.n END)) AS turn FROM (SELECT DISTINCT bin, n, lo FROM a) a, (SELECT DISTINCT bin, n, lo FROM b) b), u AS (SELECT *, " + draw("alo", "blo", 11) + " AS base FROM t), v AS (SELECT *, " + draw("base", "turn", 12) + " AS lot, " + draw("base", "turn", 13) + " AS lot2 FROM u), d AS (SELECT ab, bb, CASE WHEN an * bn > 100 THEN lot % an ELSE turn // bn END AS l, CASE WHEN an * bn > 100 THEN lot2 % bn ELSE turn % bn END AS r, min(CASE WHEN an * bn > 100 THEN turn ELSE lot * 16777216 + turn END) AS turn FROM v GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY ab, bb ORDER BY turn) - 1 AS rk FROM d) SELECT ab || '_' || bb AS bin, CAST(rk AS INTEGER) AS ctrl_rank, a.id AS left_id, b.id AS right_id FROM k JOIN a ON a.bin = ab AND a.pos = l JOIN b ON b.bin = bb AND b.pos = r WHERE rk < 50",
    "cross_group_null_pairs": "WITH r AS (SELECT s_suppkey AS id, s_nationkey % 5 AS grp, row_number() OVER (ORDER BY s_nationkey % 5, s_suppkey) - 1 AS pos FROM supplier), g AS (SELECT grp, min(pos) AS f, count(*) AS own FROM r GROUP BY 1), l AS (SELECT p_partkey AS id, coalesce(own, 0) AS own, coalesce(f, (SELECT count(*) FROM r)) AS f, " + draw("p_partkey", "0", 5) + " % ((SELECT count(*) FROM r) - coalesce(own, 0)) AS pick FROM part LEFT JOIN g ON g.grp = p_size % 5) SELECT l.id, r.id AS partner_id FROM l JOIN r ON r.pos = CASE WHEN pick < f THEN pick ELSE pick + own END",
    "pearson_pairs": base() + SUMS.format(x="x", y="y") + f" SELECT link_id, {PEARSON} AS corr FROM prs JOIN xs USING (x_id) JOIN ys USING (y_id) LEFT JOIN xy USING (x_id, y_id), nc",
    "spearman_pairs": base() + ", xf AS (SELECT cell_id, f.feature_id, coalesce(value, 0) AS value FROM cells CROSS JOIN (SELECT DISTINCT feature_id FROM x) f LEFT JOIN x USING (cell_id, feature_id)), yf AS (SELECT cell_id, f.feature_id, coalesce(value, 0) AS value FROM cells CROSS JOIN (SELECT DISTINCT feature_id FROM y) f LEFT JOIN y USING (cell_id, feature_id)), xr AS (SELECT cell_id, feature_id, rank() OVER (PARTITION BY feature_id ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, value) - 1) / 2 AS r FROM xf), yr AS (SELECT cell_id, feature_id, rank() OVER (PARTITION BY feature_id ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, value) - 1) / 2 AS r FROM yf) SELECT link_id, round(corr(xr.r, yr.r), 6) AS corr FROM prs JOIN xr ON xr.feature_id = x_id JOIN yr ON yr.feature_id = y_id AND yr.cell_id = xr.cell_id GROUP BY 1",
    "poisson_binary_mle": base() + SUMS.format(x="(SELECT cell_id, feature_id, 1.0::DOUBLE AS value FROM x)", y="y") + ", v AS (SELECT link_id, sx AS n1, n - sx AS n0, coalesce(sxy, 0) AS y1, sy - coalesce(sxy, 0) AS y0 FROM prs JOIN xs USING (x_id) JOIN ys USING (y_id) LEFT JOIN xy USING (x_id, y_id), nc) SELECT link_id, round(CASE WHEN y0 > 0 AND n0 > 0 THEN ln(y0 / n0) END, 6) AS b0, round(CASE WHEN y0 > 0 AND n0 > 0 AND y1 > 0 AND n1 > 0 THEN ln(y1 / n1) - ln(y0 / n0) END, 6) AS b1, round(CASE WHEN y0 > 0 AND y1 > 0 THEN sqrt(1 / y0 + 1 / y1) END, 6) AS se FROM v",
    "poisson_irls_hist": base() + ", " + IRLS.format(ridge="0", k=25) + " SELECT link_id, round(b0, 5) + 0.0 AS b0, round(b1, 5) + 0.0 AS b1, round(sqrt(w / (w * wxx - wx * wx)), 5) AS se FROM fin",
    "poisson_fits_by_part": by_part() + ", " + IRLS.format(ridge="0", k=12) + " SELECT y_id, count(*) AS fits, count(*) FILTER (b1 IS NOT NULL AND NOT isnan(b1)) AS finite, round(min(b0), 4) + 0.0 AS least_b0, round(max(b1), 4) + 0.0 AS most_b1 FROM fin JOIN prs USING (link_id) GROUP BY 1",
    "poisson_ridge": base() + ", " + IRLS.format(ridge="1.0", k=50) + " SELECT link_id, round(b1, 5) + 0.0 AS b1 FROM fin",
    "poisson_likelihood_ratio": base() + ", " + IRLS.format(ridge="0", k=25) + ", z AS (SELECT feature_id AS y_id, sum(value) AS s FROM y GROUP BY 1), q AS (SELECT y_id, s * ln(s / n) - s AS ll0 FROM z, nc) SELECT link_id, round(2 * (list_sum(list_transform(l, lambda b: b.y * (b0 + b1 * b.x) - b.n * exp(b0 + b1 * b.x))) - ll0), 3) AS lr FROM fin JOIN prs USING (link_id) JOIN q USING (y_id)",
    "poisson_reduced_ll": base() + " SELECT feature_id AS y_id, round(sum(value) * ln(sum(value) / any_value(n)) - sum(value) - sum(lgamma(value + 1)), 3) AS ll0 FROM y, nc GROUP BY 1",
    "mc_pvalue": f"WITH {CONTROLS} " + mc(False),
    "binned_mc_pvalue": f"WITH {CONTROLS} " + mc(True),
    "two_sided_mc_pvalue": f"WITH o1 AS (SELECT p_partkey AS key, p_brand AS grp, abs(p_retailprice % 97 - 48) AS value FROM part), c1 AS (SELECT p_brand AS grp, abs(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 101 AS DOUBLE) - 50) AS ctrl FROM lineitem JOIN part ON l_partkey = p_partkey), obs AS (SELECT * FROM o1), ctrl AS (SELECT * FROM c1) " + mc(True),
    "pooled_pvalue": f"WITH {CONTROLS}, st AS (SELECT grp, avg(ctrl) AS m, stddev_pop(ctrl) AS s FROM ctrl GROUP BY 1 HAVING s > 0), o AS (SELECT key, (value + 0.3137 - m) / s AS z FROM obs JOIN st USING (grp)), c AS (SELECT (ctrl - m) / s AS z FROM ctrl JOIN st USING (grp) WHERE grp IN (SELECT grp FROM obs)), u AS (SELECT key, z, 0 AS k FROM o UNION ALL SELECT NULL, z, 1 FROM c), n AS (SELECT key, k, sum(k) OVER (ORDER BY z DESC) AS ge, sum(k) OVER () AS n FROM u), g AS (SELECT key, (1 + ge) / (1 + n) AS p FROM n WHERE k = 0) SELECT obs.key, round(p, 4) AS ppval FROM obs LEFT JOIN g USING (key)",
    "zscore": f"WITH {CONTROLS}, st AS (SELECT grp, avg(ctrl) AS m, stddev_pop(ctrl) AS s FROM ctrl GROUP BY 1), z AS (SELECT key, (value - m) / s AS z FROM obs LEFT JOIN st USING (grp)), e AS (SELECT key, z, abs(z) AS x, exp(-z * z / 2) AS e FROM z), u AS (SELECT key, z, e * ((((((3.52624965998911e-2 * x + 0.700383064443688) * x + 6.37396220353165) * x + 33.912866078383) * x + 112.079291497871) * x + 221.213596169931) * x + 220.206867912376) / (((((((8.83883476483184e-2 * x + 1.75566716318264) * x + 16.064177579207) * x + 86.7807322029461) * x + 296.564248779674) * x + 637.333633378831) * x + 793.826512519948) * x + 440.413735824752) AS q FROM e) SELECT key, round(z, 6) + 0.0 AS z, round(CASE WHEN z < 0 THEN 1 - q ELSE q END, 6) AS zpval FROM u",
    "studentised_pvalue": "WITH obs AS (SELECT p_partkey AS key, p_brand AS grp, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE greatest(least((p_retailprice % 97) / (p_partkey % 7), 100), -100) END AS value FROM part), c0 AS (SELECT p_brand AS grp, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 101 AS DOUBLE) AS c FROM lineitem JOIN part ON l_partkey = p_partkey), ctrl AS (SELECT grp, CASE WHEN c % 5 = 0 THEN NULL ELSE greatest(least(c / (c % 5), 100), -100) END AS ctrl FROM c0) SELECT key, CASE WHEN value IS NOT NULL THEN round((1 + (SELECT count(*) FROM ctrl c WHERE c.grp = o.grp AND c.ctrl >= o.value)) / (1.0 + (SELECT count(ctrl) FROM ctrl c WHERE c.grp = o.grp)), 9) END AS mcpval FROM obs o",
    "empirical_fdr": f"WITH {CONTROLS}, " + fdr(False),
    "binned_empirical_fdr": f"WITH {CONTROLS}, " + fdr(True),
    "bh_fdr": f"WITH {CONTROLS}, p AS (" + mc(True, 15) + "), k AS (SELECT key, mcpval, mcpval * count(*) OVER () / row_number() OVER (ORDER BY mcpval, key) AS q FROM p) SELECT key, round(least(1.0, min(q) OVER (ORDER BY mcpval DESC, key DESC ROWS UNBOUNDED PRECEDING)), 6) AS bh_q FROM k",
    "cauchy_combine": "SELECT l_orderkey, round(0.5 - atan(avg(tan(pi() * (0.5 - greatest(least(l_discount + 0.01, 1 - 1e-15), 1e-15))))) / pi(), 6) AS p FROM lineitem GROUP BY 1",
    "contingency_log_or": f"WITH {SCORES}, c AS (SELECT lang, count(*) FILTER (m1 <= 1500 AND label) AS tp, count(*) FILTER (m1 <= 1500 AND NOT label) AS fp, count(*) FILTER (m1 > 1500 AND label) AS fn, count(*) FILTER (m1 > 1500 AND NOT label) AS tn FROM sc GROUP BY 1) SELECT *, round(ln((tp + 0.5) * (tn + 0.5) / ((fp + 0.5) * (fn + 0.5))), 6) + 0.0 AS log_or FROM c",
    "fisher_exact_p": f"WITH {SCORES}, c AS (SELECT lang, count(*) FILTER (m1 <= 1500 AND label) AS a, count(*) FILTER (m1 <= 1500 AND NOT label) AS b, count(*) FILTER (m1 > 1500 AND label) AS c, count(*) FILTER (m1 > 1500 AND NOT label) AS d FROM sc GROUP BY 1), k AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM c), l AS (SELECT *, lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(c + d - a - c + k + 1) AS v, lgamma(a + b + 1) - lgamma(a + 1) - lgamma(b + 1) + lgamma(c + d + 1) - lgamma(c + 1) - lgamma(d + 1) AS o, lgamma(a + b + c + d + 1) - lgamma(a + c + 1) - lgamma(b + d + 1) AS t FROM k) SELECT lang, round(least(1.0, sum(exp(v - t)) FILTER (v <= o + ln(1.0000001))), 6) AS p FROM l GROUP BY 1",
    "enrichment_recall": f"WITH {SCORES}, " + CURVE.format(t="sc", p="", s="m1") + " SELECT doc_id, round(recall, 6) AS recall, round(enrichment, 6) AS enrichment FROM c",
    "auerc": f"WITH {SCORES}, {LONG}, " + CURVE.format(t="lg", p="PARTITION BY method, lang", s="score") + ", l AS (SELECT method, lang, recall AS x, enrichment * (1 - recall) AS yw, 1 - recall AS w, lag(recall) OVER o AS px, lag(enrichment * (1 - recall)) OVER o AS pyw, lag(1 - recall) OVER o AS pw, row_number() OVER o AS i, count(*) OVER (PARTITION BY method, lang) AS m FROM c WINDOW o AS (PARTITION BY method, lang ORDER BY linked)), a AS (SELECT method, lang, any_value(m) AS m, sum(CASE WHEN i = 1 THEN x * yw ELSE (x - px) * (yw + pyw) / 2 END) + sum(CASE WHEN i = m THEN (1 - x) * yw ELSE 0 END) AS area, sum(CASE WHEN i = 1 THEN x * w ELSE (x - px) * (w + pw) / 2 END) + sum(CASE WHEN i = m THEN (1 - x) * w ELSE 0 END) AS mass FROM l GROUP BY ALL) SELECT method, lang, CASE WHEN m >= 2 AND mass <> 0 THEN round(area / mass, 6) END AS auerc FROM a",
    "topk_log_or": f"WITH {SCORES}, " + CURVE.format(t="sc", p="", s="m1") + " SELECT k, round(ln((gold + 0.5) * (n - k - g + gold + 0.5) / ((k - gold + 0.5) * (g - gold + 0.5))), 6) AS log_or FROM w WHERE g > 0 AND g < n AND k <= g AND k <= floor(n * 0.99)",
    "auorc": f"WITH {SCORES}, " + CURVE.format(t="sc", p="PARTITION BY lang", s="m1") + ", q AS (SELECT lang, k, ln((gold + 0.5) * (n - k - g + gold + 0.5) / ((k - gold + 0.5) * (g - gold + 0.5))) AS v FROM w WHERE g > 0 AND g < n AND k <= g AND k <= floor(n * 0.99)), l AS (SELECT lang, k, v / k AS y, 1 / k AS w, lag(k) OVER o AS pk, lag(v / k) OVER o AS py, lag(1 / k) OVER o AS pw FROM q WINDOW o AS (PARTITION BY lang ORDER BY k)) SELECT lang, round(sum((k - pk) * (y + py)) / sum((k - pk) * (w + pw)), 6) AS auorc FROM l GROUP BY 1",
    "average_precision": f"WITH {SCORES}, " + ap("sc", "m1", "lang") + " SELECT lang, round(ap, 6) AS ap FROM apt",
    "partial_ap": f"WITH {SCORES}, " + ap("sc", "m1", "") + ", q AS (SELECT rec, pre FROM pr WHERE rec <= 0.2 UNION ALL SELECT 0.0, 1.0), l AS (SELECT rec - lag(rec) OVER o AS dx, pre + lag(pre) OVER o AS h FROM q WINDOW o AS (ORDER BY rec, pre DESC)) SELECT round(sum(dx * h / 2) / 0.2, 6) AS pap FROM l",
    "bootstrap_metric_ci": f"WITH {SCORES}, " + reps("sc", 50, 17) + ", " + ap("rp", "m1", "rep", "weight") + " SELECT round(max(ap) FILTER (rep = 0), 6) AS estimate, round(stddev_samp(ap) FILTER (rep > 0), 5) AS bootstrap_sd, round(quantile_cont(ap, 0.025) FILTER (rep > 0), 5) AS ci_lower, round(quantile_cont(ap, 0.975) FILTER (rep > 0), 5) AS ci_upper, count(ap) FILTER (rep > 0) AS n_bootstrap FROM apt",
    "bootstrap_paired_difference": f"WITH {SCORES}, {LONG}, " + reps("lg", 50, 17) + ", " + ap("rp", "score", "method, rep", "weight") + ", d AS (SELECT a.method, a.rep, a.ap - b.ap AS d FROM apt a JOIN apt b ON a.rep = b.rep AND b.method = 'm2') SELECT method, round(max(d) FILTER (rep = 0), 5) + 0.0 AS diff_estimate, round(quantile_cont(d, 0.025) FILTER (rep > 0), 5) + 0.0 AS diff_ci_lower, round(quantile_cont(d, 0.975) FILTER (rep > 0), 5) + 0.0 AS diff_ci_upper, round(least(1.0, 2 * least(avg((d <= 0)::INT) FILTER (rep > 0), avg((d >= 0)::INT) FILTER (rep > 0))), 5) AS p_value FROM d GROUP BY 1",
    "entropy_specificity": base() + ", " + spec("x", "s") + " SELECT feature_id, round(specificity, 6) AS specificity, dominant FROM s",
    "joint_specificity": base() + ", k AS (SELECT celltype, count(*) AS n FROM cells GROUP BY 1), xm AS (SELECT feature_id AS x_id, celltype, sum(value) / any_value(n) AS a FROM x JOIN cells USING (cell_id) JOIN k USING (celltype) GROUP BY ALL), ym AS (SELECT feature_id AS y_id, celltype, sum(value) / any_value(n) AS b FROM y JOIN cells USING (cell_id) JOIN k USING (celltype) GROUP BY ALL), v AS (SELECT link_id, coalesce(a, 0) * coalesce(b, 0) + 1e-6 AS v FROM prs JOIN (SELECT DISTINCT x_id FROM xm) USING (x_id) JOIN (SELECT DISTINCT y_id FROM ym) USING (y_id) CROSS JOIN k LEFT JOIN xm USING (x_id, celltype) LEFT JOIN ym USING (y_id, celltype)) SELECT link_id, round(1 + sum(v / t * ln(v / t)) / ln(5), 6) AS specificity FROM (SELECT link_id, v, sum(v) OVER (PARTITION BY link_id) AS t FROM v) GROUP BY 1",
    "pip_specificity": "WITH c AS (SELECT l_suppkey, l_returnflag, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY ALL) SELECT l_suppkey, round(1 + sum(v / t * ln(v / t)) / ln(3), 6) AS specificity FROM (SELECT *, sum(v) OVER (PARTITION BY l_suppkey) AS t FROM c) GROUP BY 1",
    "link_specificity": base(3000) + ", " + spec("x", "sx") + ", " + spec("y", "sy") + " SELECT peak_id, gene_id, round(least(sx.specificity, sy.specificity), 6) AS min_specificity, round(sqrt(sx.specificity * sy.specificity), 6) AS mean_specificity, sx.dominant = sy.dominant AS concordant FROM wl JOIN sx ON sx.feature_id = peak_id JOIN sy ON sy.feature_id = gene_id",
    "meta_fixed": "WITH e AS (SELECT c_nationkey, c_mktsegment, avg(o_totalprice / 1000) AS y, stddev_samp(o_totalprice / 1000) / sqrt(count(*)) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL HAVING s > 0), w AS (SELECT c_mktsegment, sum(1 / (s * s)) AS w, sum(y / (s * s)) AS wy, sum(y * y / (s * s)) AS wyy FROM e GROUP BY 1) SELECT c_mktsegment, round(wy / w, 4) AS estimate, round(sqrt(1 / w), 4) AS se, round(greatest(wyy - wy * wy / w, 0), 3) AS q FROM w",
    "meta_random": "WITH e AS (SELECT c_nationkey, c_mktsegment, avg(o_totalprice / 1000) AS y, stddev_samp(o_totalprice / 1000) / sqrt(count(*)) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL HAVING s > 0), w AS (SELECT c_mktsegment, count(*) AS n, sum(1 / (s * s)) AS w, sum(y / (s * s)) AS wy, sum(y * y / (s * s)) AS wyy, sum(1 / (s * s * s * s)) AS ww FROM e GROUP BY 1), t AS (SELECT c_mktsegment, greatest(0, (greatest(wyy - wy * wy / w, 0) - (n - 1)) / (w - ww / w)) AS tau2 FROM w) SELECT c_mktsegment, round(sum(y / (s * s + tau2)) / sum(1 / (s * s + tau2)), 4) AS estimate, round(sqrt(1 / sum(1 / (s * s + tau2))), 4) AS se, round(any_value(tau2), 4) AS tau2 FROM e JOIN t USING (c_mktsegment) GROUP BY 1",
    "regression_slopes": "SELECT l_returnflag, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY 1",
    "knn_cosine": f"WITH {KNN} SELECT vec_id, rank, neighbour, round(d, 6) AS distance FROM nn",
    "knn_smooth": f"WITH {KNN}, e AS (SELECT vec_id, neighbour FROM nn UNION ALL SELECT vec_id, vec_id FROM embeddings) SELECT e.vec_id, round(avg(m.label), 6) AS smooth FROM e JOIN embeddings m ON m.vec_id = neighbour GROUP BY 1",
    "gearys_c": f"WITH {KNN}, v AS (SELECT vec_id, CAST(label AS DOUBLE) AS x, CAST(embedding[1] AS DOUBLE) AS y FROM embeddings), s AS (SELECT count(*) AS n, var_pop(x) * count(*) AS sx, var_pop(y) * count(*) AS sy FROM v), d AS (SELECT sum((a.x - b.x) * (a.x - b.x)) AS dx, sum((a.x - b.x) * (a.y - b.y)) AS dy, count(*) AS w FROM nn JOIN v a USING (vec_id) JOIN v b ON b.vec_id = neighbour) SELECT 'auto' AS kind, round((n - 1) * dx / (2 * w * sx), 6) + 0.0 AS c FROM d, s UNION ALL SELECT 'cross', round((n - 1) * dy / (2 * w * sqrt(sx * sy)), 6) + 0.0 FROM d, s",
    "embedding_arrows": f"WITH {KNN}, u AS (SELECT vec_id, unnest(range(1, 65)) AS p, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings), m AS (SELECT nn.vec_id, p, avg(v) AS m FROM nn JOIN u ON u.vec_id = neighbour GROUP BY ALL) SELECT vec_id, round(sum((m - v) * (m - v)), 5) AS squared_length FROM m JOIN u USING (vec_id, p) GROUP BY 1",
    "residual_pearson_alpha": base() + ", t AS (SELECT sum(value) AS t FROM y), d AS (SELECT c.cell_id, coalesce(sum(value), 0) AS d FROM cells c LEFT JOIN y USING (cell_id) GROUP BY 1), p AS (SELECT feature_id, sum(value) / any_value(t) AS p FROM y, t GROUP BY 1), f AS (SELECT d.cell_id, p.feature_id, coalesce(value, 0) AS v, d * p AS mu FROM d CROSS JOIN p LEFT JOIN y ON y.cell_id = d.cell_id AND y.feature_id = p.feature_id), a AS (SELECT feature_id, greatest(sum((v - mu) * (v - mu) - mu) / sum(mu * mu), 0) AS alpha FROM f GROUP BY 1) SELECT feature_id, round(any_value(alpha), 6) + 0.0 AS alpha, round(sum((v - mu) * (v - mu) / greatest(mu + alpha * mu * mu, 1e-8)), 3) AS squares, count(*) AS n FROM f JOIN a USING (feature_id) GROUP BY 1",
    "chunk_gap_check": "WITH c AS (SELECT o_orderkey // 500 AS c, min(o_orderkey) AS s, max(o_orderkey) + CASE WHEN (o_orderkey // 500) % 7 = 3 THEN 0 ELSE 1 END AS e FROM orders GROUP BY c), l AS (SELECT s, lag(e) OVER (ORDER BY s, e) AS p FROM c) SELECT p AS gap_start, s AS gap_end, s - p AS gap_length FROM l WHERE p IS NOT NULL AND p <> s",
    "consolidated_chunks": "SELECT l_orderkey, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1",
    "canonical_peak": f"SELECT p_partkey, CASE WHEN regexp_matches(trim({PEAKNAME}), '(?i)^(?:chr)?([0-9XYMT]+)[:-]([0-9]+)-([0-9]+)$') THEN 'chr' || upper(regexp_extract(trim({PEAKNAME}), '(?i)^(?:chr)?([0-9XYMT]+)[:-]([0-9]+)-([0-9]+)$', 1)) || ':' || p_partkey || '-' || (p_partkey + 500) ELSE trim({PEAKNAME}) END AS peak FROM part",
    "strip_version": "SELECT p_partkey, 'ENSG' || p_partkey AS gene FROM part",
    "coord_parse": "SELECT p_partkey, 'chr' || p_size AS chrom, p_partkey AS start, CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE p_partkey + 9 END AS \"end\" FROM part",
    "chromosome_names": "SELECT CASE WHEN p_size > 45 THEN 'chrM' WHEN p_size > 40 THEN 'x' WHEN p_size > 35 THEN 'GL000' ELSE 'chr' || p_size END AS chrom, count(*) AS n FROM part GROUP BY 1",
    "link_id_parts": "SELECT DISTINCT l_partkey || ';' || l_suppkey || ';' || l_returnflag AS id, CAST(l_partkey AS VARCHAR) AS peak, l_suppkey || ';' || l_returnflag AS gene FROM lineitem",
}
