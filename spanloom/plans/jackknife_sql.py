"""DuckDB SQL of the jackknives: every removal made in full."""

from __future__ import annotations

from .oracles import LONG, SCORES

SPREAD = """count(*) FILTER (ok) AS n_blocks, quantile_cont(CASE WHEN ok THEN lft END, 0.025) AS lo, quantile_cont(CASE WHEN ok THEN lft END, 0.975) AS hi, any_value(stat) AS stat,
 sum(CASE WHEN ok THEN stat - lft END) + sum(CASE WHEN ok THEN lft / h END) AS centre, list({'tau': h * stat - (h - 1) * lft, 'h': h}) FILTER (ok) AS l"""
SD = "sqrt(list_sum(list_transform(l, lambda q: (q.tau - centre) ** 2 / (q.h - 1))) / n_blocks)"
GOLD = "CAST(label AS INTEGER) + doc_id % 7 / 10 AS gold"


def odds_sql(tops: list[int], epsilon: float) -> str:
    def odds(e: float) -> str:
        top, low = f"((tp + {e}) * (tn + {e}))", f"((fp + {e}) * (fn + {e}))"
        return f"CASE WHEN {low} > 0 THEN {top} / {low} WHEN {top} > 0 THEN 'inf'::DOUBLE END"

    table = "count(*) FILTER (r <= top AND label) AS tp, count(*) FILTER (r <= top AND NOT label) AS fp, count(*) FILTER (r > top AND label) AS fn, count(*) FILTER (r > top AND NOT label) AS tn, count(*) AS n"
    lf = "lgamma({} + 1)"
    choose = lambda n, k: f"({lf.format(n)} - {lf.format(k)} - {lf.format(f'({n} - {k})')})"
    log_p = lambda k: f"{choose('(tp + fp)', k)} + {choose('(fn + tn)', f'(tp + fn - {k})')} - {choose('(tp + fp + fn + tn)', '(tp + fn)')}"
    fisher = f"least(1.0, list_sum(list_transform(list_filter(list_transform(range(greatest(0, tp - tn), least(tp + fp, tp + fn) + 1), lambda k: {log_p('k')}), lambda p: p <= {log_p('tp')} + 1e-7), lambda p: exp(p))))"
    return f"""WITH {SCORES}, {LONG}, rk AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score NULLS LAST, doc_id) AS r FROM lg WHERE label IS NOT NULL), tp AS (SELECT unnest({tops})::INTEGER AS top),
a AS (SELECT method, top, {table} FROM rk, tp GROUP BY ALL), w AS (SELECT method, top, n, {odds(epsilon)} AS stat, {fisher} AS fisher FROM a),
b AS (SELECT k.method, top, d.lang AS out, {table} FROM rk k, tp, (SELECT DISTINCT lang FROM sc) d WHERE k.lang IS DISTINCT FROM d.lang GROUP BY ALL),
j AS (SELECT method, top, stat, fisher, lft, h, h > 1 AND isfinite(lft) AND isfinite(stat) AS ok FROM (SELECT method, top, stat, fisher, w.n / (w.n - b.n) AS h, {odds(0.0)} AS lft FROM b JOIN w USING (method, top))),
s AS (SELECT method, top, any_value(fisher) AS fisher, {SPREAD} FROM j GROUP BY ALL)
SELECT method, top, round(stat, 6) AS odds_ratio, round(fisher, 6) AS fisher_p, round(lo, 6) AS ci_lower, round(hi, 6) AS ci_upper, round({SD}, 6) AS jackknife_sd, n_blocks FROM s"""


def _areas(table: str, removals: str, keep: str, tops: list[int]) -> str:
    mids = ", ".join(f"({(a + b) // 2}, {b - a})" for a, b in zip(tops, tops[1:]))
    return f"""rm AS ({removals}), mi AS (SELECT * FROM (VALUES {mids}) AS t(mid, width)),
kr AS (SELECT rm.*, t.*, row_number() OVER (PARTITION BY rm.id, t.method ORDER BY score, doc_id) AS r, count(*) OVER (PARTITION BY rm.id, t.method) AS n, avg(gold) OVER (PARTITION BY rm.id, t.method) AS m FROM rm, {table} t WHERE {keep}),
hi AS (SELECT id, b, q, method, n, mid, width, avg(gold) FILTER (r <= mid) / any_value(m) AS h FROM kr, mi GROUP BY ALL),
ar AS (SELECT id, b, q, method, n, sum(h * width) AS area FROM hi GROUP BY ALL)"""


def area_sql(tops: list[int]) -> str:
    removals = "SELECT 0 AS id, NULL AS b, NULL AS q UNION ALL SELECT row_number() OVER (ORDER BY lang), lang, NULL FROM (SELECT DISTINCT lang FROM sc)"
    return f"""WITH {SCORES}, {LONG}, gl AS (SELECT *, {GOLD} FROM lg WHERE score IS NOT NULL), {_areas("gl", removals, "b IS NULL OR lang <> b", tops)},
j AS (SELECT a.method, w.area AS stat, a.area AS lft, w.n / (w.n - a.n) AS h, w.n > a.n AND a.n > 0 AS ok FROM ar a JOIN ar w ON w.id = 0 AND a.id > 0 AND a.method = w.method),
s AS (SELECT method, {SPREAD} FROM j GROUP BY 1)
SELECT method, round(stat, 6) AS area, round(lo, 6) AS ci_lower, round(hi, 6) AS ci_upper, round({SD}, 6) AS jackknife_sd, n_blocks FROM s"""


def contribution_sql(tops: list[int]) -> str:
    removals = "SELECT row_number() OVER () AS id, b, q FROM (SELECT NULL AS b UNION ALL SELECT DISTINCT lang FROM sc), (SELECT NULL AS q UNION ALL SELECT * FROM (VALUES ('0'), ('1'), ('2')))"
    return f"""WITH {SCORES}, gl AS (SELECT *, 'm1' AS method, m1 AS score, CAST(doc_id % 3 AS VARCHAR) AS bin, {GOLD} FROM sc WHERE m1 IS NOT NULL), {_areas("gl", removals, "(b IS NULL OR lang <> b) AND (q IS NULL OR bin <> q)", tops)},
g AS (SELECT x.b, x.q AS bin, w.area - x.area AS gain FROM ar x JOIN ar w ON w.q IS NULL AND x.q IS NOT NULL AND x.b IS NOT DISTINCT FROM w.b)
SELECT bin, round(max(gain) FILTER (b IS NULL), 6) + 0.0 AS contribution, round(stddev_samp(gain) FILTER (b IS NOT NULL) * sqrt(count(gain) FILTER (b IS NOT NULL) - 1), 6) AS se FROM g GROUP BY 1"""


JACKKNIFE_SQL: dict[str, str] = {"odds_ratio_jackknife": odds_sql([40, 80, 160], 0.5), "enrichment_area_jackknife": area_sql([10, 20, 40, 70]), "bin_contributions": contribution_sql([10, 20, 40, 70])}
