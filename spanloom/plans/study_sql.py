"""DuckDB SQL of a whole association study: links, bins, controls, Poisson fits, p-values and false discovery rates."""

from __future__ import annotations

from ..operators.nulls import DRAWS, MORE_DRAWS
from .oracles import QCUT, SUMS, base, draw

#: Upper tail of the normal distribution for x = abs(z), e = exp(-z * z / 2), in the range that rounding doesn't make 0.
TAIL = """e * ((((((3.52624965998911e-2 * x + 0.700383064443688) * x + 6.37396220353165) * x + 33.912866078383) * x + 112.079291497871) * x + 221.213596169931) * x + 220.206867912376) / (((((((8.83883476483184e-2 * x + 1.75566716318264) * x + 16.064177579207) * x + 86.7807322029461) * x + 296.564248779674) * x + 637.333633378831) * x + 793.826512519948) * x + 440.413735824752)"""


def binned(table: str, main: int, nested: int) -> str:
    t = table
    return f"""{t}_m AS (SELECT feature_id, sum(value) / any_value(n) AS mean, sum(value * value) / any_value(n) - (sum(value) / any_value(n)) * (sum(value) / any_value(n)) AS var FROM {t}, nc GROUP BY 1),
{t}_k AS (SELECT *, row_number() OVER (ORDER BY mean, feature_id) AS rk, count(*) OVER () AS n FROM {t}_m),
{t}_b AS (SELECT feature_id, var, CAST({QCUT.format(q=main)} AS INTEGER) AS mean_bin FROM {t}_k),
{t}_k2 AS (SELECT *, row_number() OVER (PARTITION BY mean_bin ORDER BY var, feature_id) AS rk, count(*) OVER (PARTITION BY mean_bin) AS n FROM {t}_b),
{t}_bin AS (SELECT feature_id AS id, mean_bin || '.' || CAST({QCUT.format(q=nested)} AS INTEGER) AS bin FROM {t}_k2),
{t}_pos AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY bin) AS n, min(id) OVER (PARTITION BY bin) AS lo FROM {t}_bin)"""


def drawn_pairs(per_bin: int, seed: int) -> str:
    many = f"an * bn > {2 * per_bin}"
    return f"""pb AS (SELECT a.bin AS ab, b.bin AS bb, a.n AS an, b.n AS bn, a.lo AS alo, b.lo AS blo FROM (SELECT DISTINCT bin, n, lo FROM x_pos) a, (SELECT DISTINCT bin, n, lo FROM y_pos) b),
tu AS (SELECT *, unnest(range(0, CASE WHEN {many} THEN {DRAWS * per_bin + MORE_DRAWS} ELSE an * bn END)) AS turn FROM pb),
ub AS (SELECT *, {draw("alo", "blo", seed)} AS base FROM tu),
lv AS (SELECT *, {draw("base", "turn", seed + 1)} AS lot, {draw("base", "turn", seed + 2)} AS lot2 FROM ub),
dr AS (SELECT ab, bb, CASE WHEN {many} THEN lot % an ELSE turn // bn END AS l, CASE WHEN {many} THEN lot2 % bn ELSE turn % bn END AS r, min(CASE WHEN {many} THEN turn ELSE lot * 16777216 + turn END) AS turn FROM lv GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY ab, bb ORDER BY turn) - 1 AS rk FROM dr),
cp AS (SELECT ab || '_' || bb AS grp, a.id AS x_id, b.id AS y_id FROM rk JOIN x_pos a ON a.bin = ab AND a.pos = l JOIN y_pos b ON b.bin = bb AND b.pos = r WHERE rk < {per_bin})"""


def fits(rounds: int = 100, tolerance: float = 1e-3, of: str = "", having: str = "") -> str:
    """Reweighted least squares with its stop rule, on a histogram for each pair, also within groups (``of``) of cells."""
    also, typed = (f"{of}, ", f"c.{of} AS {of}, ") if of else ("", "")
    mu = "least(exp(greatest(least(b0 + b1 * b.x, 80), -80)), 1e10)"
    eta = "greatest(least(b0 + b1 * b.x, 80), -80)"

    def total(term: str) -> str:
        return f"list_sum(list_transform(l, lambda b: {term}))"

    sums = f"""{total(f"b.n * {mu}")} AS w, {total(f"b.x * b.n * {mu}")} AS wx, {total(f"b.x * b.x * b.n * {mu}")} AS wxx, {total(f"b.n * {mu} * {eta} + b.y - b.n * {mu}")} AS wz, {total(f"b.x * (b.n * {mu} * {eta} + b.y - b.n * {mu})")} AS wxz"""
    return f"""pr AS (SELECT DISTINCT x_id, y_id FROM (SELECT x_id, y_id FROM lk UNION ALL SELECT x_id, y_id FROM cp)),
hs AS (SELECT x_id, y_id, {typed}coalesce(a.value, 0) AS xv, CAST(count(*) AS DOUBLE) AS n, sum(coalesce(b.value, 0)) AS yv FROM pr CROSS JOIN cells c LEFT JOIN x a ON a.cell_id = c.cell_id AND a.feature_id = x_id LEFT JOIN y b ON b.cell_id = c.cell_id AND b.feature_id = y_id GROUP BY ALL),
hh AS (SELECT x_id, y_id, {also}list({{'x': xv, 'n': n, 'y': yv}} ORDER BY xv) AS l FROM hs GROUP BY ALL{having}),
it AS (SELECT x_id, y_id, {also}l, 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, false AS done FROM hh
 UNION ALL
 SELECT x_id, y_id, {also}l, i + 1, n0, n1, abs(n0 - b0) < {tolerance} AND abs(n1 - b1) < {tolerance} FROM (
  SELECT *, (wxx * wz - wx * wxz) / greatest(w * wxx - wx * wx, 1e-8) AS n0, (w * wxz - wx * wz) / greatest(w * wxx - wx * wx, 1e-8) AS n1 FROM (SELECT *, {sums} FROM it WHERE i < {rounds} AND NOT done))),
la AS (SELECT x_id, y_id, {also}arg_max(l, i) AS l, arg_max(b0, i) AS b0, arg_max(b1, i) AS b1 FROM it GROUP BY ALL),
ft AS (SELECT x_id, y_id, {also}b1 AS beta, CASE WHEN w * wxx - wx * wx > 1e-8 THEN sqrt(w / (w * wxx - wx * wx)) END AS se FROM (SELECT *, {sums} FROM la))"""


def tested(value: str, tag: str) -> str:
    """Monte Carlo, pooled and z p-values of a column."""
    return f"""mc{tag} AS (SELECT link_id, CASE WHEN {value} IS NOT NULL THEN (1 + (SELECT count(*) FROM ct WHERE ct.grp = ci.grp AND ct.{value} >= ci.{value})) / (1.0 + (SELECT count(ct.{value}) FROM ct WHERE ct.grp = ci.grp)) END AS p FROM ci),
st{tag} AS (SELECT grp, avg({value}) AS m, stddev_pop({value}) AS s FROM ct GROUP BY 1),
ce{tag} AS (SELECT link_id, grp, ({value} - m) / s AS z FROM ci JOIN st{tag} USING (grp) WHERE s > 0 AND {value} IS NOT NULL),
cc{tag} AS (SELECT ({value} - m) / s AS z FROM ct JOIN st{tag} USING (grp) WHERE s > 0 AND {value} IS NOT NULL AND grp IN (SELECT grp FROM ce{tag})),
pp{tag} AS (SELECT link_id, (1 + (SELECT count(*) FROM cc{tag} c WHERE c.z >= o.z)) / (1.0 + (SELECT count(*) FROM cc{tag})) AS p FROM ce{tag} o),
zz{tag} AS (SELECT link_id, CASE WHEN s > 0 THEN ({value} - m) / s WHEN {value} > m THEN 'inf'::DOUBLE WHEN {value} < m THEN '-inf'::DOUBLE END AS z FROM ci LEFT JOIN st{tag} USING (grp)),
zq{tag} AS (SELECT link_id, CASE WHEN isinf(z) AND z > 0 THEN 0.0 WHEN isinf(z) THEN 1.0 WHEN z < 0 THEN 1 - q ELSE q END AS p FROM (SELECT *, {TAIL} AS q FROM (SELECT *, abs(z) AS x, exp(-z * z / 2) AS e FROM zz{tag})))"""


def study_sql(config: str, distance: int, seed: int, digits: int, chrom: bool = True) -> str:
    a, b, c, d, n = (int(k) for k in config.split("."))
    r = lambda e, name: f"round({e}, {digits}) + 0.0 AS {name}"
    return base(distance) + f""", {binned("x", a, b)}, {binned("y", c, d)},
lk AS (SELECT CAST(peak_id AS VARCHAR) || ';' || CAST(gene_id AS VARCHAR) AS link_id, peak_id AS x_id, gene_id AS y_id, xb.bin || '_' || yb.bin AS grp, greatest(0, {n} - xb.n * yb.n) AS ctrl_short FROM wl JOIN x_pos xb ON xb.id = peak_id JOIN y_pos yb ON yb.id = gene_id),
{drawn_pairs(n, seed)}, {fits()},
sd AS (SELECT *, CASE WHEN se <> 0 THEN greatest(least(beta / se, 100), -100) END AS stud FROM ft),
ci AS MATERIALIZED (SELECT lk.*, beta, se, stud FROM lk JOIN sd USING (x_id, y_id)), ct AS MATERIALIZED (SELECT cp.grp, beta, stud FROM cp JOIN sd USING (x_id, y_id)),
{tested("stud", "s")}, {tested("beta", "b")},
th AS (SELECT stud, count(*) AS c FROM ci WHERE stud IS NOT NULL GROUP BY 1),
fr AS (SELECT stud, least(1.0, ((SELECT count(*) FROM ct WHERE ct.stud >= th.stud) / (SELECT count(*) FROM ct)) / (sum(c) OVER (ORDER BY stud DESC) / sum(c) OVER ())) AS q FROM th),
fq AS (SELECT stud, min(q) OVER (ORDER BY stud) AS q FROM fr),
bq AS (SELECT link_id, least(1.0, min(q) OVER (ORDER BY p DESC, link_id DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (SELECT link_id, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, link_id) AS q FROM mcb WHERE p IS NOT NULL))
SELECT {"'chr' || CAST(x_id % 5 AS VARCHAR) AS chrom, " if chrom else ""}link_id, x_id, y_id, grp, CAST(ctrl_short AS BIGINT) AS ctrl_short, {r("beta", "beta")}, {r("se", "se")}, {r("stud", "stud")}, {r("mcs.p", "mcpval_z")}, {r("pps.p", "ppval_z")}, {r("zqs.p", "zpval_z")}, {r("mcb.p", "mcpval")}, {r("ppb.p", "ppval")}, {r("zqb.p", "zpval")}, {r("fq.q", "q_value")}, {r("bq.q", "bh_q")}
FROM ci LEFT JOIN mcs USING (link_id) LEFT JOIN pps USING (link_id) LEFT JOIN zqs USING (link_id) LEFT JOIN mcb USING (link_id) LEFT JOIN ppb USING (link_id) LEFT JOIN zqb USING (link_id) LEFT JOIN fq USING (stud) LEFT JOIN bq USING (link_id)"""


def by_type_sql(distance: int, digits: int) -> str:
    return base(distance) + f""", lk AS (SELECT CAST(peak_id AS VARCHAR) || ';' || CAST(gene_id AS VARCHAR) AS link_id, peak_id AS x_id, gene_id AS y_id FROM wl), cp AS (SELECT x_id, y_id FROM lk WHERE false),
{fits(of="celltype", having=" HAVING sum(n) >= 10")}
SELECT link_id, x_id, y_id, celltype, round(beta, {digits}) + 0.0 AS beta, round(se, {digits}) + 0.0 AS se FROM lk JOIN ft USING (x_id, y_id)"""


def one_sided_sql(main: int, controls: int, distance: int, digits: int, seed: int = 0) -> str:
    """Controls of the first side only, Pearson correlations, each link a group of its own; without standard errors nothing is studentised."""
    many = f"n - 1 > {2 * controls}"
    corr = "(coalesce(sxy, 0) / n - sx / n * (sy / n)) / sqrt(greatest(sxx / n - (sx / n) * (sx / n), 1e-8) * greatest(syy / n - (sy / n) * (sy / n), 1e-8))"
    r = lambda e, name: f"round({e}, {digits}) + 0.0 AS {name}"
    none = ", ".join(f"NULL::DOUBLE AS {c}" for c in ("se", "stud", "mcpval_z", "ppval_z", "zpval_z", "q_value"))
    return base(distance) + SUMS.format(x="x", y="y") + f""", {binned("x", main, 1)},
tu AS (SELECT *, unnest(range(0, CASE WHEN {many} THEN {DRAWS * controls + MORE_DRAWS} ELSE n - 1 END)) AS turn FROM x_pos WHERE n > 1), lt AS (SELECT *, {draw("id", "turn", seed)} AS lot FROM tu), pl AS (SELECT *, CASE WHEN {many} THEN lot % (n - 1) ELSE turn END AS place FROM lt),
dr AS (SELECT id, bin, place + CASE WHEN place >= pos THEN 1 ELSE 0 END AS spot, min(CASE WHEN {many} THEN turn ELSE lot * 16777216 + turn END) AS turn FROM pl GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn) - 1 AS rk FROM dr), cf AS (SELECT rk.id, p.id AS ctrl_id FROM rk JOIN x_pos p ON p.bin = rk.bin AND p.pos = spot WHERE rk < {controls}),
lk AS (SELECT CAST(peak_id AS VARCHAR) || ';' || CAST(gene_id AS VARCHAR) AS link_id, peak_id AS x_id, gene_id AS y_id, greatest(0, {controls} - (p.n - 1)) AS ctrl_short FROM wl JOIN x_pos p ON p.id = peak_id),
co AS (SELECT xs.x_id, ys.y_id, {corr} AS corr FROM xs CROSS JOIN ys LEFT JOIN xy ON xy.x_id = xs.x_id AND xy.y_id = ys.y_id, nc),
ci AS MATERIALIZED (SELECT lk.*, link_id AS grp, corr AS beta FROM lk JOIN co USING (x_id, y_id)), ct AS MATERIALIZED (SELECT link_id AS grp, corr AS beta FROM lk JOIN cf ON cf.id = lk.x_id JOIN co ON co.x_id = ctrl_id AND co.y_id = lk.y_id),
{tested("beta", "b")},
bq AS (SELECT link_id, least(1.0, min(q) OVER (ORDER BY p DESC, link_id DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (SELECT link_id, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, link_id) AS q FROM mcb WHERE p IS NOT NULL))
SELECT link_id, x_id, y_id, grp, CAST(ctrl_short AS BIGINT) AS ctrl_short, {r("beta", "beta")}, {none}, {r("mcb.p", "mcpval")}, {r("ppb.p", "ppval")}, {r("zqb.p", "zpval")}, {r("bq.q", "bh_q")} FROM ci LEFT JOIN mcb USING (link_id) LEFT JOIN ppb USING (link_id) LEFT JOIN zqb USING (link_id) LEFT JOIN bq USING (link_id)"""


GC = "gc AS (SELECT peak_id AS feature_id, peak_id * 37 % 101 / 101 AS gc FROM peaks)"


def gc_sql(main: int, nested: int, distance: int) -> str:
    return base() + f""", {GC}, m AS (SELECT feature_id, sum(value) / any_value(n) AS mean FROM x, nc GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY mean, feature_id) AS rk, count(*) OVER () AS n FROM m JOIN gc USING (feature_id)),
b AS (SELECT feature_id, gc, CAST({QCUT.format(q=main)} AS INTEGER) AS mean_bin FROM k), k2 AS (SELECT *, row_number() OVER (PARTITION BY mean_bin ORDER BY gc, feature_id) AS rk, count(*) OVER (PARTITION BY mean_bin) AS n FROM b),
p AS (SELECT DISTINCT peak_id FROM peaks, genes WHERE peak_id % 5 = gene_id % 5 AND peak_id * 1000 < gene_id * 2000 + {distance} AND greatest(gene_id * 2000 - {distance}, 0) < peak_id * 1000 + 300)
SELECT feature_id, mean_bin, mean_bin || '.' || CAST({QCUT.format(q=nested)} AS INTEGER) || '.' || CASE WHEN feature_id IN (SELECT peak_id FROM p) THEN '1' ELSE '0' END AS bin FROM k2"""


def whitened_gc_sql(main: int, nested: int) -> str:
    return base() + f""", {GC}, m AS (SELECT feature_id, gc, log10(sum(value) + 1e-10) AS t FROM x JOIN gc USING (feature_id) GROUP BY ALL), s AS (SELECT var_samp(t) AS a, covar_samp(t, gc) AS b, var_samp(gc) AS c FROM m),
z AS (SELECT feature_id, (t - b / sqrt(a) * z2) / sqrt(a) AS z1, z2 FROM (SELECT *, gc / sqrt(c - (b / sqrt(a)) * (b / sqrt(a))) AS z2 FROM m, s)),
k AS (SELECT *, row_number() OVER (ORDER BY z1, feature_id) AS rk, count(*) OVER () AS n FROM z), b AS (SELECT feature_id, z2, CAST({QCUT.format(q=main)} AS INTEGER) AS main_bin FROM k),
k2 AS (SELECT *, row_number() OVER (PARTITION BY main_bin ORDER BY z2, feature_id) AS rk, count(*) OVER (PARTITION BY main_bin) AS n FROM b) SELECT feature_id, main_bin, main_bin || '.' || CAST({QCUT.format(q=nested)} AS INTEGER) AS bin FROM k2"""


STUDY_SQL: dict[str, str] = {"association_study": study_sql("3.2.3.2.20", 3000, 0, 5, chrom=False), "association_by_celltype": by_type_sql(1000, 5), "one_sided_association": one_sided_sql(3, 5, 3000, 5), "mean_gc_bins": gc_sql(4, 2, 700), "whitened_gc_bins": whitened_gc_sql(4, 2)}
