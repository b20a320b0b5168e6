"""DuckDB SQL of agreement between data sets and of the bootstrapped formula."""

from __future__ import annotations

from .model_sql import solved
from .oracles import draw

SETS = """ls AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS d, CAST(l_partkey % 200 AS VARCHAR) || ';' || CAST(l_suppkey % 20 AS VARCHAR) AS link, bool_or(l_quantity > 40) AS pos FROM lineitem GROUP BY ALL),
pc AS (SELECT x.d AS a, y.d AS b, count(*) AS common, count(*) FILTER (x.pos AND y.pos) AS pos_both, count(*) FILTER (x.pos) AS pos_any, count(*) FILTER (y.pos) AS any_pos FROM ls x JOIN ls y ON x.link = y.link AND x.d <= y.d GROUP BY ALL)"""
#: Upper tail of the normal distribution at x, from its rational approximation and, beyond, its continued fraction.
TAIL = """CASE WHEN x > 37 THEN 0 WHEN x < 7.07106781186547 THEN exp(-x * x / 2) * ((((((3.52624965998911e-2 * x + 0.700383064443688) * x + 6.37396220353165) * x + 33.912866078383) * x + 112.079291497871) * x + 221.213596169931) * x + 220.206867912376) / (((((((8.83883476483184e-2 * x + 1.75566716318264) * x + 16.064177579207) * x + 86.7807322029461) * x + 296.564248779674) * x + 637.333633378831) * x + 793.826512519948) * x + 440.413735824752) ELSE 0 END"""


def matrix_sql() -> str:
    cell = lambda seen, row, col: f"(abs({seen} - {row} * {col} / t) - least(abs({seen} - {row} * {col} / t), 0.5)) ** 2 / ({row} * {col} / t)"
    chi = " + ".join(cell(*c) for c in (("n3", "(n3 + n4)", "(n3 + n2)"), ("n4", "(n3 + n4)", "(n4 + n1)"), ("n2", "(n2 + n1)", "(n3 + n2)"), ("n1", "(n2 + n1)", "(n4 + n1)")))
    return f"""WITH {SETS}, c AS (SELECT a, b, pos_both::DOUBLE AS n3, (any_pos - pos_both)::DOUBLE AS n4, (pos_any - pos_both)::DOUBLE AS n2, common::DOUBLE AS n1 FROM pc WHERE a < b),
s AS (SELECT *, n1 + n2 + n3 + n4 AS t, CASE WHEN least(n1, n2, n3, n4) = 0 THEN 0.5 ELSE 0 END AS h FROM c), q AS (SELECT a, b, (n3 + h) * (n1 + h) / ((n4 + h) * (n2 + h)) AS o, {chi} AS chi FROM s), p AS (SELECT *, sqrt(chi) AS x FROM q)
SELECT a, b, round(o, 6) AS odds_ratio, round(chi, 6) AS chi_squared, round(2 * ({TAIL}), 6) AS p_value FROM p"""


def formula_sql(n: int, seed: int) -> str:
    z = ("1.0", "x", "k", "x * k")
    names = ("Intercept", "size", "kind[late]", "size:kind[late]")
    p = len(z)
    products = ", ".join([f"sum({z[i]} * {z[j]}) AS h{i}{j}" for i in range(p) for j in range(i, p)] + [f"sum({z[i]} * y) AS g{i}" for i in range(p)])
    sums = ", ".join([f"sum(times * h{i}{j}) AS h{i}{j}" for i in range(p) for j in range(i, p)] + [f"sum(times * g{i}) AS g{i}" for i in range(p)])
    long = " UNION ALL ".join(f"SELECT rep, '{name}' AS term, x{i} AS v FROM so" for i, name in enumerate(names))
    return f"""WITH r AS (SELECT p_brand AS d, p_retailprice / 100 AS y, p_size / 10.0::DOUBLE AS x, CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0.0 END AS k FROM part),
gm AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS pos, {products} FROM r GROUP BY d), m AS (SELECT count(*) AS m FROM gm),
ht AS (SELECT rep, {draw("pos", "rep", seed)} % (SELECT m FROM m) AS pos, count(*) AS times FROM gm, (SELECT unnest(range(1, {n} + 1)) AS rep) GROUP BY ALL UNION ALL SELECT 0, pos, 1 FROM gm),
tt AS (SELECT rep, {sums} FROM ht JOIN gm USING (pos) GROUP BY 1), so AS (SELECT * FROM {solved(p, "tt", "rep")}), lo AS ({long})
SELECT term, round(max(v) FILTER (rep = 0), 5) + 0.0 AS estimate, round(stddev_samp(v) FILTER (rep > 0), 5) AS bootstrap_sd, round(quantile_cont(v, 0.025) FILTER (rep > 0), 5) + 0.0 AS ci_lower, round(quantile_cont(v, 0.975) FILTER (rep > 0), 5) + 0.0 AS ci_upper,
 round(least(1.0, 2 * least(avg(CAST(v <= 0 AS INTEGER)) FILTER (rep > 0), avg(CAST(v >= 0 AS INTEGER)) FILTER (rep > 0))), 5) AS p_value FROM lo GROUP BY 1"""


AGREEMENT_SQL: dict[str, str] = {"dataset_agreement": f"WITH {SETS} SELECT * FROM pc", "dataset_odds_matrix": matrix_sql(), "formula_bootstrap": formula_sql(200, 4)}
