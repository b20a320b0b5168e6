"""DuckDB SQL of the count regressions: negative binomial with offset and batch, covariates, and joint fits of slope and dispersion."""

from __future__ import annotations

from .oracles import base


def total(term: str, of: str = "l") -> str:
    return f"list_sum(list_transform({of}, lambda q: {term}))"


def batch_rounds(name: str, source: str, alpha: str, rounds: int = 60) -> str:
    """One coefficient for each (feature, batch): with an intercept and all batches, regressions of the batches have nothing in common."""
    mu = "exp(greatest(least(b + q.o, 80), -80))"
    score, info = total(f"(q.y - {mu}) / (1 + {alpha} * {mu})"), total(f"{mu} / (1 + {alpha} * {mu})")
    return f"""{name}_i AS (SELECT feature_id, batch, alpha, l, 0 AS i, 0.0::DOUBLE AS b, 1.0::DOUBLE AS d FROM {source}
 UNION ALL SELECT feature_id, batch, alpha, l, i + 1, b + d2, d2 FROM (SELECT *, greatest(least({score} / {info}, 5), -5) AS d2 FROM {name}_i WHERE i < {rounds} AND abs(d) > 1e-10)),
{name} AS (SELECT feature_id, batch, any_value(alpha) AS alpha, arg_max(b, i) AS b FROM {name}_i GROUP BY ALL)"""


def residual_sql() -> str:
    mu = "exp(greatest(least(b + o, 80), -80))"
    f, slope = total("((q.y - q.mu) ** 2) / (q.mu + a * q.mu * q.mu)"), total("0 - ((q.y - q.mu) ** 2) * q.mu * q.mu / ((q.mu + a * q.mu * q.mu) ** 2)")
    return base() + f""", dp AS (SELECT c.cell_id, ln(greatest(coalesce(sum(value), 0), 1)) AS o, batch % 3 AS batch FROM cells c LEFT JOIN y USING (cell_id) GROUP BY ALL),
co AS (SELECT cell_id, batch, o - avg(o) OVER () AS o FROM dp),
fu AS MATERIALIZED (SELECT f.feature_id, c.cell_id, c.batch, c.o, coalesce(y.value, 0) AS y FROM (SELECT DISTINCT feature_id FROM y) f CROSS JOIN co c LEFT JOIN y ON y.feature_id = f.feature_id AND y.cell_id = c.cell_id),
g0 AS MATERIALIZED (SELECT feature_id, batch, 0.5::DOUBLE AS alpha, list({{'y': y, 'o': o}}) AS l FROM fu GROUP BY ALL),
{batch_rounds("f0", "g0", "alpha")},
m0 AS MATERIALIZED (SELECT feature_id, list({{'y': y, 'mu': {mu}}}) AS l, count(*) - 3 AS df FROM fu JOIN f0 USING (feature_id, batch) GROUP BY 1),
al_i AS (SELECT feature_id, l, df, 0 AS i, 0.0::DOUBLE AS a, 1.0::DOUBLE AS d FROM m0
 UNION ALL SELECT feature_id, l, df, i + 1, a + d2, d2 FROM (SELECT *, CASE WHEN i = 0 AND f <= df THEN NULL ELSE (f - df) * f / (-s * df) END AS d2 FROM (SELECT *, {f} AS f, {slope} AS s FROM al_i WHERE i < 60 AND abs(d) > 1e-13))),
al AS (SELECT feature_id, coalesce(arg_max(a, i) FILTER (a IS NOT NULL AND i > 0), greatest({total("(q.y - q.mu) ** 2 - q.mu", "any_value(l)")} / ({total("q.mu * q.mu", "any_value(l)")} + 1e-12), 0)) AS alpha FROM al_i GROUP BY 1),
g1 AS MATERIALIZED (SELECT feature_id, batch, al.alpha, l FROM g0 JOIN al USING (feature_id)),
{batch_rounds("f1", "g1", "alpha")},
fi AS (SELECT feature_id, batch, al.alpha, CASE WHEN al.alpha > 0 THEN f1.b ELSE f0.b END AS b FROM f0 JOIN f1 USING (feature_id, batch) JOIN al USING (feature_id)),
rs AS (SELECT cell_id, feature_id, {mu} AS mu, alpha, y FROM fu JOIN fi USING (feature_id, batch))
SELECT cell_id, feature_id, round(mu, 4) + 0.0 AS mu, round(alpha, 5) + 0.0 AS alpha, round(greatest(least((y - mu) / sqrt(greatest(mu + alpha * mu * mu, 1e-8)), 10), -10), 4) + 0.0 AS residual FROM rs"""


def solved(p: int, source: str, keep: str) -> str:
    """Selects the solution x0.. of the symmetric system h_ij x = g_i, and v1 of h v = (0, 1, 0, ...), by elimination."""
    rows = [[f"h{min(i, j)}{max(i, j)}" for j in range(p)] + [f"g{i}", "1.0" if i == 1 else "0.0"] for i in range(p)]
    name = lambda i, j: f"e{i}_{j}"
    sql = f"(SELECT {keep}, " + ", ".join(f"{rows[i][j]}::DOUBLE AS {name(i, j)}" for i in range(p) for j in range(p + 2)) + f" FROM {source})"
    for k in range(p):
        cells = [f"{name(i, j)} - {name(i, k)} / {name(k, k)} * {name(k, j)} AS {name(i, j)}" if i > k and j >= k else name(i, j) for i in range(p) for j in range(p + 2)]
        sql = f"(SELECT {keep}, {', '.join(cells)} FROM {sql})"
    for tag, column in (("x", p), ("v", p + 1)):
        for i in reversed(range(p)):
            rest = "".join(f" - {name(i, j)} * {tag}{j}" for j in range(i + 1, p))
            sql = f"(SELECT *, ({name(i, column)}{rest}) / {name(i, i)} AS {tag}{i} FROM {sql})"
    return sql


def covariate_sql(rounds: int = 30) -> str:
    p = 4
    z = ("1.0", "q.x", "q.c", "q.d")
    mu = "exp(greatest(least(b0 + b1 * q.x + b2 * q.c + b3 * q.d, 80), -80))"
    sums = ", ".join([f"{total(f'(q.y - {mu}) * {z[i]}')} AS g{i}" for i in range(p)] + [f"{total(f'{mu} * {z[i]} * {z[j]}')} AS h{i}{j}" for i in range(p) for j in range(i, p)])
    keep = "link_id, l, i, b0, b1, b2, b3"
    stepped = solved(p, f"(SELECT {keep}, {sums} FROM it WHERE i < {rounds})", keep)
    cut = lambda k: f"b{k} + greatest(least(x{k}, 5), -5)"
    return base() + f""", ls AS MATERIALIZED (SELECT p.link_id, list({{'x': coalesce(a.value, 0), 'y': coalesce(b.value, 0), 'c': balance / 10000, 'd': CAST(batch % 2 AS DOUBLE)}}) AS l FROM prs p CROSS JOIN cells c LEFT JOIN x a ON a.cell_id = c.cell_id AND a.feature_id = p.x_id LEFT JOIN y b ON b.cell_id = c.cell_id AND b.feature_id = p.y_id GROUP BY 1),
it AS (SELECT link_id, l, 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3 FROM ls
 UNION ALL SELECT link_id, l, i + 1, {cut(0)}, {cut(1)}, {cut(2)}, {cut(3)} FROM {stepped}),
la AS (SELECT {keep} FROM it WHERE i = {rounds}),
en AS (SELECT * FROM {solved(p, f"(SELECT {keep}, {sums} FROM la)", keep)})
SELECT link_id, round(b1, 5) + 0.0 AS beta, round(sqrt(v1), 5) + 0.0 AS se FROM en"""


def dispersion_sql(rounds: int = 80) -> str:
    """Differences of digamma and trigamma at whole distances are sums of reciprocals."""
    mu, r = "exp(greatest(least(b0 + b1 * q.x, 30), -80))", "exp(t)"
    up, up2 = f"list_sum(list_transform(range(CAST(q.y AS BIGINT)), lambda k: 1 / ({r} + k)))", f"list_sum(list_transform(range(CAST(q.y AS BIGINT)), lambda k: -1 / ({r} + k) ** 2))"
    w, u = f"q.n * {mu} * {r} / ({r} + {mu})", f"q.n * (q.y - {mu}) * {r} / ({r} + {mu})"
    terms = {"g0": u, "g1": f"q.x * {u}", "h00": w, "h01": f"q.x * {w}", "h11": f"q.x * q.x * {w}", "l1": f"q.n * (coalesce({up}, 0) - ln(1 + {mu} / {r}) + ({mu} - q.y) / ({r} + {mu}))", "l2": f"q.n * (coalesce({up2}, 0) + {mu} / ({r} * ({r} + {mu})) + (q.y - {mu}) / (({r} + {mu}) ** 2))"}
    sums = ", ".join(f"{total(v)} AS {k}" for k, v in terms.items())
    det = "greatest(h00 * h11 - h01 * h01, 1e-12)"
    bend = f"({r} * {r} * l2 + {r} * l1)"
    return base() + f""", hs AS (SELECT p.link_id, coalesce(a.value, 0) AS xv, coalesce(b.value, 0) AS yv, CAST(count(*) AS DOUBLE) AS n FROM prs p CROSS JOIN cells c LEFT JOIN x a ON a.cell_id = c.cell_id AND a.feature_id = p.x_id LEFT JOIN y b ON b.cell_id = c.cell_id AND b.feature_id = p.y_id GROUP BY ALL),
hh AS MATERIALIZED (SELECT link_id, list({{'x': xv, 'y': yv, 'n': n}}) AS l, ln(sum(n * yv) / sum(n)) AS b0 FROM hs GROUP BY 1 HAVING sum(yv) > 0),
it AS (SELECT link_id, l, 0 AS i, b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS t FROM hh
 UNION ALL SELECT link_id, l, i + 1, b0 + greatest(least((h11 * g0 - h01 * g1) / {det}, 5), -5), b1 + greatest(least((h00 * g1 - h01 * g0) / {det}, 5), -5),
  greatest(least(t + greatest(least(CASE WHEN {bend} < 0 THEN -({r} * l1) / {bend} ELSE sign(l1) END, 2), -2), 18), -12) FROM (SELECT *, {sums} FROM it WHERE i < {rounds})),
en AS (SELECT link_id, b0, b1, t, {sums} FROM it WHERE i = {rounds})
SELECT link_id, round(b0, 5) + 0.0 AS b0, round(b1, 5) + 0.0 AS b1, round(exp(-t), 5) + 0.0 AS alpha, round(CASE WHEN h00 * h11 - h01 * h01 > 1e-12 THEN sqrt(h00 / (h00 * h11 - h01 * h01)) END, 5) + 0.0 AS se FROM prs LEFT JOIN en USING (link_id)"""


MODEL_SQL: dict[str, str] = {"nb_residuals": residual_sql(), "poisson_multi_irls": covariate_sql(), "negative_binomial_pairs": dispersion_sql()}
