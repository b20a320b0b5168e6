"""DuckDB SQL of the text evaluation."""

from __future__ import annotations

from spanloom.plans.oracles import CURVE

BY = "kind, stratum, method"


def evaluation_sql(config: dict, digits: int) -> str:
    """Scores of every text, strata with enough support, and three metrics of each method in each."""
    mark = r"[^A-Za-z0-9\x20\x09-\x0D\x{80}-\x{10FFFF}]"
    length = " + ".join(f"CASE WHEN words > {e} THEN 1 ELSE 0 END" for e in config["word_edges"])
    r = lambda e, name: f"round({e}, {digits}) + 0.0 AS {name}"
    return rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, lang, source, CAST(coalesce(len(w), 0) AS BIGINT) AS words, CASE WHEN len(w) > 0 THEN (len(w) - len(list_distinct(w))) / len(w) END AS repeats,
  CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '{mark}')) / length(text) END AS marks, CASE WHEN text IS NOT NULL THEN 1 / (len(w) + 1) END AS brevity FROM d),
b AS (SELECT doc_id, min(lang) AS lang, min(source) AS source, max(words) AS words, min(repeats) AS repeats, min(marks) AS marks, min(brevity) AS brevity FROM s GROUP BY 1),
l AS (SELECT doc_id, bool_or(quality >= {config["label_threshold"]}) AS label FROM labels WHERE quality IS NOT NULL GROUP BY 1),
j AS (SELECT * FROM b JOIN l USING (doc_id)),
k AS (SELECT *, 'all' AS kind, '' AS stratum FROM j UNION ALL SELECT *, 'lang', lang FROM j UNION ALL SELECT *, 'source', source FROM j UNION ALL SELECT *, 'length', CAST({length} AS VARCHAR) FROM j),
u AS (SELECT * FROM k QUALIFY count(*) OVER (PARTITION BY kind, stratum) >= {config["least_rows"]} AND count(*) FILTER (label) OVER (PARTITION BY kind, stratum) >= {config["least_gold"]}),
lg AS (SELECT doc_id, label, kind, stratum, 'repeats' AS method, repeats AS score FROM u UNION ALL SELECT doc_id, label, kind, stratum, 'marks', marks FROM u UNION ALL SELECT doc_id, label, kind, stratum, 'brevity', brevity FROM u),
{CURVE.format(t="lg", p=f"PARTITION BY {BY}", s="score")},
x AS (SELECT {BY}, recall AS x, enrichment * (1 - recall) AS yw, 1 - recall AS w, lag(recall) OVER o AS px, lag(enrichment * (1 - recall)) OVER o AS pyw, lag(1 - recall) OVER o AS pw, row_number() OVER o AS i, count(*) OVER (PARTITION BY {BY}) AS m FROM c WINDOW o AS (PARTITION BY {BY} ORDER BY linked)),
a AS (SELECT {BY}, any_value(m) AS m, sum(CASE WHEN i = 1 THEN x * yw ELSE (x - px) * (yw + pyw) / 2 END) + sum(CASE WHEN i = m THEN (1 - x) * yw ELSE 0 END) AS area, sum(CASE WHEN i = 1 THEN x * w ELSE (x - px) * (w + pw) / 2 END) + sum(CASE WHEN i = m THEN (1 - x) * w ELSE 0 END) AS mass FROM x GROUP BY ALL),
q AS (SELECT {BY}, k, ln((gold + 0.5) * (n - k - g + gold + 0.5) / ((k - gold + 0.5) * (g - gold + 0.5))) AS v FROM w WHERE g > 0 AND g < n AND k <= g AND k <= floor(n * 0.99)),
z AS (SELECT {BY}, k, v / k AS y, 1 / k AS w, lag(k) OVER o AS pk, lag(v / k) OVER o AS py, lag(1 / k) OVER o AS pw FROM q WINDOW o AS (PARTITION BY {BY} ORDER BY k)),
o AS (SELECT {BY}, sum((k - pk) * (y + py)) / sum((k - pk) * (w + pw)) AS auorc FROM z GROUP BY ALL),
lv AS (SELECT {BY}, -score AS s, count(*) AS c, count(*) FILTER (label) AS p FROM lg WHERE score IS NOT NULL GROUP BY ALL),
cu AS (SELECT {BY}, p, sum(c) OVER v AS n, sum(p) OVER v AS tp, sum(p) OVER (PARTITION BY {BY}) AS g FROM lv WINDOW v AS (PARTITION BY {BY} ORDER BY s DESC RANGE UNBOUNDED PRECEDING)),
pa AS (SELECT {BY}, sum(p / g * (tp / n)) AS ap FROM cu GROUP BY ALL),
t AS (SELECT {BY}, count(*) AS n, count(*) FILTER (label) AS n_gold FROM lg GROUP BY ALL)
SELECT {BY}, n, n_gold, CASE WHEN m >= 2 AND mass <> 0 THEN {r("area / mass", "auerc").replace(" AS auerc", "")} END AS auerc, {r("auorc", "auorc")}, {r("ap", "ap")} FROM t LEFT JOIN a USING ({BY}) LEFT JOIN o USING ({BY}) LEFT JOIN pa USING ({BY})"""
