"""DuckDB SQL for the queries that SQL can express, with the parameters of the operators filled in.

Approximate neighbours, token counts, span classifiers, importance weights and randomness tests are
beyond SQL and tested against brute force in ``tests/llm`` instead; the Jaccard join is too slow in
SQL on whole tables.
"""

from __future__ import annotations

from . import codes, contamination, mixing, topk, urls, warc

WORD = r"[^\x20\x09-\x0D]+"


def mixing_sql() -> str:
    """Water filling by the level at which sources are capped, and the hash threshold by a sorted running sum.

    A source's threshold takes rows in order of hash while that brings the sum nearer to the budget.
    """
    return f"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(sha256('mix' || doc_id), 1, 12) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, {mixing.MOST_COPIES}.0::DOUBLE * source_size AS cap FROM s),
b AS (SELECT sum(source_size) * {mixing.TOTAL_PERCENT} / 100 AS budget FROM w),
l AS (SELECT a.source, a.cap / a.w AS edge, sum(CASE WHEN o.cap / o.w < a.cap / a.w THEN o.cap ELSE 0 END) AS fixed, sum(CASE WHEN o.cap / o.w >= a.cap / a.w THEN o.w ELSE 0 END) AS rest FROM w a, w o GROUP BY ALL),
v AS (SELECT arg_min((budget - fixed) / rest, edge) FILTER ((budget - fixed) / rest <= edge) AS level FROM l, b),
t AS (SELECT source, source_size, least(cap, level * w) AS target FROM w, v),
n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base FROM t),
r AS (SELECT d.doc_id, d.source, d.size, d.h, n.source_size, n.target, n.base, n.target - n.base * n.source_size AS budget, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.h) AS own FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target, CAST((base + CASE WHEN upto <= budget OR (upto - own <= budget AND (budget - (upto - own)) * 2 >= own AND budget > 0) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r"""


def decontamination_sql() -> str:
    words = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    n = contamination.WINDOW
    return f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item, least(len(w), {n}) AS k, array_to_string(list_slice(w, p, p + least(len(w), {n}) - 1), ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {n} + 1, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({words.format('text')}, []) AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
g AS (SELECT doc_id, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g FROM x, (SELECT DISTINCT k FROM i) WHERE p + k - 1 <= len(w)),
m AS (SELECT DISTINCT g.doc_id, g.p, g.k, i.item FROM g JOIN i ON g.k = i.k AND g.g = i.g),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def warc_sql() -> str:
    def sq(x: str) -> str:
        return x.replace("'", "''")

    names = "MAP {" + ", ".join(f"'{n}': '{sq(c)}'" for n, c in warc.REFERENCES.items()) + "}"
    number = "CASE WHEN c BETWEEN 1 AND 1114111 AND NOT c BETWEEN 55296 AND 57343 THEN chr(c::INTEGER) ELSE chr(65533) END"

    def decoded(x: str) -> str:
        """Every character reference in turn, by the pieces between them."""
        one = f"CASE WHEN r[2] = '#' THEN list_transform([CAST(CASE WHEN lower(r[3]) = 'x' THEN '0x' || r[4:-2] ELSE r[3:-2] END AS BIGINT)], lambda c: {number})[1] ELSE coalesce(map_extract({names}, r[2:-2])[1], r) END"
        return f"CASE WHEN regexp_matches({x}, '{warc.REFERENCE}') THEN array_to_string(list_transform(list_zip(string_split_regex({x}, '{warc.REFERENCE}'), list_concat(list_transform(regexp_extract_all({x}, '{warc.REFERENCE}'), lambda r: {one}), [''])), lambda p: p[1] || p[2]), '') ELSE {x} END"

    def squeezed(x: str) -> str:
        return rf"trim(regexp_replace({x}, '[ \t\n\r\f]+', ' ', 'g'), ' ')"

    def rid(x: str) -> str:
        h = f"sha256({x})"
        return f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"

    crlf = "chr(13) || chr(10)"
    return f"""WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
r AS (SELECT *, {rid("'response:' || page_id || ':' || target_uri")} AS refers_to, 'sha256:' || sha256(payload) AS source_digest, {squeezed(decoded(f"regexp_replace(payload, '{sq(warc.MARKUP)}', ' ', 'g')"))} AS text, {squeezed(decoded(f"regexp_extract(payload, '{sq(warc.TITLE)}', 1)"))} AS title, strlen(payload) AS n FROM p),
k AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, 'source-payload-digest: ' || source_digest || {crlf} || 'source-payload-length: ' || n || {crlf} || 'title: ' || title || {crlf} || 'text-digest: sha256:' || sha256(text) || {crlf} || 'source-headers: HTTP/1.1 200 OK | Content-Type: text/html; charset=utf-8 | Content-Length: ' || n || {crlf} AS block FROM r
 UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', text FROM r)
SELECT page_id, record_type, {rid("record_type || ':' || refers_to")} AS record_id, refers_to, target_uri, '{warc.EPOCH}' AS date, content_type, strlen(block) AS content_length, 'sha256:' || sha256(block) AS block_digest, source_digest, block FROM k"""


def url_sql() -> str:
    """The language models too: counts, interpolated probabilities, whole millionths, the calibrated bucket."""
    a, kappa, unit = len(urls.ALPHABET), urls.KAPPA, urls.UNIT
    rule, verdict = "NULL", "NULL"
    for said, text in sorted(urls.RULES, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}'))"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{said}' ELSE {verdict} END"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH u AS (SELECT page_id, url, {lower.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
  CAST('0x' || substr(sha256('url' || host), 1, 12) AS BIGINT) % {urls.HELD_OUT} = 0 AS held, regexp_replace(translate({lower.format("coalesce(url, '')")}, '123456789', '000000000'), '[^a-z0./:_?=&#%+~-]', '~', 'g') AS norm FROM pages),
r AS (SELECT *, {rule} AS rule, {verdict} AS ruled, row_number() OVER () AS id FROM u),
g AS (SELECT id, ruled, held, instr('{urls.ALPHABET}', substr(s, p, 1)) - 1 AS x, instr('{urls.ALPHABET}', substr(s, p + 1, 1)) - 1 AS y, instr('{urls.ALPHABET}', substr(s, p + 2, 1)) - 1 AS z FROM (SELECT id, ruled, held, '^^' || norm AS s, unnest(range(1, length(norm) + 1)) AS p FROM r)),
c AS (SELECT x, y, z, count(*) FILTER (ruled = 'allow') AS acc, count(*) FILTER (ruled = 'block') AS rej FROM g WHERE ruled IS NOT NULL AND NOT held GROUP BY ALL),
gr AS (SELECT a.x, b.y, d.z, coalesce(acc, 0) AS acc, coalesce(rej, 0) AS rej FROM (SELECT unnest(range(0, {a})) AS x) a, (SELECT unnest(range(0, {a})) AS y) b, (SELECT unnest(range(0, {a})) AS z) d LEFT JOIN c ON c.x = a.x AND c.y = b.y AND c.z = d.z),
n AS (SELECT x, y, z, acc, rej, {", ".join(f"sum({k}) OVER (PARTITION BY x, y) AS {k}_xy, sum({k}) OVER (PARTITION BY y, z) AS {k}_yz, sum({k}) OVER (PARTITION BY y) AS {k}_y, sum({k}) OVER (PARTITION BY z) AS {k}_z, sum({k}) OVER () AS {k}_n" for k in ("acc", "rej"))} FROM gr),
q AS (SELECT x, y, z, {", ".join(f"({k} + {kappa}::DOUBLE * (({k}_yz + {kappa}::DOUBLE * (({k}_z + 1.0::DOUBLE) / CAST({k}_n + {a} AS DOUBLE))) / ({k}_y + {kappa}::DOUBLE))) / ({k}_xy + {kappa}::DOUBLE) AS p_{k}" for k in ("acc", "rej"))} FROM n),
lr AS (SELECT x, y, z, CAST(round((ln(p_acc) - ln(p_rej)) * {unit}) AS BIGINT) AS lr FROM q),
sc AS (SELECT id, CAST(floor(sum(lr) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS units FROM g JOIN lr USING (x, y, z) GROUP BY 1),
f AS (SELECT r.*, coalesce(units, 0) AS units, greatest(-{urls.FURTHEST}, least({urls.FURTHEST}, CAST(floor(coalesce(units, 0) / {urls.BUCKET}.0::DOUBLE) AS BIGINT))) AS bucket FROM r LEFT JOIN sc USING (id)),
h AS (SELECT bucket, sum(k) OVER (ORDER BY bucket) AS upto, sum(k) OVER () AS total FROM (SELECT bucket, count(*) FILTER (ruled = 'allow') AS k FROM f WHERE ruled IS NOT NULL AND held GROUP BY 1)),
cut AS (SELECT CASE WHEN min(bucket) FILTER (upto * 100 > total * {urls.LOSS_PERCENT}) < 0 THEN min(bucket) FILTER (upto * 100 > total * {urls.LOSS_PERCENT}) WHEN min(bucket) FILTER (upto * 100 > total * {urls.LOSS_PERCENT}) >= 0 THEN 0 END AS cut FROM h WHERE total > 0)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN bucket < cut THEN 'block' ELSE 'allow' END) AS verdict, units / {unit}.0::DOUBLE AS score FROM f, cut"""


FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


def codes_sql() -> str:
    """The rounds one after the other: every part against every entry, and means of the parts of each entry."""
    n, units = codes.PARTS, codes.UNITS
    rounds = []
    for r in range(codes.ROUNDS + 1):
        rounds.append(f"a{r} AS MATERIALIZED (SELECT rid, p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {codes.ENTRIES} + s) AS best FROM p JOIN b{r} USING (p) GROUP BY ALL)")
        rounds.append(f"m{r} AS (SELECT p, s, j, CAST(floor(sum(y)::DOUBLE / count(*)) AS BIGINT) AS y FROM (SELECT p, best % {codes.ENTRIES} AS s, unnest(x) AS y, unnest(range(len(x))) AS j FROM a{r} JOIN p USING (rid, p)) GROUP BY ALL)")
        rounds.append(f"b{r + 1} AS MATERIALIZED (SELECT p, s, coalesce(n, c) AS c FROM b{r} LEFT JOIN (SELECT p, s, list(y ORDER BY j) AS n FROM m{r} GROUP BY ALL) USING (p, s))")
    last = codes.ROUNDS
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({units} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE {FINITE}),
p AS MATERIALIZED (SELECT rid, p, v[p * len(v) // {n} + 1 : (p + 1) * len(v) // {n}] AS x FROM k, (SELECT unnest(range({n})) AS p)),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS s, x AS c FROM p WHERE rid <= {codes.ENTRIES}),
{", ".join(rounds[:-2])},
h AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, s, j)) AS codebooks_sha256 FROM (SELECT p, s, unnest(c) AS y, unnest(range(len(c))) AS j FROM b{last})),
e AS (SELECT vec_id, label, string_agg(lpad(to_hex(best % {codes.ENTRIES}), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best // {codes.ENTRIES}) AS BIGINT) AS error FROM k JOIN a{last} USING (rid) GROUP BY rid, vec_id, label)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, h"""


def top_k_sql() -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({topk.UNITS} * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND {FINITE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {topk.EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {topk.BEST}"""


ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": url_sql(),
    "op2_warc_derivatives": warc_sql(),
    "op3_mixing": mixing_sql(),
    "op4_decontamination": decontamination_sql(),
    "op11_vector_codes": codes_sql(),
    "op12_exact_top_k": top_k_sql(),
}
