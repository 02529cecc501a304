"""SQL twins, for DuckDB, of the queries that SQL can express."""

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS gram
       FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS gram
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw USING (gram)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP6 = r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
h AS (SELECT doc_id, l, list_transform(l, lambda s: CAST('0x' || substr(md5(s), 1, 7) AS BIGINT)) AS h,
      list_transform(l, lambda s: length(s) - length(replace(s, ' ', '')) >= 49) AS g FROM d),
e AS (SELECT doc_id, l, g, list_filter(range(1, len(l) + 1), lambda i: i = len(l) OR (coalesce(h[CASE WHEN i > 1 THEN i - 1 END], 0) * 1009 + h[i]) % 4 <> 0
      OR g[i] OR coalesce(g[i + 1], FALSE)) AS e FROM h),
s AS (SELECT *, unnest(list_concat([1], list_transform(list_filter(e, lambda i: i < len(l)), lambda i: i + 1))) AS a FROM e),
c AS (SELECT doc_id, l, g, a, CASE WHEN u = len(l) - 1 AND NOT g[a] AND NOT g[len(l)] THEN len(l) ELSE u END AS b
      FROM (SELECT *, CASE WHEN g[a] THEN a ELSE coalesce(list_min(list_filter(e, lambda i: i > a)), len(l)) END AS u FROM s)),
o AS (SELECT doc_id, a, b, l[a:b] AS own, list_reverse(CASE WHEN a > 1 THEN l[greatest(a - 2, 1):a - 1] ELSE [] END) AS bef,
      CASE WHEN b < len(l) THEN l[b + 1:b + 2] ELSE [] END AS aft FROM c WHERE (b > a OR g[a]) AND trim(array_to_string(l[a:b], '')) <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY doc_id, a) AS nth, first_value(bef) OVER (PARTITION BY own ORDER BY doc_id, a) AS bef0,
      first_value(aft) OVER (PARTITION BY own ORDER BY doc_id, a) AS aft0 FROM o),
x AS (SELECT doc_id, a - list_min(list_filter(range(0, least(len(bef), len(bef0)) + 1), lambda i: i = least(len(bef), len(bef0)) OR bef[i + 1] <> bef0[i + 1])) AS lo,
      b + list_min(list_filter(range(0, least(len(aft), len(aft0)) + 1), lambda i: i = least(len(aft), len(aft0)) OR aft[i + 1] <> aft0[i + 1])) AS hi FROM r WHERE nth > 1),
n AS (SELECT doc_id, i, n, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
      SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(list_transform(l, lambda s: len(regexp_extract_all(s, '[^ \t\x0B\f\r]+')))) AS n FROM d) WHERE n > 0),
p AS (SELECT f.doc_id, f.i AS a, min(t.i) AS b FROM n f JOIN n t ON t.doc_id = f.doc_id AND t.i >= f.i AND t.upto - f.upto + f.n >= 50 GROUP BY 1, 2
      UNION SELECT t.doc_id, max(f.i), t.i FROM n f JOIN n t ON t.doc_id = f.doc_id AND t.i >= f.i AND t.upto - f.upto + f.n >= 50 GROUP BY 1, 3),
q AS (SELECT *, first_value(doc_id) OVER own AS doc0, first_value(a) OVER own AS a0 FROM (SELECT p.*, l[a:b] AS own FROM p JOIN d USING (doc_id)) WINDOW own AS (PARTITION BY own ORDER BY doc_id, a)),
y AS (SELECT doc_id, CASE WHEN doc_id = doc0 THEN greatest(a, a0 + b - a + 1) ELSE a END AS lo, b AS hi FROM q),
z AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(lo, hi + 1)) AS i FROM (SELECT * FROM x UNION ALL SELECT * FROM y WHERE lo <= hi)) GROUP BY 1)
SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(l) END AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       CASE WHEN gone IS NULL THEN sha256(text) ELSE sha256(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, i)), lambda i: l[i]), chr(10))) END AS text_sha256
FROM d LEFT JOIN z USING (doc_id)
"""


def op5(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    host = "translate(regexp_extract({0}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract({0}, '^[^/?#]*(/[^?#]*)?', 1)"
    rest = "CASE WHEN strpos({0}, '://') > 0 THEN substr({0}, strpos({0}, '://') + 3) ELSE '' END"
    tag = "regexp_extract(regexp_extract(coalesce(html, ''), '(?is)<{0}\\b[^>]*\\b{1}\\s*=\\s*[\"'']?{2}\\b[^>]*>'), '(?is)\\b{3}\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1)"
    return f"""
WITH RECURSIVE rules(rh, rp, rv) AS (VALUES {values}),
p AS (SELECT page_id, {host.format("r")} AS host, {path.format("r")} AS path FROM (SELECT page_id, {rest.format("url")} AS r FROM pages)),
l AS (SELECT url, unnest([{tag.format("link", "rel", "canonical", "href")}, {tag.format("meta", "http-equiv", "refresh", "url")}]) AS t FROM pages),
t AS (SELECT {rest.format("url")} AS r, CASE WHEN contains(t, '://') THEN {rest.format("t")} WHEN starts_with(t, '//') THEN substr(t, 3)
      WHEN starts_with(t, '/') THEN concat(regexp_extract({rest.format("url")}, '^([^/?#]*)', 1), t) ELSE '' END AS s FROM l WHERE t <> ''),
e AS (SELECT {host.format("r")} AS h1, {path.format("r")} AS p1, {host.format("s")} AS h2, {path.format("s")} AS p2 FROM t),
b AS (SELECT h1, p1, h2, p2 FROM e WHERE h1 <> '' AND h2 <> '' UNION SELECT h2, p2, h1, p1 FROM e WHERE h1 <> '' AND h2 <> ''),
n AS (SELECT host, path FROM p UNION SELECT h1, p1 FROM b),
fit AS (SELECT host, path, rh || rp AS rule, rv, row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
        FROM n JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
ruled AS (SELECT * FROM fit WHERE k = 1),
bad(host, path) AS (SELECT host, path FROM ruled WHERE rv = 'block' UNION SELECT h2, p2 FROM bad JOIN b ON host = h1 AND path = p1)
SELECT page_id, p.host, p.path, rule, coalesce(rv, CASE WHEN bad.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN ruled ON p.host = ruled.host AND p.path = ruled.path LEFT JOIN (SELECT DISTINCT * FROM bad) bad ON p.host = bad.host AND p.path = bad.path
"""


OP2 = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op12(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> str:
    floors = f"list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"
    steps = [f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, {floors} AS v FROM embeddings
           WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, unnest(range(1, {dim + 1})) AS i, unnest(v) AS x FROM v),
c0 AS MATERIALIZED (SELECT c, unnest(range(1, {dim + 1})) AS i, unnest(v) AS y FROM (
       SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM v WHERE vec_id IS NOT NULL) WHERE c < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM (
       SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM p JOIN c{n} USING (i) GROUP BY 1, 2)) WHERE place = 1)""")
        if n < rounds:
            steps.append(f"""
m{n} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN p USING (r) GROUP BY 1, 2),
c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM c{n} LEFT JOIN m{n} USING (c, i))""")
    return ",".join(steps) + f""",
h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY 1)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN h USING (c)
"""


def op13(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """Of a table whose vectors all have one length."""
    floors = f"list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"
    steps = [f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, {floors}) AS r, vec_id, label, {floors} AS v FROM embeddings
           WHERE len(embedding) > 0 AND len(embedding) % {parts} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, unnest(range(0, len(v))) // (len(v) // {parts}) AS p, unnest(range(0, len(v))) % (len(v) // {parts}) AS i, unnest(v) AS x FROM v),
e0 AS MATERIALIZED (SELECT p, r - 1 AS e, i, x AS y FROM p WHERE r <= {entries})"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (SELECT r, p, e, d FROM (SELECT r, p, e, d, row_number() OVER (PARTITION BY r, p ORDER BY d, e) AS place FROM (
       SELECT r, p, e, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM p JOIN e{n} USING (p, i) GROUP BY 1, 2, 3)) WHERE place = 1)""")
        if n < rounds:
            steps.append(f"""
m{n} AS (SELECT p, e, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN p USING (r, p) GROUP BY 1, 2, 3),
e{n + 1} AS MATERIALIZED (SELECT p, e, i, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM e{n} LEFT JOIN m{n} USING (p, e, i))""")
    return ",".join(steps) + f""",
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, i)) FROM e{rounds}) AS codebooks_sha256 FROM c JOIN v USING (r)
"""
