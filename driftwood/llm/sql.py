"""SQL (DuckDB) that gives the rows of registered queries, straight from their definitions."""

from __future__ import annotations

from driftwood.llm import license_scan, quality

_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"

_OP3 = rf"""WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, {_WORDS} AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, p, array_to_string(ws[p:p + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)),
r AS (SELECT doc_id, p FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS f FROM b GROUP BY host),
q AS (SELECT sum(f) / sum(n) AS mean, avg(CASE WHEN n > 1 THEN f / n END) AS m, var_pop(CASE WHEN n > 1 THEN f / n END) AS v FROM h),
s AS (SELECT mean, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 10000.0) WHEN m IS NULL THEN 1.0 ELSE 10000.0 END AS strength FROM q),
k AS (SELECT host, n + strength AS weight, mean, (f + mean * strength) / (n + strength) AS rate FROM h, s),
j AS (SELECT host, rate, rate - {quality.DEVIATIONS} * sqrt(rate * (1 - rate) / (weight + 1)) > {quality.ODDS} * mean / (1 + ({quality.ODDS} - 1) * mean) AS host_failed FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept, round(rate, 6) AS host_rate, host_failed FROM b JOIN j ON b.host IS NOT DISTINCT FROM j.host"""

_OP4 = rf"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
p AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w)),
f AS (SELECT k, min(doc_id) AS first FROM p GROUP BY k),
g AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 13)) AS q FROM p JOIN f USING (k) WHERE first < doc_id)),
gone AS (SELECT doc_id, list(q) AS qs FROM g GROUP BY doc_id),
e AS (SELECT doc_id, ws, coalesce(qs, []) AS qs FROM w LEFT JOIN gone USING (doc_id)),
x AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM e)),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS line FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.i = g.q GROUP BY x.doc_id)
SELECT e.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(qs) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256 FROM e LEFT JOIN kept USING (doc_id)"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLAIN = rf"regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP5 = rf"""WITH d AS (SELECT doc_id, {_PLAIN} AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, ws, least(10, len(ws)) AS n FROM (SELECT item_id, {_PLAIN} AS ws FROM benchmark WHERE item_id IS NOT NULL) WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(ws[p:p + n - 1], ' ') AS k FROM (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM i)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, ns WHERE len(ws) >= n)),
hits AS (SELECT doc_id, n, p, item FROM dw JOIN iw USING (n, k)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)"""


def _license_sql() -> str:
    rows = ", ".join(f"('{name}', '{g}')" for name, text in license_scan.TEMPLATES.items() for g in sorted(license_scan.bigrams_of(text)))
    return rf"""WITH t(name, g) AS (VALUES {rows}), size AS (SELECT name, count(*) AS n FROM t GROUP BY name),
u AS (SELECT doc_id, unnest(CASE WHEN len(ls) > 1 THEN list_append(ls, text) ELSE ls END) AS u FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)),
un AS (SELECT doc_id, row_number() OVER () AS unit, list_filter(string_split(regexp_replace(lower(u), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM u),
g AS (SELECT DISTINCT doc_id, unit, ws[p] || ' ' || ws[p + 1] AS g FROM (SELECT doc_id, unit, ws, unnest(range(1, len(ws))) AS p FROM un)),
n AS (SELECT unit, count(*) AS n FROM g GROUP BY unit),
s AS (SELECT doc_id, unit, name, 2.0 * count(*) / (any_value(n.n) + any_value(size.n)) AS dice FROM g JOIN t USING (g) JOIN n USING (unit) JOIN size USING (name) GROUP BY doc_id, unit, name),
m AS (SELECT doc_id, unit, name, dice FROM s WHERE dice >= {license_scan.THRESHOLD}),
b AS (SELECT doc_id, name AS license, dice FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name DESC) = 1)
SELECT d.doc_id, license, CAST(dice AS DOUBLE) AS dice, (SELECT count(DISTINCT unit) FROM m WHERE m.doc_id = d.doc_id) AS n_matches FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id"""


def _centroid_sql(k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64) -> str:
    assign = """SELECT r, v, min({{'d': list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': c}}) AS best FROM kept, c{0} GROUP BY r, v"""
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds):
        steps += [
            f"a{i} AS ({assign.format(i)})",
            f"s{i} AS (SELECT best.c AS c, j, sum(v[j]) AS s, count(*) AS n FROM (SELECT best, v, unnest(range(1, {width + 1})) AS j FROM a{i}) GROUP BY best.c, j)",
            f"m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM s{i} GROUP BY c)",
            f"c{i + 1} AS (SELECT c0.c, coalesce(m{i}.m, old.m) AS m FROM c0 JOIN c{i} old USING (c) LEFT JOIN m{i} USING (c))",
        ]
    last = f"a AS (SELECT r, best.d AS d, best.c AS c FROM ({assign.format(rounds)}))"
    return f"""WITH {", ".join([*steps, last])}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a JOIN kept USING (r) JOIN c{rounds} f ON f.c = a.c"""


_OP13 = r"""WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n)) AS tab),
cv AS (SELECT c, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda a, k: xor(a >> 8, tab[(xor(a, k) & 255) + 1]), 4294967295), 4294967295) % 4 AS h
 FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), crc),
t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT c, k, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS r FROM (SELECT c, turn, md5(octet_length(encode(role)) || ':' || role || text) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM t)),
b AS (SELECT cv.c, 0 AS s, r, k, w FROM cv JOIN n ON n.c = cv.c - cv.c % 20 AND r <= h UNION ALL SELECT cv.c, 1, r, k, w FROM cv JOIN n ON n.c = cv.c AND r > h),
p AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY s, r) AS d, k, w FROM b),
m AS (SELECT c, d, w, sha256(string_agg(k, ',') OVER (PARTITION BY c ORDER BY d)) AS id FROM p UNION ALL SELECT c, 0, 0, '' FROM cv),
l AS (SELECT c, max(d) AS n FROM m GROUP BY c),
nodes AS (SELECT id, d, min(c) AS c, count(*) AS n_convs, any_value(w) AS w FROM m GROUP BY id, d),
par AS (SELECT nodes.*, q.id AS pid FROM nodes LEFT JOIN m q ON q.c = nodes.c AND q.d = nodes.d - 1),
kid AS (SELECT pid, count(*) AS n FROM par WHERE pid IS NOT NULL GROUP BY pid),
sub AS (SELECT m.id, CAST(sum((x.n_convs - 1) * x.w) AS BIGINT) AS saved, count(*) FILTER (kid.pid IS NULL) AS leaves FROM nodes x LEFT JOIN kid ON kid.pid = x.id JOIN m ON m.c = x.c AND m.d <= x.d GROUP BY m.id),
e AS (SELECT m.id, sha256(string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c)) AS h FROM m JOIN l ON l.c = m.c AND l.n = m.d GROUP BY m.id)
SELECT par.c AS conv_id, CAST(par.d AS BIGINT) AS depth, up.c AS parent_conv_id, par.n_convs, coalesce(kid.n, 0) AS n_children, sub.leaves AS n_leaves, sub.saved AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM par LEFT JOIN nodes up ON up.id = par.pid LEFT JOIN kid ON kid.pid = par.id JOIN sub ON sub.id = par.id LEFT JOIN e ON e.id = par.id"""


_OP12 = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT r, array_to_string(ws[p:p + 2], ' ') AS k FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n, sha256(string_agg(k, chr(10) ORDER BY k)) AS id FROM s GROUP BY r),
u AS (SELECT id, min(r) AS r, any_value(n) AS n FROM n GROUP BY id),
i AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN u ua ON ua.r = a.r JOIN s b ON a.k = b.k AND a.r < b.r JOIN u ub ON ub.r = b.r WHERE 100 * least(ua.n, ub.n) >= 90 * greatest(ua.n, ub.n) GROUP BY a.r, b.r),
l AS (SELECT x, y FROM i JOIN u ux ON ux.r = x JOIN u uy ON uy.r = y WHERE 100 * c >= 90 * (ux.n + uy.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l UNION SELECT r, r FROM u),
t AS (WITH RECURSIVE t(x, y) AS (SELECT x, y FROM e UNION SELECT t.x, e.y FROM t JOIN e ON e.x = t.y) SELECT * FROM t),
g AS (SELECT u.id, min(d.doc_id) AS low FROM u JOIN t ON t.x = u.r JOIN u v ON v.r = t.y JOIN n ON n.id = v.id JOIN d ON d.r = n.r GROUP BY u.id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CASE WHEN n.id IS NULL THEN doc_id ELSE g.low END AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN g USING (id)"""


ORACLE: dict[str, str] = {"op1_license_scan": _license_sql(), "op3_quality": _OP3, "op4_substring": _OP4, "op5_decontam": _OP5, "op11_centroids": _centroid_sql(), "op12_similar_sets": _OP12, "op13_prefix_trie": _OP13}
