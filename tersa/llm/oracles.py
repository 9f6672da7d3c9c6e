"""DuckDB SQL for the rows of queries that SQL can express, over the same whole tables.

No SQL: op1 and op4 (fitted models), op3 (Spark's hash of k-mers), op5 (byte-pair merges), op7 (a heap), op9 (inferred
automata; DuckDB does not tell where a match is). Tests compare these with brute force or a library.
"""

from __future__ import annotations

from tersa.llm import mixing, near_dedup, quality_rules

WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) = 1 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s FROM w),
classes AS (SELECT min(doc_id) AS cid, any_value(s) AS s FROM (SELECT doc_id, s, list_sort(s) AS k FROM sets WHERE len(s) > 0) GROUP BY k),
t AS (SELECT cid, len(s) AS n, unnest(s) AS sh FROM classes),
f AS (SELECT sh, count(*) AS df FROM t GROUP BY sh),
r AS (SELECT cid, n, t.sh, row_number() OVER (PARTITION BY cid ORDER BY df, t.sh) AS k FROM t JOIN f USING (sh)),
p AS (SELECT * FROM r WHERE k <= n - (n * {near_dedup.PERCENT} + 99) // 100 + 1),
c AS (SELECT DISTINCT a.cid AS a, b.cid AS b FROM p a JOIN p b ON a.sh = b.sh AND a.cid < b.cid AND a.n * 100 >= b.n * {near_dedup.PERCENT} AND b.n * 100 >= a.n * {near_dedup.PERCENT}),
l AS (SELECT a, b FROM (SELECT a, b, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS n FROM c JOIN classes x ON x.cid = a JOIN classes y ON y.cid = b) WHERE 100 * i >= {near_dedup.PERCENT} * (n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (WITH RECURSIVE g(root, node) AS (SELECT cid, cid FROM classes UNION SELECT g.root, e.b FROM g JOIN e ON g.node = e.a) SELECT node, min(root) AS comp FROM g GROUP BY node),
m AS (SELECT s.doc_id, len(s.s) AS n_shingles, c.cid FROM sets s LEFT JOIN (SELECT cid, list_sort(s) AS k FROM classes) c ON list_sort(s.s) = c.k)
SELECT doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, coalesce(comp, doc_id) AS component_id, doc_id = coalesce(comp, doc_id) AS kept FROM m LEFT JOIN reach ON node = cid
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
x AS (SELECT *, greatest(length(bin(size)) - 6, 0) AS shift FROM d),
k AS (SELECT *, shift * 64 + (size >> shift) AS class FROM x),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
g AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, source_size * {mixing.CAP} AS most FROM s),
v AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM g WINDOW o AS (ORDER BY most / weight, source IS NULL, source)),
t AS (SELECT source, source_size, least(CAST(most AS DOUBLE), coalesce((SELECT arg_min(level, most / weight) FROM v WHERE level * weight <= most) * weight, CAST(most AS DOUBLE))) AS target FROM v),
b AS (SELECT *, ((i + CAST(floor(i / {mixing.SALTS}) AS BIGINT) + CAST(floor(i / {mixing.SALTS**2}) AS BIGINT)) % {mixing.SALTS} + {mixing.SALTS}) % {mixing.SALTS} AS salt FROM (SELECT *, coalesce(doc_id, 0) AS i FROM k)),
n AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, doc_id) AS nth FROM b),
r AS (SELECT n.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0 END AS ratio, CAST('0x' || left(md5('{mixing.SEED}:' || coalesce(n.source, chr(0) || 'null')), 7) AS BIGINT) * 8 AS shift FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CAST(least(floor(ratio), {mixing.CAP}) AS BIGINT) AS whole, CAST(least(floor((ratio - floor(ratio)) * {mixing.UNIT}), {mixing.UNIT - 1}) AS BIGINT) AS part FROM r)
SELECT doc_id, size, source_size, target, CAST(least(whole + CAST((shift + part * (nth % {mixing.UNIT})) % {mixing.UNIT} < part AS BIGINT), {mixing.CAP}) * size AS BIGINT) AS taken FROM q
"""

OP8 = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws, row_number() OVER () AS id FROM documents),
u AS (SELECT id, unnest(range(1, len(ws) - {quality_rules.WINDOW - 2})) AS i, unnest(list_transform(range(1, len(ws) - {quality_rules.WINDOW - 2}), lambda i: hash(array_to_string(ws[i : i + {quality_rules.WINDOW - 1}], ' ')))) AS win FROM w WHERE len(ws) >= {quality_rules.WINDOW}),
v AS (SELECT id, i, count(*) OVER (PARTITION BY id, win) AS n FROM u),
r AS (SELECT id, count(DISTINCT p) AS n_repeat_words FROM (SELECT id, unnest(range(i, i + {quality_rules.WINDOW})) AS p FROM v WHERE n > 1) GROUP BY id),
c AS (SELECT doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r USING (id)),
j AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  CAST(n_symbols * 100 > word_chars * {quality_rules.SOFT_SYMBOLS_PERCENT} AS INT) + CAST(n_dup_lines >= {quality_rules.SOFT_DUP_LINES} AS INT) + CAST(n_repeat_words * 100 > n_words * {quality_rules.SOFT_REPEAT_PERCENT} AS INT) AS soft_failures FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft_failures > 0) AS f FROM j GROUP BY source),
m AS (SELECT sum(f) / sum(n) AS m, coalesce(var_pop(f / n), 0) AS v FROM h),
p AS (SELECT m, CASE WHEN v <= 0 THEN 1e6 ELSE least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) END AS k FROM m),
b AS (SELECT source, (f + k * m) / (n + k) > {quality_rules.BAD_RATE} AND (f + k * m) / (n + k) > m * {quality_rules.MARGIN} AS host_bad FROM h, p)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, soft_failures, host_bad,
  NOT base_failed AND soft_failures < CASE WHEN host_bad THEN 1 ELSE 2 END AS kept FROM j JOIN b ON j.source IS NOT DISTINCT FROM b.source
"""

OP10 = """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, CASE WHEN page_id < most THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < most THEN most END AS refers_to
FROM (SELECT page_id, html, CASE WHEN strlen(coalesce(html, '')) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS most FROM pages)
"""

ORACLES = {"op2_near_dedup": OP2, "op6_mixing": OP6, "op8_quality_rules": OP8, "op10_warc": OP10}
