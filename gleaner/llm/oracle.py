"""SQL for DuckDB that gives the rows of those queries of this subpackage that SQL can say."""

from __future__ import annotations

OP4 = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(regexp_replace(role, '([\\#<:\n])', '\\\1', 'g')) + 2 + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + 9) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

OP5 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))
SELECT a.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.q, b.q) DESC, b.vec_id) AS INT) AS rank, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 QUALIFY rank <= 10"""

OP7 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 2]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t WHERE c >= 2) GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, coalesce(r.n, 0) AS n_repeat_words,
  len(list_filter(w, lambda x: strlen(x) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper, len(regexp_extract_all(text, '!!')) AS n_bangs
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
f AS (SELECT *, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines FROM m),
b AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 10 * n_symbols > 2 * n_words THEN 4 ELSE 0 END)
  + (CASE WHEN 10 * n_dup_lines > 5 * len(l) THEN 8 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 10 * n_upper > 3 * n_words THEN 32 ELSE 0 END)
  + (CASE WHEN 10 * n_bangs > 2 * n_words THEN 64 ELSE 0 END) AS BIGINT) AS failures FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM b"""

OP8 = r"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
e AS (SELECT * FROM (VALUES ('net', '/', 'block', true), ('example.net', '/en/', 'allow', true), ('example.com', '/de/', 'block', true), ('org', '/fr/', 'allow', true)) v(e_host, e_path, verdict, is_rule)
  UNION ALL SELECT f || '.' || d, '', 'block', false FROM (SELECT unnest(['casino-win', 'free-bets', 'cheap-pills', 'adult-x', 'ads-track', 'spam-farm']) AS f), (SELECT unnest(['example.com', 'example.net', 'example.org']) AS d)),
f AS (SELECT page_id, is_rule, e_host || e_path AS entry, verdict, row_number() OVER (PARTITION BY page_id, is_rule ORDER BY length(e_host || e_path) DESC, e_host || e_path) AS r
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(host), '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS plain FROM p) p
  JOIN e ON CASE WHEN is_rule THEN host = e_host OR ends_with(host, '.' || e_host) ELSE plain = e_host OR ends_with(plain, '.' || e_host) END AND starts_with(path, e_path))
SELECT p.page_id, host, path, a.entry AS rule, coalesce(a.verdict, b.verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM f WHERE is_rule AND r = 1) a ON a.page_id = p.page_id LEFT JOIN (SELECT * FROM f WHERE NOT is_rule AND r = 1) b ON b.page_id = p.page_id"""

OP9 = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5) UNION ALL SELECT doc_id, w FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id"""

OP13 = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
g AS (SELECT k.*, f.keeper IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY r"""

ORACLE_SQL = {"op4_chat": OP4, "op5_topk": OP5, "op7_rules": OP7, "op8_urls": OP8, "op9_jaccard": OP9, "op13_lines": OP13}
