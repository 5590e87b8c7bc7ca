"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE: dict[str, str] = {}

ORACLE["op8_line_dedup"] = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_WHITE}), {_LOWER}) AS k FROM line),
shared AS (
  SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id <> first_id, false) AS gone
  FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), ''))
         AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE["op6_url_filter"] = f"""
WITH rules(verdict, host, path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
urls AS (
  SELECT page_id, row_number() OVER () AS rid,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), {_LOWER}) AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
hits AS (
  SELECT u.rid, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host))
                          AND starts_with(u.path, r.path)
  GROUP BY u.rid),
judged AS (SELECT u.*, h.rule, h.verdict FROM urls u LEFT JOIN hits h USING (rid)),
listed AS (
  SELECT host, len(list_intersect(string_split_regex(host, '[.-]'),
           ['ads', 'adult', 'bets', 'casino', 'pills', 'spam'])) > 0
         OR count(*) FILTER (verdict = 'block') > count(*) FILTER (verdict = 'allow') AS listed
  FROM judged WHERE host <> '' GROUP BY host)
SELECT page_id, j.host, path, rule,
       coalesce(verdict, CASE WHEN coalesce(listed, false) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(listed, false) AS listed
FROM judged j LEFT JOIN listed l ON j.host = l.host
"""

ORACLE["op9_host_rules"] = r"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
pos AS (SELECT rid, w, unnest(generate_series(1, len(w) - 7)) AS p FROM words WHERE len(w) >= 8),
grams AS (SELECT rid, p, md5(array_to_string(w[p:p + 7], chr(10))) AS g FROM pos),
twice AS (SELECT rid, p FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) >= 2),
covered AS (SELECT rid, count(DISTINCT p + i) AS n FROM twice, range(8) t(i) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM texts),
dup AS (SELECT rid, sum(n - 1) AS n, sum(n) AS filled FROM (
          SELECT rid, line, count(*) AS n FROM lines
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line) GROUP BY rid),
counts AS (
  SELECT doc_id, source, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(dup.filled, 0)::BIGINT AS n_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM texts JOIN words USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN covered USING (rid)),
marked AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols > n_words
         OR 2 * n_dup_lines > n_lines OR word_chars > 20 * n_words AS failed
  FROM counts),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS f FROM marked GROUP BY source),
prior AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts),
strength AS (SELECT m, CASE WHEN v > 0 THEN greatest(2.0, m * (1 - m) / v - 1) ELSE 2.0 END AS s FROM prior),
verdict AS (SELECT source, (f + m * s) / (n + s) > 0.5 AS host_failed,
                   (f + m * s) / (n + s) > m + 1e-9 AS host_worse FROM hosts, strength)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AND NOT (host_worse AND failed) AS kept
FROM marked JOIN verdict ON marked.source IS NOT DISTINCT FROM verdict.source
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE["op11_lexical"] = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_TERM}') AS words FROM documents),
stats AS (
  SELECT count(*) FILTER (len(words) > 0) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM docs),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_TERM}')) AS term
  FROM benchmark),
tf AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(words) AS term FROM docs)
  WHERE term IN (SELECT term FROM wanted) GROUP BY rid, term),
weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), stats),
impact AS (
  SELECT rid, doc_id, term,
         w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(words) * n_docs) // n_terms))) AS impact
  FROM tf JOIN weight USING (term) JOIN docs USING (rid), stats),
score AS (
  SELECT item_id, rid, doc_id, sum(impact)::BIGINT AS score
  FROM wanted JOIN impact USING (term) GROUP BY item_id, rid, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM score WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
