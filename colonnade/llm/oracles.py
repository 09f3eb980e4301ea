"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

#: Every 50-byte string with its first document; texts as hexadecimal digits, two a byte.
REPEATED_STRINGS = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, s, substring(h, 2 * s + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 49)) AS s FROM docs WHERE length(h) >= 100)),
firsts AS (SELECT g, min(doc_id) AS first FROM strings GROUP BY g HAVING count(DISTINCT doc_id) > 1),
later AS (SELECT doc_id, s FROM strings JOIN firsts USING (g) WHERE first < doc_id),
marked AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS opens FROM later),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM marked),
spans AS (SELECT doc_id, span, min(s) AS a, max(s) + 50 AS b FROM numbered GROUP BY ALL),
ends AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM spans),
parts AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substring(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS kept
  FROM ends JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM docs LEFT JOIN parts USING (doc_id)
"""

LINE_RULES = rf"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM docs)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, source, t, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm
  FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{_WORD}')),
copies AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
frequent AS (SELECT source, norm FROM lines GROUP BY ALL HAVING count(DISTINCT (doc_id, t)) > 100),
gone AS (SELECT doc_id, sum(len(string_split(norm, ' '))) AS n FROM lines JOIN frequent USING (source, norm) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    coalesce(copies.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_line_words_removed
  FROM docs LEFT JOIN copies USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_line_words_removed >= 0.25 * n_words AS kept
FROM counted
"""

#: For tables of one chunk of slots, up to 24 x 50,000 rows; the checksum's table is made by its rule.
JUMP_SHARDS = """
WITH RECURSIVE jump(doc_id, n, state, shard, landed) AS (
  SELECT doc_id, n, (CAST(coalesce(doc_id, -1) AS HUGEINT) + 18446744073709551616) % 18446744073709551616, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM documents, (VALUES (24), (25)) AS v(n)
  UNION ALL
  SELECT doc_id, n, next, landed, CAST(floor((landed + 1) * (CAST(2147483648 AS DOUBLE) / (CAST(next // 8589934592 AS DOUBLE) + 1))) AS BIGINT)
  FROM (SELECT *, (state * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM jump WHERE landed < n)
),
crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
),
rows_ AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32,
    (SELECT shard FROM jump AS j WHERE j.doc_id = d.doc_id AND n = 24 AND landed >= 24) AS shard,
    (SELECT shard FROM jump AS j WHERE j.doc_id = d.doc_id AND n = 25 AND landed >= 25) AS grown_shard
  FROM documents AS d, crc
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM rows_
"""

#: Links in their plain spelling: one canonical link or refresh a page, absolute, double quotes, no entities.
URL_VERDICTS = r"""
WITH RECURSIVE rules(name, verdict, host, path) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
named AS (SELECT url, regexp_extract(html, '<link rel="canonical" href="([^"]*)"', 1) AS target FROM pages
  UNION ALL SELECT url, regexp_extract(html, '<meta http-equiv="refresh" content="[^";]*; *url=([^"]*)"', 1) FROM pages),
links AS (SELECT regexp_replace(url, '#.*$', '', 's') AS a, regexp_replace(target, '#.*$', '', 's') AS b FROM named WHERE contains(url, '://') AND contains(target, '://')),
reach(a, b) AS (
  SELECT a, a FROM (SELECT a FROM links UNION SELECT b FROM links)
  UNION
  SELECT reach.a, both_ways.b FROM reach JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) AS both_ways ON reach.b = both_ways.a
),
urls AS (SELECT url FROM pages UNION SELECT b FROM reach),
parts AS (SELECT url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM urls),
ruled AS (SELECT p.url, any_value(p.host) AS host, any_value(p.path) AS path, arg_max(r.name, length(r.name)) AS name, arg_max(r.verdict, length(r.name)) AS verdict
  FROM parts AS p LEFT JOIN rules AS r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.url),
classes AS (SELECT reach.a, count(*) FILTER (verdict = 'block') AS blocks, count(*) FILTER (verdict = 'allow') AS allows FROM reach JOIN ruled ON reach.b = ruled.url GROUP BY reach.a)
SELECT page_id, ruled.host, ruled.path, ruled.name AS rule, coalesce(ruled.verdict, CASE WHEN blocks > 0 AND allows = 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM pages JOIN ruled ON pages.url IS NOT DISTINCT FROM ruled.url LEFT JOIN classes ON regexp_replace(pages.url, '#.*$', '', 's') = classes.a
"""
