"""DuckDB SQL of the queries that SQL can express."""

BLANK = r"[^\x20\x09-\x0D]+"

WARC = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) b FROM pages), h AS (SELECT page_id, octet_length(b) n, sha1(b) s, min(page_id) OVER (PARTITION BY b) o FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(s, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> o THEN o END AS refers_to FROM h"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') gram FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
s AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') gram FROM d, (SELECT DISTINCT n FROM g) k, unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n),
m AS (SELECT r, i, g.n, item_id FROM s JOIN g ON s.gram = g.gram AND s.n = g.n),
c AS (SELECT r, count(DISTINCT j) n_hit FROM m, unnest(range(i, i + n)) t(j) GROUP BY r), it AS (SELECT r, count(*) k, string_agg(x, ',' ORDER BY x) ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) x FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(k, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN it USING (r)"""

BOILERPLATE = (
    r"(?i)\blicensed under\b|\ball rights reserved\b|\bcopyright\b|©|\bterms of (use|service)\b|\bprivacy policy\b"
    r"|\bcookies?\b|\bjavascript\b|\bsubscribe\b|\bsign (in|up)\b|\blog ?in\b|\bclick here\b|\bread more\b|\blorem ipsum\b"
)

QUALITY = rf"""WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') t, coalesce(regexp_extract_all(text, '{BLANK}'), []) w FROM documents),
l AS (SELECT r, x, regexp_extract_all(x, '{BLANK}') v FROM (SELECT r, unnest(string_split(t, chr(10))) x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
f AS (SELECT r, x, len(v) n, len(x) - len(replace(x, '|', '')) bars, len(regexp_replace(x, '[^#*$%&<>]', '', 'g')) sy,
  len(list_filter(range(1, len(v) - 2), lambda i: v[i] = v[i + 1] AND v[i] = v[i + 2] AND v[i] = v[i + 3])) > 0 st FROM l),
b AS (SELECT r, x, (bars >= 2 AND bars * 5 >= n) OR (regexp_matches(x, '[#*$%&<>][#*$%&<>]') AND sy * 2 >= n) OR (x = upper(x) AND x <> lower(x) AND n >= 3) OR ((len(x) - len(replace(x, '!!', ''))) // 2 * 5 >= n)
  OR (n > 4 AND NOT regexp_matches(x, '[.!?…:;。！？]')) OR st OR regexp_matches(x, '{BOILERPLATE}') bad FROM f),
k AS (SELECT r, count(*) - count(DISTINCT x) n_dup, coalesce(sum(CASE WHEN NOT bad THEN len(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) END), 0) kept_chars FROM b GROUP BY r),
wi AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') g FROM d, unnest(range(1, len(w) - 6)) q(i)),
rw AS (SELECT r, count(DISTINCT j) n_rep FROM (SELECT r, i FROM wi QUALIFY count(*) OVER (PARTITION BY r, g) > 1), unnest(range(i, i + 8)) q(j) GROUP BY r),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) word_chars, CAST(len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) n_symbols, coalesce(n_dup, 0) n_dup_lines, coalesce(n_rep, 0) n_repeat_words, coalesce(kept_chars, 0) kc FROM d LEFT JOIN k USING (r) LEFT JOIN rw USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND kc >= 0.5 * word_chars AS kept FROM a"""

NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () r, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{BLANK}'), []) w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') g FROM d, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) q(i)),
n AS (SELECT r, count(*) n FROM s GROUP BY r),
p AS (SELECT a.r x, b.r y, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
c AS (SELECT x, y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(o.doc_id), d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(min(o.doc_id), d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN c ON c.x = d.r LEFT JOIN d o ON o.r = c.y GROUP BY d.r, d.doc_id"""
