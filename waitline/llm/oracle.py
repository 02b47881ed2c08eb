"""DuckDB statements that the corpus queries must equal."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op2_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

ORACLES["op12_fill_middle"] = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), cuts AS (
  SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || d[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || d[9:16])::BIGINT % (len(u) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR ('0x' || d[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || d[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
         array_to_string(u[greatest(x, y) + 1:], '') AS s
  FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

# The hash is CRC-32 with its usual reversed polynomial, byte by byte over a table that the statement builds.
ORACLES["op13_spelling"] = """
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), k) ORDER BY k) AS crc_table FROM range(256) t(k)
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS seeded, run, count(*) AS n
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{7,}')),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(octet_length(encode(seeded))),
                                                lambda i: ('0x' || substr(hex(encode(seeded)), 2 * i + 1, 2))::BIGINT),
                                 lambda c, b: xor(c >> 8, crc_table[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS h
  FROM runs, bits
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word,
         sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM words, range(length(word)) t(i)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON b.word = a.head || a.tail
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON b.word = a.head || a.tail
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form,
         CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), steps AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN forms f ON f.word = s.next
)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s ON s.word = f.word AND s.next IS NULL
"""

ORACLES["op6_line_dedup"] = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
         list_filter(list_transform(string_split_regex(regexp_replace(coalesce(html, ''),
           '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', chr(10), 'g'), '<[^>]*>|\n'),
           lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages
), totals AS (
  SELECT host, count(*) AS total FROM p GROUP BY host
), counts AS (
  SELECT host, line, count(*) AS n FROM (SELECT r, host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY ALL
), drops AS (
  SELECT host, list(line) AS gone FROM counts JOIN totals USING (host) WHERE n >= 2 AND n > 0.1::DOUBLE * total GROUP BY host
), kept AS (
  SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS stay FROM p LEFT JOIN drops USING (host)
)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(stay))::BIGINT AS n_dropped,
       coalesce(array_to_string(stay, chr(10)), '') AS text FROM kept
"""
