r"""DuckDB's SQL for the operators whose whole result SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE = r"[^\x20\x09-\x0D]+"
MARK = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES["op2_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE}') AS ws FROM documents),
 t AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word, len(ws) AS n FROM d),
 w AS (SELECT *, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS h FROM t),
 r AS (SELECT doc_id, i, word, CASE WHEN i <= n - 20 THEN row_number() OVER (PARTITION BY i <= n - 20, h ORDER BY doc_id, i) > 1 END AS again FROM w),
 g AS (SELECT doc_id, i, word, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM r),
 a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS m, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(m, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""

# base32 of the digest, five bits at a time
BITS = "array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c: right('0000' || bin(strpos('0123456789abcdef', c) - 1), 4)), '')"
ORACLES["op7_warc"] = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, {BITS} AS bits, sha256(coalesce(html, '')) AS h FROM pages),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, b AS payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, 1 + 5 * k + j, 1) AS INT) * (1 << (4 - j))))::INT, 1)), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS valid FROM f"""

ORACLES["op4_lm_scores"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE}') AS ws FROM documents),
 t AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM d),
 p AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM t),
 u AS (SELECT w, count(*) AS n, sum(count(*)) OVER () AS total FROM t GROUP BY w),
 o AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY 1, 2),
 b AS (SELECT v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY 1, 2),
 q AS (SELECT doc_id, v, w, count(*) AS n FROM p GROUP BY 1, 2, 3),
 s AS (SELECT q.doc_id, q.n, coalesce(b.n - q.n, 0) > 0 AS seen,
   CASE WHEN b.n - q.n > 0 THEN ln((b.n - q.n) / (h.n - o.n)) WHEN q.v IS NULL THEN ln(e.n / e.total) ELSE ln(0.4) + ln(e.n / e.total) END AS part
  FROM q JOIN u e ON e.w = q.w LEFT JOIN b ON b.v = q.v AND b.w = q.w LEFT JOIN u h ON h.w = q.v LEFT JOIN o ON o.doc_id = q.doc_id AND o.w = q.v),
 a AS (SELECT doc_id, sum(n) FILTER (seen) AS n_seen, sum(n * part) AS score FROM s GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_tokens, CAST(coalesce(n_seen, 0) AS BIGINT) AS n_seen, round(coalesce(score, 0), 4) AS score,
 CASE WHEN len(ws) > 0 THEN round(score / len(ws), 4) END AS mean_score FROM d LEFT JOIN a USING (doc_id)"""

ORACLES["op9_decontamination"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{MARK}') AS ws FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '{MARK}') AS ws FROM benchmark),
 v AS (SELECT item, least(len(ws), 10) AS size, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0),
 k AS (SELECT DISTINCT item, size, array_to_string(ws[i : i + size - 1], ' ') AS win FROM v),
 t AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM d),
 l AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten FROM t),
 s AS (SELECT DISTINCT size FROM k),
 h AS (SELECT doc_id, i, l.size, item FROM (SELECT doc_id, i, size, array_to_string(ten[1 : size], ' ') AS win FROM l, s WHERE len(ten) >= size) l JOIN k ON k.size = l.size AND k.win = l.win),
 c AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS x FROM h) GROUP BY 1),
 m AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""

ORACLES["op10_near_duplicates"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{SPACE}') AS ws FROM documents),
 t AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word, len(ws) AS n FROM d),
 w AS (SELECT doc_id, i, n, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS h FROM t),
 s AS (SELECT DISTINCT doc_id, h FROM w WHERE i <= n - 5 OR (n < 5 AND i = 0)),
 z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM p JOIN z x ON a = x.doc_id JOIN z y ON b = y.doc_id WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
 u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 reach AS (SELECT a AS doc_id, b AS other FROM u UNION SELECT r.doc_id, u.b FROM reach r JOIN u ON r.other = u.a),
 c AS (SELECT doc_id, min(other) AS least FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.least, d.doc_id) AS kept
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN c USING (doc_id)"""


def crc32(key: str) -> str:
    """SQL of the CRC-32 of an ASCII string; the table ``crc`` has the list t of the 256 remainders."""
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({key}, ''), lambda c: ascii(c)::BIGINT)), lambda a, x: xor(a >> 8, t[xor(a, x) % 256 + 1])))"


EIGHT = "list_reduce(list_concat([i], range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
CRC = f"crc AS (SELECT list({EIGHT} ORDER BY i) AS t FROM range(256) r(i))"
WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

INSERTED = """SELECT conv_id, i, CASE WHEN ins = 0 THEN st WHEN st = 'u' THEN 'a' ELSE 'u' END AS st, cost + 5 * ins AS cost, audit || CASE ins WHEN 1 THEN 'I' ELSE '' END AS audit,
 made || CASE WHEN ins = 0 THEN '' WHEN st = 'u' THEN 'assistant:' || chr(10) ELSE 'user:' || chr(10) END AS made FROM p CROSS JOIN (VALUES (0), (1)) v(ins)"""

# cheapest edits: one row per conversation, place and state, the cheapest of each kept; '' s u a are the states
ORACLES["op12_conversation_repair"] = f"""
WITH RECURSIVE {CRC},
 k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS act FROM conversations, crc),
 d AS (SELECT conv_id, turn, CASE act WHEN 4 THEN 'user' ELSE role END AS role, CASE act WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, range(2) v(copy) WHERE act <> 0 AND (copy = 0 OR act = 3)),
 e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, {WHITE}) AS bare FROM d),
 f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM e),
 g AS (SELECT *, left(role, 1) AS ini, CASE WHEN bare = '' THEN 'b' WHEN again THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS after FROM f),
 n AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (after IS NOT NULL AND ini || after NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY 1),
p AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS st, 0::BIGINT AS cost, '' AS audit, '' AS made FROM g
  UNION ALL
  SELECT conv_id, i, st, cost, audit, made FROM (
   SELECT q.conv_id, g.i, CASE e.edit WHEN 'D' THEN q.st WHEN 'K' THEN g.ini ELSE e.ini END AS st,
    q.cost + e.price + CASE WHEN e.edit <> 'D' AND g.fault = 't' THEN 5 ELSE 0 END AS cost, q.audit || e.edit AS audit,
    q.made || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN g.role || ':' || g.text || chr(10) ELSE e.role || ':' || g.text || chr(10) END AS made
   FROM ({INSERTED}) q JOIN g ON g.conv_id = q.conv_id AND g.i = q.i + 1
   JOIN (VALUES ('D', '', '', 2), ('K', '', '', 0), ('R', 'u', 'user', 1), ('R', 'a', 'assistant', 1)) e(edit, ini, role, price)
    ON e.edit = 'D' OR (g.fault NOT IN ('b', 'd') AND (CASE e.edit WHEN 'K' THEN g.ini ELSE e.ini END = CASE q.st WHEN 'u' THEN 'a' ELSE 'u' END OR (q.st = '' AND e.edit = 'K' AND g.ini = 's')))) x
  QUALIFY row_number() OVER (PARTITION BY conv_id, i, st ORDER BY cost, audit) = 1),
 z AS (SELECT q.* FROM ({INSERTED}) q JOIN n ON n.conv_id = q.conv_id AND n.rows = q.i WHERE st IN ('', 'a') QUALIFY row_number() OVER (PARTITION BY q.conv_id ORDER BY cost, audit) = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(made, length(made) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n USING (conv_id) LEFT JOIN z USING (conv_id)"""

ORACLES["op11_prefix_trie"] = f"""
WITH {CRC},
 k AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '{SPACE}')) AS w FROM conversations WHERE conv_id IS NOT NULL),
 t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM k),
 c AS (SELECT conv_id, conv_id - conv_id % 20 AS family, {crc32("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
 r AS (SELECT c.conv_id, pos, k, w FROM c JOIN t ON t.conv_id = c.family AND pos <= h UNION ALL SELECT c.conv_id, pos, k, w FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
 q AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, w, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM r),
 a AS (SELECT conv_id, depth, w, path FROM q UNION ALL SELECT conv_id, 0, 0, '' FROM c),
 l AS (SELECT conv_id, max(depth) AS n FROM a GROUP BY 1),
 n AS (SELECT path, any_value(depth) AS depth, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = l.n), '') AS ends FROM a JOIN l USING (conv_id) GROUP BY 1),
 h AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
 m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN h USING (path)),
 s AS (SELECT left(path, 32 * up) AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS up FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s USING (path) LEFT JOIN n p ON m.depth > 0 AND p.path = left(m.path, length(m.path) - 32)"""

# what the two passes should find in pages whose article is marked: every heading and paragraph of it
ORACLES["op13_html_text"] = r"""
WITH p AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's') AS inner_html FROM pages),
 b AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(inner_html, '</?(?:h[1-6]|p)>'), lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(
  regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM p),
 t AS (SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM t"""
