"""DuckDB SQL for those queries of this subpackage that SQL can express."""

SQL: dict[str, str] = {}

SQL["op8_minhash_near_dup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(ws, i, i + 4) AS sh
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 2)))) AS r(i)
  WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n
  UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp c USING (doc_id)
"""

SQL["op3_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h
  FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 48))) AS r(i) WHERE len(ws) >= 50),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
hit AS (SELECT doc_id, i FROM win JOIN least USING (h) WHERE m < doc_id),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, range(0, 50) AS t(k)),
word AS (
  SELECT doc_id, p, ws[p] AS x FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1))) AS r(p)),
kept AS (
  SELECT doc_id, count(*) AS n, sha256(string_agg(x, ' ' ORDER BY p)) AS s
  FROM word ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, coalesce(s, sha256('')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

SQL["op6_chat_prefix_tree"] = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
f AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') AS e,
         replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:') AS r
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(e) + length(r) + length('### : </turn>') + 1)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

# every item-sized window of each pair that shares enough shingles at all, with the exact similarity of the bags
SQL["op5_simhash_decontamination"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
item AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark),
i AS (
  SELECT item_id, ws, len(ws) AS size, least(len(ws), 5) AS width, len(ws) - least(len(ws), 5) + 1 AS m FROM item WHERE len(ws) > 0),
bag AS (
  SELECT item_id, size, width, m, sh, count(*) AS c
  FROM (SELECT item_id, size, width, m, list_slice(ws, p, p + width - 1) AS sh FROM i, LATERAL (SELECT unnest(range(1, m + 1))) AS r(p))
  GROUP BY ALL),
place AS (
  SELECT doc_id, len(ws) AS n, p - 1 AS pos, list_slice(ws, p, p + width - 1) AS sh
  FROM w, (SELECT DISTINCT width FROM i) AS k, LATERAL (SELECT unnest(range(1, len(ws) - width + 2))) AS r(p)),
hit AS (SELECT * FROM place JOIN bag USING (sh)),
pair AS (SELECT doc_id, item_id FROM hit GROUP BY doc_id, item_id, m HAVING count(DISTINCT pos) >= ceil(0.8 * m - 1e-9)),
win AS (
  SELECT doc_id, item_id, n, size, width, m, start, sh, c, count(*) AS k
  FROM hit JOIN pair USING (doc_id, item_id), LATERAL (SELECT unnest(range(greatest(pos - m + 1, 0), pos + 1))) AS r(start)
  GROUP BY ALL),
sim AS (
  SELECT doc_id, item_id, start, least(size, n - start) AS n_words, sum(least(c, k)) AS b, m + least(m, n - width + 1 - start) AS s
  FROM win GROUP BY doc_id, item_id, start, n, size, width, m)
SELECT doc_id, item_id, max(b / (s - b))::DOUBLE AS similarity,
       arg_max(start, (b / (s - b), -start))::BIGINT AS start, arg_max(n_words, (b / (s - b), -start))::BIGINT AS n_words
FROM sim WHERE b / (s - b) >= 0.8 GROUP BY doc_id, item_id
"""
