"""SQL for DuckDB over the given tables, for the operators that SQL can express."""

TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

FILL_IN_MIDDLE = f"""
WITH cut AS (
 SELECT doc_id, COALESCE(text, '') AS text, REGEXP_EXTRACT_ALL(COALESCE(text, ''), '{TOKEN}') AS k, SHA256('42:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
 SELECT *, LEN(k) AS n, [CAST('0x' || SUBSTR(h, 8*i+1, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS d FROM cut),
placed AS (
 SELECT *, LEAST(d[1] % (n+1), d[2] % (n+1)) AS a, GREATEST(d[1] % (n+1), d[2] % (n+1)) AS b,
  CASE WHEN text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
 SELECT *, COALESCE(ARRAY_TO_STRING(k[1:a], ''), '') AS p, COALESCE(ARRAY_TO_STRING(k[a+1:b], ''), '') AS m, COALESCE(ARRAY_TO_STRING(k[b+1:n], ''), '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN LENGTH(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN LENGTH(m) END AS middle_chars,
 SHA256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, SHA256(text) AS restored_sha256
FROM parts
"""

#: crc32 of an ASCII text k, bit by bit.
CRC32 = "XOR(LIST_REDUCE([CAST(4294967295 AS BIGINT)] || FLATTEN([[(ASCII(c) >> i) & 1 FOR i IN [0, 1, 2, 3, 4, 5, 6, 7]] FOR c IN STRING_SPLIT(k, '')]), lambda c, b: XOR(c >> 1, 3988292384 * (XOR(c, b) & 1))), 4294967295)"

#: The repair as a recursion over rows: audits are texts of two letters a row, a blank for none, which compare as the audits do.
CONVERSATION_REPAIR = rf"""
WITH RECURSIVE keyed AS (
 SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text, COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT *, {CRC32} % 20 AS kind FROM keyed),
damaged AS (
 SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN REGEXP_REPLACE(text, '[.!?]', '', 'g') ELSE text END AS text
 FROM kinds, LATERAL (SELECT UNNEST(RANGE(CASE WHEN kind = 3 THEN 2 ELSE 1 END))) WHERE kind <> 0),
seen AS (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS again FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged)),
faults AS (
 SELECT *, SUBSTR(role, 1, 1) AS x, CASE WHEN NOT REGEXP_MATCHES(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN NOT REGEXP_MATCHES(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM seen),
paired AS (SELECT *, LAG(x) OVER (PARTITION BY conv_id ORDER BY n) || x AS pair FROM faults),
facts AS (
 SELECT conv_id, COUNT(*) AS rows_, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (fault = 'blank') AS blank, COUNT(*) FILTER (fault = 'duplicate') AS duplicate,
  COUNT(*) FILTER (fault = 'truncated') AS truncated, COUNT(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM paired GROUP BY 1),
nexts(q, x, q2, role) AS (VALUES (0, 's', 1, ''), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
inserts AS (SELECT q, q AS q2, 0 AS cost, '' AS letter, CAST([] AS VARCHAR[]) AS lines FROM (VALUES (0), (1), (2), (3)) t(q) UNION ALL SELECT q, q2, 5, 'I', [role || ':'] FROM nexts WHERE x <> 's'),
edges AS (
 SELECT q, q2, cost + 2 AS cost, RPAD(letter || 'D', 2, ' ') AS slot, lines, 'D' AS op, '' AS x, '' AS role FROM inserts
 UNION ALL SELECT i.q, o.q2, cost, RPAD(letter || 'K', 2, ' '), lines, 'K', x, '' FROM inserts i JOIN nexts o ON o.q = i.q2
 UNION ALL SELECT i.q, o.q2, cost + 1, RPAD(letter || 'R', 2, ' '), lines, 'R', x, o.role FROM inserts i JOIN nexts o ON o.q = i.q2 WHERE x <> 's'),
dp AS (
 SELECT conv_id, CAST(0 AS BIGINT) AS n, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM facts
 UNION ALL
 SELECT conv_id, n, q, cost, audit, lines FROM (
  SELECT r.conv_id, r.n, e.q2 AS q, dp.cost + e.cost + CASE WHEN e.op <> 'D' AND r.fault = 'truncated' THEN 5 ELSE 0 END AS cost, dp.audit || e.slot AS audit,
   dp.lines || e.lines || CASE e.op WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [r.role || ':' || r.text] ELSE [e.role || ':' || r.text] END AS lines
  FROM dp JOIN faults r ON r.conv_id = dp.conv_id AND r.n = dp.n + 1 JOIN edges e ON e.q = dp.q AND (e.op = 'D' OR (r.fault NOT IN ('blank', 'duplicate') AND (e.op = 'R' OR e.x = r.x)))
  QUALIFY ROW_NUMBER() OVER (PARTITION BY r.conv_id, e.q2 ORDER BY dp.cost + e.cost + CASE WHEN e.op <> 'D' AND r.fault = 'truncated' THEN 5 ELSE 0 END, dp.audit || e.slot) = 1)),
ends AS (
 SELECT conv_id, cost, audit || ' ' AS audit, lines FROM dp JOIN facts USING (conv_id) WHERE n = rows_ AND q IN (0, 3)
 UNION ALL SELECT conv_id, cost + 5, audit || 'I', lines || ['assistant:'] FROM dp JOIN facts USING (conv_id) WHERE n = rows_ AND q = 2),
best AS (SELECT * FROM ends QUALIFY ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, COALESCE(cost, 0) AS cost,
 COALESCE(REPLACE(audit, ' ', ''), '') AS audit, SHA256(COALESCE(ARRAY_TO_STRING(lines, CHR(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN facts USING (conv_id) LEFT JOIN best USING (conv_id)
"""

ORACLES = {"op11_conversation_repair": CONVERSATION_REPAIR, "op12_fill_in_middle": FILL_IN_MIDDLE}
