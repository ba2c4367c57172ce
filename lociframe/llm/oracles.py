"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

OP3 = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS h FROM pages),
 d AS (SELECT page_id, CAST(STRLEN(h) AS BIGINT) AS n, SHA256(h) AS s FROM p),
 f AS (SELECT *, MIN(page_id) OVER (PARTITION BY s) AS first FROM d)
SELECT page_id, n AS payload_bytes, s AS payload_digest,
 CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f"""

OP4 = """
WITH r AS (SELECT page_id, CASE WHEN INSTR(url, '://') > 0 THEN SUBSTRING(url, INSTR(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, rest, REGEXP_EXTRACT(COALESCE(rest, ''), '^[^/?#]*') AS raw FROM r),
 u AS (SELECT page_id, TRANSLATE(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, REGEXP_EXTRACT(SUBSTRING(COALESCE(rest, ''), LENGTH(raw) + 1), '^[^?#]*') AS path FROM h),
 q AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS v(rh, rp, verdict)),
 m AS (SELECT u.page_id, ARG_MAX(rh || rp, LENGTH(rh || rp)) AS rule, ARG_MAX(verdict, LENGTH(rh || rp)) AS verdict
  FROM u JOIN q ON (u.host = rh OR ENDS_WITH(u.host, '.' || rh)) AND STARTS_WITH(u.path, rp) GROUP BY u.page_id)
SELECT u.page_id, host, path, m.rule, COALESCE(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id"""

def _way(w: str, cost: str, letters: str) -> str:
    """A way (cost in nine digits, then the audit) with more edits, in SQL."""
    return f"(LPAD(CAST(CAST(LEFT({w}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || SUBSTR({w}, 10) || '{letters}')"


_SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_KEEP = lambda w, c: f"CASE WHEN LOWER(c) = '{c}' THEN {_way(w, 'e', 'K')} END"
_ROLE = lambda w: f"CASE WHEN c <> '-' THEN {_way(w, '(3 + e)', 'R')} END"

OP12 = f"""
WITH RECURSIVE tb AS (SELECT LIST_TRANSFORM(RANGE(256), lambda i: LIST_REDUCE(RANGE(8), lambda c, k: CASE WHEN c % 2 = 1 THEN XOR(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
 kx AS (SELECT conv_id, turn, COALESCE(role, ' ') AS r0, COALESCE(text, ' ') AS t0, XOR(LIST_REDUCE(LIST_TRANSFORM(STRING_SPLIT(COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ORD(x) AS BIGINT)), lambda c, b: XOR(c >> 8, t[(XOR(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS k FROM conversations, tb),
 dm AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE r0 END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN TRANSLATE(t0, '.!?', '') ELSE t0 END AS text, UNNEST(RANGE(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM kx WHERE k <> 0),
 o AS (SELECT *, LEFT(role, 1) AS ini, RTRIM(text, {_SPACE}) AS tr, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, SHA256(text), copy) - 1 AS pos FROM dm),
 f AS (SELECT *, CASE WHEN tr = '' THEN 'b' WHEN ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN RIGHT(tr, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, LAG(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini AS pair FROM o),
 cd AS (SELECT *, CASE WHEN fault IN ('b', 'd') THEN '-' WHEN fault = 't' THEN UPPER(CASE WHEN ini IN ('s', 'u', 'a') THEN ini ELSE 'x' END) WHEN ini IN ('s', 'u', 'a') THEN ini ELSE 'x' END AS c, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS e FROM f),
 w AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS w0, CAST(NULL AS VARCHAR) AS w1, CAST(NULL AS VARCHAR) AS w2, CAST(NULL AS VARCHAR) AS w3 FROM conversations
  UNION ALL
  SELECT conv_id, i + 1, {_way("n0", "4", "D")}, LEAST({_way("n1", "4", "D")}, {_KEEP("n0", "s")}),
   LEAST({_way("n2", "4", "D")}, {_ROLE("n0")}, {_ROLE("n1")}, {_ROLE("n3")}, {_KEEP("n0", "u")}, {_KEEP("n1", "u")}, {_KEEP("n3", "u")}), LEAST({_way("n3", "4", "D")}, {_ROLE("n2")}, {_KEEP("n2", "a")})
  FROM (SELECT w.conv_id, i, c, e, w0 AS n0, w1 AS n1, LEAST(w2, {_way("w0", "3", "I")}, {_way("w1", "3", "I")}, {_way("w3", "3", "I")}) AS n2, LEAST(w3, {_way("w2", "3", "I")}, {_way("w0", "6", "II")}, {_way("w1", "6", "II")}) AS n3
   FROM w JOIN cd ON w.conv_id = cd.conv_id AND cd.pos = w.i) q),
 la AS (SELECT conv_id, LEAST(w0, {_way("w1", "6", "II")}, {_way("w2", "3", "I")}, w3) AS v FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY i DESC) AS z FROM w) x WHERE z = 1),
 au AS (SELECT conv_id, CAST(LEFT(v, 9) AS BIGINT) AS cost, SUBSTR(v, 10) AS audit FROM la),
 lt AS (SELECT conv_id, g, SUBSTR(audit, g + 1, 1) AS l, g - (LENGTH(LEFT(audit, g)) - LENGTH(REPLACE(LEFT(audit, g), 'I', ''))) AS pos, g - (LENGTH(LEFT(audit, g)) - LENGTH(REPLACE(LEFT(audit, g), 'D', ''))) AS m FROM (SELECT *, UNNEST(RANGE(LENGTH(audit))) AS g FROM au) y),
 em AS (SELECT lt.conv_id, lt.g, l, m, role, text, MAX(CASE WHEN m = 0 AND l = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY lt.conv_id) AS s FROM lt LEFT JOIN cd ON lt.conv_id = cd.conv_id AND lt.pos = cd.pos WHERE l <> 'D'),
 tx AS (SELECT conv_id, STRING_AGG(CASE WHEN l = 'K' THEN role ELSE CASE WHEN (m + s) % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY g) AS body FROM em GROUP BY conv_id),
 ct AS (SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (fault = 'b') AS blank, COUNT(*) FILTER (fault = 'd') AS duplicate, COUNT(*) FILTER (fault = 't') AS truncated, COUNT(*) FILTER (pos > 0 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM cd GROUP BY conv_id)
SELECT au.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, cost, audit, SHA256(COALESCE(body, '')) AS repaired_sha256
FROM au LEFT JOIN ct ON au.conv_id = ct.conv_id LEFT JOIN tx ON au.conv_id = tx.conv_id"""

OP11 = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, LIST_TRANSFORM(embedding, lambda x: FLOOR(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.l = b.l AS same, CAST(LIST_DOT_PRODUCT(a.q, b.q) AS BIGINT) AS s FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
 p AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) AS k FROM s WHERE same) t WHERE k <= 5),
 n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.s AS positive_score, s.s AS negative_score, ROW_NUMBER() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.s DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3, "op4_urlrules": OP4, "op11_hardneg": OP11, "op12_repair": OP12}
