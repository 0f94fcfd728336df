"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str, pattern: str) -> str:
    """Words of a text, A-Z in lower case; none for null."""
    return f"coalesce(regexp_extract_all(translate({column}, '{_UPPER}', '{_LOWER}'), '{pattern}'), [])"


OP5 = f"""
WITH d AS (SELECT doc_id, {_words("text", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS w FROM documents)
, b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS w FROM benchmark)
, bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s : s + 9], ' ') AS part
         FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0))
, dw AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS part
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
               FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n))
, hit AS (SELECT dw.doc_id, dw.s, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.part = bw.part)
, places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1)
, items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text", "[^\\x20\\x09-\\x0D]+")} AS w FROM documents)
, sh AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + 2], ' ') AS part
         FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM d WHERE len(w) > 0))
, sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1)
, both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.part = b.part AND a.doc_id <> b.doc_id
            GROUP BY 1, 2)
, links AS (SELECT x, y FROM both_ JOIN sz p ON p.doc_id = x JOIN sz q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c))
, reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other)
SELECT d.doc_id, CAST(coalesce(max(sz.n), 0) AS BIGINT) AS n_shingles, min(reach.other) AS component_id
FROM d JOIN reach USING (doc_id) LEFT JOIN sz USING (doc_id) GROUP BY 1
"""

OP11 = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
, s AS (SELECT a.id AS anchor_id, a.label = b.label AS same, b.id AS id,
               CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id)
, p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""

OP12 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
, x AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d))
, k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                          '{_UPPER}', '{_LOWER}') AS key FROM x)
, r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
, o AS (SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id < r.last AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM o GROUP BY doc_id
"""
