"""The SQL of op5, op3 and op7: every window, byte string or shingle is written out and counted or joined."""

from __future__ import annotations

_NUMBERED = "(SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"
WINDOWS = f"""WITH w AS MATERIALIZED (SELECT r, doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM {_NUMBERED}),
    win AS MATERIALIZED (SELECT r, i, md5(array_to_string(words[i:i + 34], ' ')) AS s FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM w)),
    hits AS (SELECT r, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
    gone AS (SELECT DISTINCT r, i + o AS p FROM hits, (SELECT unnest(range(0, 35)) AS o)),
    kept AS (SELECT x.r, string_agg(word, ' ' ORDER BY p) AS words, count(*) AS n FROM (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w) x
        ANTI JOIN gone USING (r, p) GROUP BY x.r)
    SELECT doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.words, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (r)"""
BYTES = f"""WITH d AS MATERIALIZED (SELECT r, doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM {_NUMBERED}),
    win AS MATERIALIZED (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS s FROM (SELECT r, h, unnest(range(0, n - 399)) AS i FROM d)),
    hits AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
    runs AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM hits),
    spans AS (SELECT r, k, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY r, k),
    cuts AS (SELECT r, k, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY k) AS past FROM spans),
    parts AS (SELECT c.r, string_agg(substr(h, 2 * past + 1, 2 * (a - past)), '' ORDER BY k) AS h, max(b) AS past, sum(b - a) AS gone, count(*) AS k FROM cuts c JOIN d USING (r) GROUP BY c.r)
    SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans,
        sha256(unhex(coalesce(p.h, '') || substr(d.h, 2 * coalesce(past, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN parts p USING (r)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEAR = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS words FROM {_NUMBERED}),
    sh AS MATERIALIZED (SELECT DISTINCT r, md5(array_to_string(words[i:i + 4], ' ')) AS s FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 3, least(len(words), 1) + 1))) AS i FROM w)),
    size AS MATERIALIZED (SELECT r, count(*) AS n FROM sh GROUP BY r),
    same AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM same JOIN size x ON x.r = a JOIN size y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    reach AS (SELECT r, r AS o FROM w UNION SELECT reach.r, b FROM reach JOIN links ON a = o),
    least AS (SELECT reach.r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = o GROUP BY reach.r)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM w JOIN least USING (r) LEFT JOIN size USING (r)"""
