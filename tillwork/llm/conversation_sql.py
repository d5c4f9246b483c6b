"""The SQL of op13: the same damage, faults and least-cost edits by a recursion over each conversation's rows, best path of every state."""

from __future__ import annotations

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_EIGHT = "[0, 0, 0, 0, 0, 0, 0, 0]"
# States: 0 nothing said, 1 the system turn, 2 a user turn last, 3 an assistant turn last.
SQL = f"""WITH RECURSIVE rows0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    marked AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, strlen(k) + 1), lambda i: ascii(k[i])::BIGINT),
        lambda c, b: list_reduce([xor(c, b)] || {_EIGHT}::BIGINT[], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS kind FROM rows0),
    damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
        FROM marked WHERE kind <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos, rtrim(text, {_SPACES}) AS bare FROM damaged),
    faulty AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
        WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault, left(role, 1) AS c,
        left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair FROM placed),
    convs AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
        count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM faulty GROUP BY conv_id),
    said(st, after, cost, name, turns) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']),
        (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:'])),
    step(st, after, c) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')),
    edits AS (SELECT conv_id, pos, st.st, st.st AS after, 3 AS cost, 'D' AS name, []::VARCHAR[] AS turns FROM faulty, (VALUES (0), (1), (2), (3)) AS st(st)
        UNION ALL SELECT conv_id, pos, s.st, s.after, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'K', [role || ':' || text] FROM faulty f JOIN step s ON s.c = f.c
            WHERE fault IN ('fine', 'truncated')
        UNION ALL SELECT conv_id, pos, s.st, s.after, CASE WHEN fault = 'truncated' THEN 3 ELSE 2 END, 'R', [CASE s.c WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text]
            FROM faulty f JOIN step s ON s.c <> 's' WHERE fault IN ('fine', 'truncated')),
    best AS (SELECT conv_id, 0::BIGINT AS pos, 0 AS st, 0 AS cost, '' AS audit, []::VARCHAR[] AS turns FROM convs
        UNION ALL SELECT conv_id, pos, st, cost, audit, turns FROM (
            SELECT b.conv_id, e.pos, e.after AS st, b.cost + i.cost + e.cost AS cost, b.audit || i.name || e.name AS audit, b.turns || i.turns || e.turns AS turns
            FROM best b JOIN said i ON i.st = b.st JOIN edits e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.pos = b.pos + 1 AND e.st = i.after)
        QUALIFY row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) = 1),
    ended AS (SELECT v.conv_id, b.cost + i.cost AS cost, b.audit || i.name AS audit, b.turns || i.turns AS turns FROM best b JOIN convs v ON v.conv_id IS NOT DISTINCT FROM b.conv_id AND v.n = b.pos
        JOIN said i ON i.st = b.st WHERE i.after IN (0, 3) QUALIFY row_number() OVER (PARTITION BY v.conv_id ORDER BY b.cost + i.cost, b.audit || i.name) = 1)
    SELECT o.conv_id, coalesce(v.gaps, 0) AS gaps, coalesce(v.blank, 0) AS blank, coalesce(v.duplicate, 0) AS duplicate, coalesce(v.truncated, 0) AS truncated,
        coalesce(v.illegal, 0) AS illegal, CAST(coalesce(e.cost, 0) AS BIGINT) AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.turns, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN convs v ON v.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""
