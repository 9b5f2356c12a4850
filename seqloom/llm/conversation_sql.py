"""DuckDB SQL that the conversation queries must equal."""

from __future__ import annotations


def crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda c, e: {step}), 4294967295)"


TRIE = f"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS no
    FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
    SELECT conv_id, conv_id - conv_id % 20 AS giver, {crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM t)
), m AS (
    SELECT i.conv_id, 0 AS part, t.no, t.role, t.text FROM ids i JOIN t ON t.conv_id = i.giver AND t.no <= i.h
    UNION ALL
    SELECT i.conv_id, 1, t.no, t.role, t.text FROM ids i JOIN t ON t.conv_id = i.conv_id AND t.no > i.h
), r AS (
    SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, no) AS depth,
           sha256(length(role) || ':' || role || text) AS own
    FROM m
), p AS (
    SELECT conv_id, depth, string_agg(own, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix,
           len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
    FROM r
    UNION ALL
    SELECT conv_id, 0, '', 0 FROM ids
), nodes AS (
    SELECT depth, prefix, min(conv_id) AS node, count(*) AS n, max(words) AS words FROM p GROUP BY depth, prefix
), path AS (
    SELECT p.conv_id, p.depth, nodes.node, nodes.n, nodes.words, max(p.depth) OVER (PARTITION BY p.conv_id) AS length
    FROM p JOIN nodes USING (depth, prefix)
), own AS (
    SELECT a.node, a.depth, a.n, a.words, up.node AS parent
    FROM path a LEFT JOIN path up ON up.conv_id = a.conv_id AND up.depth = a.depth - 1
    WHERE a.conv_id = a.node
), kids AS (
    SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM own WHERE depth > 0 GROUP BY 1, 2
), sums AS (
    SELECT a.node, a.depth, count(*) FILTER (kids.n IS NULL) AS leaves, sum((b.n - 1) * b.words) AS saved
    FROM own b JOIN path a ON a.conv_id = b.node AND a.depth <= b.depth
    LEFT JOIN kids ON kids.node = b.node AND kids.depth = b.depth
    GROUP BY 1, 2
), ends AS (
    SELECT node, depth, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
    FROM path WHERE depth = length GROUP BY 1, 2
)
SELECT own.node AS conv_id, own.depth, own.parent AS parent_conv_id, own.n AS n_convs,
       coalesce(kids.n, 0) AS n_children, sums.leaves AS n_leaves,
       CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM own JOIN sums ON sums.node = own.node AND sums.depth = own.depth
LEFT JOIN kids ON kids.node = own.node AND kids.depth = own.depth
LEFT JOIN ends ON ends.node = own.node AND ends.depth = own.depth
"""

_KEY = "coalesce(CAST(c.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(c.turn AS VARCHAR), ' ')"

REPAIR = f"""
WITH RECURSIVE ids AS (
    SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS g FROM (SELECT DISTINCT conv_id FROM conversations)
), k AS (
    SELECT ids.g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32(_KEY)} % 20 AS kind
    FROM conversations c JOIN ids ON c.conv_id IS NOT DISTINCT FROM ids.conv_id
), d AS (
    SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM k WHERE kind <> 0
), r AS (
    SELECT g, turn, role, text, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS no FROM d
), f AS (
    SELECT g, no, turn, role, text, CASE WHEN left(role, 1) IN ('u', 'a', 's') THEN left(role, 1) ELSE '-' END AS i,
           CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1
                WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY no) > 1 THEN 2
                WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 3
                ELSE 0 END AS fault
    FROM r
), back AS (
    SELECT g, max(no) + 1 AS no, 0 AS v0, 6 AS v1, 3 AS v2, 0 AS v3 FROM f GROUP BY g
    UNION ALL
    SELECT g, no, least(w0, 3 + w2, 6 + w3), least(w1, 3 + w2, 6 + w3), least(w2, 3 + w3), least(w3, 3 + w2)
    FROM (
        SELECT f.g, f.no,
               least(4 + v0, CASE i WHEN 'u' THEN add + v2 WHEN 's' THEN add + v1 END, add + 3 + v2) AS w0,
               least(4 + v1, CASE i WHEN 'u' THEN add + v2 END, add + 3 + v2) AS w1,
               least(4 + v2, CASE i WHEN 'a' THEN add + v3 END, add + 3 + v3) AS w2,
               least(4 + v3, CASE i WHEN 'u' THEN add + v2 END, add + 3 + v2) AS w3
        FROM back JOIN (SELECT g, no, i, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 3 END AS add FROM f) f
             ON f.g = back.g AND f.no = back.no - 1
    )
), go AS (
    SELECT back.g, back.no, f.i, f.role, f.text, CASE f.fault WHEN 0 THEN 0 WHEN 3 THEN 3 END AS add, [v0, v1, v2, v3] AS v,
           lead([v0, v1, v2, v3]) OVER (PARTITION BY back.g ORDER BY back.no) AS w
    FROM back LEFT JOIN f ON f.g = back.g AND f.no = back.no
), path AS (
    SELECT g, CAST(1 AS BIGINT) AS no, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines
    FROM (SELECT DISTINCT g FROM f)
    UNION ALL
    SELECT g, CASE letter WHEN 'I' THEN no ELSE no + 1 END,
           CASE WHEN letter = 'D' THEN q WHEN letter = 'K' AND i = 's' THEN 1 WHEN q = 2 THEN 3 ELSE 2 END,
           cost + CASE letter WHEN 'D' THEN 4 WHEN 'I' THEN 3 WHEN 'K' THEN add ELSE 3 + add END,
           audit || letter,
           CASE WHEN letter = 'D' THEN lines ELSE list_append(lines,
               CASE WHEN letter = 'K' THEN role WHEN q = 2 THEN 'assistant' ELSE 'user' END || ':' ||
               CASE WHEN letter = 'I' THEN '' ELSE text END) END
    FROM (
        SELECT path.*, go.i, go.role, go.text, go.add,
               CASE WHEN w IS NOT NULL AND 4 + w[q + 1] = v[q + 1] THEN 'D'
                    WHEN 3 + v[CASE q WHEN 2 THEN 4 ELSE 3 END] = v[q + 1] THEN 'I'
                    WHEN add + CASE WHEN i = 's' AND q = 0 THEN w[2] WHEN i = 'a' AND q = 2 THEN w[4]
                                    WHEN i = 'u' AND q <> 2 THEN w[3] END = v[q + 1] THEN 'K'
                    WHEN w IS NOT NULL THEN 'R' END AS letter
        FROM path JOIN go ON go.g = path.g AND go.no = path.no
    ) WHERE letter IS NOT NULL
), done AS (
    SELECT g, arg_max(cost, length(audit)) AS cost, max(audit) AS audit, arg_max(lines, length(audit)) AS lines
    FROM path GROUP BY g
), facts AS (
    SELECT g, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
           count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
           count(*) FILTER (fault = 3) AS truncated,
           count(*) FILTER (no > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT *, lag(i) OVER (PARTITION BY g ORDER BY no) AS before FROM f) GROUP BY g
)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN facts USING (g) LEFT JOIN done USING (g)
"""
