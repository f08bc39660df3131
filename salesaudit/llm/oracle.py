"""SQL counterparts of the subpackage's queries, where SQL can express them."""

from __future__ import annotations

OP9 = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP2 = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -1, turn, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)
), told AS (
    -- a turn is escaped only where its plain form would be read as something else
    SELECT *, contains(role, '<|im_start|>') OR contains(text, '<|im_start|>') OR contains(text, '<|im_end|>')
           OR contains(role, chr(10)) OR contains(role, '<|line|>')
           OR regexp_matches(role, '<\\\\+\\|') OR regexp_matches(text, '<\\\\+\\|') AS conflict
    FROM turns
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN conflict
                     THEN length(replace(regexp_replace(role, '<(\\\\*)\\|', '<\\1\\\\|', 'g'), chr(10), '<|line|>'))
                        + length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g'))
                     ELSE length(role) + length(text) END
              + length('<|im_start|>') + length('<|im_end|>') + 2) AS BIGINT) AS formatted_chars,
       true AS identical
FROM told
GROUP BY conv_id
"""

OP5 = """
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS row_no, doc_id,
           list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), sets AS (
    SELECT row_no, doc_id,
           CASE WHEN len(w) < 2 THEN w
                ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s
    FROM words
), texts AS (
    SELECT min(row_no) AS node, s FROM sets WHERE len(s) > 0 GROUP BY s
), items AS (
    SELECT node, len(s) AS n, unnest(s) AS item FROM texts
), links AS (
    SELECT a.node AS u, b.node AS v
    FROM items a JOIN items b ON a.item = b.item AND a.node <> b.node
    GROUP BY a.node, b.node
    HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reached AS (
    SELECT node AS u, node AS v FROM texts
    UNION
    SELECT reached.u, links.v FROM reached JOIN links ON reached.v = links.u
), classes AS (
    SELECT u, min(v) AS class FROM reached GROUP BY u
), placed AS (
    SELECT sets.doc_id, len(sets.s) AS n_shingles, coalesce(classes.class, -sets.row_no) AS class
    FROM sets LEFT JOIN texts ON sets.s = texts.s LEFT JOIN classes ON classes.u = texts.node
)
SELECT doc_id, n_shingles, min(doc_id) OVER same AS component_id,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept
FROM placed
WINDOW same AS (PARTITION BY class)
"""

OP12 = """
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
           sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), draws AS (
    SELECT doc_id, t, n,
           CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
           CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
    FROM texts
), forms AS (
    SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
           CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM draws
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form
           WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
           WHEN 'spm' THEN '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a)
           ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM forms
"""

SQL: dict[str, str] = {
    "op2_chat_formatting": OP2,
    "op5_minhash_near_dedup": OP5,
    "op9_exact_dedup": OP9,
    "op12_fill_in_middle": OP12,
}
