"""DuckDB SQL for the rows of the corpus queries whose contract SQL can express: written from the definitions alone,
without anchors, automata or shift tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ITEM_WORDS = rf"coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

#: Every window as a string, those that start at two places or more, the words under them.
OP2 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
windows AS (
  SELECT doc_id, i, word, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS win FROM words
  WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
),
marked AS (SELECT doc_id, i, word, n = 35 AND count(*) OVER (PARTITION BY win, n) > 1 AS again FROM windows),
covered AS (
  SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM marked
),
kept AS (
  SELECT doc_id, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS rest
  FROM covered GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

#: Base32 takes five hex digits of the SHA-1 at a time for four characters.
OP4 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, trim(regexp_replace(coalesce(url, ''), '\s+', ' ', 'g')) AS target_uri FROM pages
),
q AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first, sha1(body) AS h FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 1 + (k // 4) * 5, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, target_uri
FROM q
"""

#: Windows of items by their number of words, joined with the documents' windows of as many.
OP8 = rf"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
item_words AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, least(len(w), 13) AS n FROM b),
item_windows AS (
  SELECT DISTINCT item_id, n, win FROM (
    SELECT item_id, n, count(*) OVER f AS c, string_agg(word, ' ') OVER f AS win FROM item_words
    WINDOW f AS (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
  ) WHERE c = n
),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
doc_lists AS (
  SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS following FROM doc_words
),
hits AS (
  SELECT s.doc_id, s.i, s.n, item_id
  FROM (SELECT doc_id, i, n, array_to_string(following[1:n], ' ') AS win FROM doc_lists, sizes WHERE len(following) >= n) s
  JOIN item_windows USING (n, win)
),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS place FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS named
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

#: Lines by their keys; a key of ten documents takes its lines out, the rest is put together by position.
OP11 = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, common.key IS NOT NULL AS gone FROM k LEFT JOIN common ON k.key = common.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

#: Pieces by substring; the restored text must be the text.
OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
x AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS u, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS v, CAST('0x' || h[17:24] AS BIGINT) % 100 AS r, CAST('0x' || h[25:32] AS BIGINT) % 100 AS s FROM d),
y AS (SELECT doc_id, t, n, least(u, v) AS a, greatest(u, v) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r >= 90 THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
z AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS e FROM y)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM z
"""

#: Every document is put through every order: the first filter of the order that it fails removes it.
OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e FROM documents
),
marked AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), e] AS fails,
    CAST(coalesce(quality = 1, false) AS BIGINT) AS good, CAST(coalesce(toxic = 1, false) AS BIGINT) AS bad
  FROM d LEFT JOIN labels USING (doc_id)
),
kinds AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM marked GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
tried AS (
  SELECT k.*, filter_order, list_transform(string_split(filter_order, ''), lambda x: fails[ascii(x) - 64]) AS inorder FROM kinds k, orders
),
removed_at AS (SELECT *, coalesce(list_position(inorder, true), 6) AS gone FROM tried),
counted AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS x,
    CAST(coalesce(sum(n) FILTER (WHERE gone > step), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE gone = step), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE gone < step AND inorder[step]), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (WHERE inorder[step] AND len(list_filter(inorder, lambda f: f)) = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (WHERE gone = step), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(bad) FILTER (WHERE gone = step), 0) AS BIGINT) AS toxic_lost
  FROM removed_at, (SELECT unnest(range(1, 6)) AS step) GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM counted
"""

ORACLE_SQL: dict[str, str] = {
    "op2_substring": OP2,
    "op4_warc": OP4,
    "op8_decontamination": OP8,
    "op11_line_dedup": OP11,
    "op12_fill_in_middle": OP12,
    "op13_filter_audit": OP13,
}
