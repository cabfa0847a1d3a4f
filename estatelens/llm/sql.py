"""DuckDB SQL for the numbered queries that SQL can express."""

ORACLES: dict[str, str] = {}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLES["op3_decontamination"] = rf"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS length, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT DISTINCT CAST(doc_id AS BIGINT) AS doc_id, text, {_WORDS} AS w FROM documents),
places AS (
  SELECT doc_id, text, length, i - 1 AS start, array_to_string(list_slice(w, i, i + length - 1), ' ') AS win
  FROM (SELECT doc_id, text, w, length, unnest(range(1, len(w) - length + 2)) AS i
        FROM docs, (SELECT DISTINCT length FROM windows) WHERE len(w) >= length)),
hits AS (SELECT p.doc_id, p.text, p.start, p.length, w.item FROM places p JOIN windows w ON p.length = w.length AND p.win = w.win),
covered AS (
  SELECT doc_id, text, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, text, unnest(range(start, start + length)) AS pos FROM hits) GROUP BY doc_id, text),
found AS (
  SELECT doc_id, text, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed
  FROM hits GROUP BY doc_id, text)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.listed, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d
LEFT JOIN covered c ON c.doc_id IS NOT DISTINCT FROM d.doc_id AND c.text IS NOT DISTINCT FROM d.text
LEFT JOIN found f ON f.doc_id IS NOT DISTINCT FROM d.doc_id AND f.text IS NOT DISTINCT FROM d.text
"""
