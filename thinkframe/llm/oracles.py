"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from thinkframe.llm.license_rules import CONFIDENCE, rules


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op1() -> str:
    """The scan's rules as a table; detections, suppression and digest in SQL."""
    table = ", ".join(f"({r.number}, {r.tier}, {_quoted(r.label)}, {_quoted(r.literal)}, {_quoted(r.regex)})" for r in rules())
    confidence = " ".join(f"WHEN {tier} THEN {value}" for tier, value in CONFIDENCE.items())
    return rf"""
WITH rule(number, tier, label, keyword, regex) AS (VALUES {table}),
d AS (
  SELECT doc_id, ' ' || trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g')) || ' ' AS n
  FROM documents
), w AS (SELECT doc_id, n, CASE WHEN n = '  ' THEN 0 ELSE (length(n) - length(replace(n, ' ', ''))) // 2 END AS n_words FROM d),
m AS (
  SELECT doc_id, number, tier, label, regexp_split_to_array(n, regex) AS gaps, regexp_extract_all(n, regex) AS hits
  FROM w JOIN rule ON contains(n, keyword)
), p AS (
  SELECT doc_id, number, tier, label, i, (length(gaps[i]) - length(replace(gaps[i], ' ', ''))) // 2 AS gap, (length(hits[i]) - length(replace(hits[i], ' ', ''))) // 2 AS hit
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)
), s AS (
  SELECT doc_id, number, tier, label, sum(gap + hit) OVER (PARTITION BY doc_id, number ORDER BY i) AS stop, hit FROM p
), t AS (SELECT *, stop - hit AS start FROM s),
kept AS (
  SELECT * FROM t a WHERE a.tier = 0 OR NOT EXISTS (
    SELECT 1 FROM t b WHERE b.doc_id = a.doc_id AND b.tier BETWEEN 1 AND a.tier AND b.start <= a.start AND b.stop >= a.stop
      AND (b.start < a.start OR b.stop > a.stop OR b.tier < a.tier OR (b.tier = a.tier AND b.number < a.number)))
), g AS (
  SELECT doc_id, count(*) FILTER (tier = 0) AS n_base, min(start) FILTER (tier = 0) AS first_word, max(start) FILTER (tier = 0) AS last_word,
    array_to_string(list_sort(list_distinct(list(label) FILTER (tier = 0))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(CASE tier {confidence} END) AS score, count(*) AS n_detections
  FROM kept GROUP BY doc_id
)
SELECT w.doc_id, n_words::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score, coalesce(n_detections, 0)::BIGINT AS n_detections
FROM w LEFT JOIN g USING (doc_id)
"""


OP9 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other),
comp AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS c FROM link GROUP BY a)
SELECT comp.vec_id, coalesce(n.c, 0)::BIGINT AS n_links, component_id, comp.vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
"""

OP10 = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT r, doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS g FROM w
), n AS (SELECT r, count(*) AS c FROM s GROUP BY r),
shared AS (SELECT x.r AS p, y.r AS q, any_value(x.doc_id) AS a, any_value(y.doc_id) AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.r, y.r),
link AS (SELECT DISTINCT a, b FROM shared JOIN n x ON x.r = p JOIN n y ON y.r = q WHERE 100 * i >= 80 * (x.c + y.c - i)),
reach(doc_id, other) AS (SELECT DISTINCT doc_id, doc_id FROM w WHERE doc_id IS NOT NULL UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, component_id, coalesce(w.doc_id = component_id, w.doc_id IS NULL) AS kept
FROM w LEFT JOIN comp ON comp.doc_id = w.doc_id LEFT JOIN n ON n.r = w.r
"""

OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>|<SYS>>|</SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') AS safe FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(safe) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

def op12(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Codes by measuring every part against every entry in every round."""
    sql = rf"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS i, vec_id, label, x, len(x) // {parts} AS w
  FROM (SELECT vec_id, label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0)
), p AS MATERIALIZED (SELECT i, s, x[s * w + 1 : s * w + w] AS x, w FROM v, range({parts}) t(s)),
book0 AS (SELECT s, i - 1 AS e, x AS c FROM p WHERE i <= {entries})"""
    for r in range(rounds + 1):
        sql += f""",
near{r} AS MATERIALIZED (
  SELECT i, s, min(d * {entries} + e) % {entries} AS e, min(d) AS d
  FROM (SELECT i, p.s, e, list_sum(list_transform(range(1, w + 1), lambda j: (x[j] - c[j]) * (x[j] - c[j])))::BIGINT AS d FROM p JOIN book{r} b ON b.s = p.s) GROUP BY i, s
)"""
        if r < rounds:
            sql += f""",
mean{r} AS (
  SELECT s, e, list(m ORDER BY j) AS c FROM (
    SELECT n.s, n.e, j, floor(sum(x[j]) / count(*))::BIGINT AS m FROM near{r} n JOIN p USING (i, s), range(1, w + 1) t(j) GROUP BY n.s, n.e, j
  ) GROUP BY s, e
),
book{r + 1} AS MATERIALIZED (SELECT b.s, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON m.s = b.s AND m.e = b.e)"""
    return sql + f""",
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY s, e)) AS h FROM book{rounds}),
codes AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY s) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY i)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM codes JOIN v USING (i), sha
"""


OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s, row_number() OVER () AS r FROM documents
), w AS (SELECT *, row_number() OVER g AS place, first(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY s) AS n FROM d WINDOW g AS (PARTITION BY s ORDER BY length(t) DESC, doc_id NULLS LAST, r))
SELECT doc_id, keep_id, n::BIGINT AS group_size, place = 1 AS kept, sha256(s) AS text_sha256 FROM w
"""

ORACLES: dict[str, str] = {
    "op1_license_scan": op1(),
    "op7_chat_formatting": OP7,
    "op9_embedding_near_dedup": OP9,
    "op10_minhash_near_dedup": OP10,
    "op12_vector_codes": op12(),
    "op13_exact_dedup": OP13,
}
