"""DuckDB SQL of the operators whose whole result SQL expresses, by query name."""

from __future__ import annotations

#: Windows are joined words: words hold no blank, so equal strings are equal sequences. Rows are numbered, as copies may share an id.
SUBSTRING = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
windows AS (
  SELECT r, i, array_to_string(words[i : i + 34], ' ') AS seq
  FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM texts WHERE len(words) >= 35)
),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY seq) AS times FROM windows) WHERE times > 1),
removed AS (SELECT DISTINCT r, i + k AS i FROM repeated, range(0, 35) AS t(k)),
each AS (SELECT r, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM texts),
kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS rest FROM each ANTI JOIN removed USING (r, i) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(rest, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""

#: All pairs of a label, then whatever is reachable over links.
EMBEDDINGS = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM vectors AS a JOIN vectors AS b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
reached AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT vec_id, b AS other FROM reached JOIN links ON other = a
),
components AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(component_id AS BIGINT) AS component_id, vec_id = component_id AS kept
FROM embeddings JOIN components USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

#: DuckDB's length and substring count code points, as the operator does.
FILL_IN_MIDDLE = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
),
h AS (
  SELECT doc_id, t, n, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (n + 1) AS p1, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (n + 1) AS p2,
    CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 AS h4 FROM drawn
),
cut AS (
  SELECT doc_id, t, n, least(p1, p2) AS a, greatest(p1, p2) AS b, h4,
    n = 0 OR h3 >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM h
),
parts AS (
  SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf,
    CASE WHEN plain THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN NOT plain THEN CAST(a AS BIGINT) END AS prefix_chars,
  CASE WHEN NOT plain THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""

ORACLE_SQL: dict[str, str] = {"op11_fill_in_middle": FILL_IN_MIDDLE, "op6_substring_dedup": SUBSTRING, "op10_embedding_near_dedup": EMBEDDINGS}
