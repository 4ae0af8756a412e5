"""SQL for the queries that SQL can express."""

OP2 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g USING (text)
"""

# Sets of 5-word runs, all pairs that share one, and the documents that links reach.
OP11 = r"""
WITH RECURSIVE
d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM d
),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
often AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
f AS MATERIALIZED (SELECT doc_id, n, g FROM e SEMI JOIN often USING (g)),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM f x JOIN f y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2, "op11_ngram_join": OP11}
