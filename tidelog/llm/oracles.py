"""Independent SQL of the training-data queries that SQL can express."""

SPLIT = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{SPLIT}'), lambda w: w <> '')"


_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = """
WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
n AS (
  SELECT conv_id, turn AS at, max(coalesce(text, '')) AS answer FROM c
  WHERE role = 'assistant' AND (conv_id, turn) IN (SELECT (conv_id, max(turn)) FROM c WHERE role = 'assistant' GROUP BY conv_id) GROUP BY conv_id, turn),
t AS (
  SELECT conv_id AS pair_id, 0 AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c
  UNION ALL
  SELECT c.conv_id, 1, c.turn, coalesce(c.role, ''), coalesce(CASE WHEN c.role = 'assistant' AND c.turn = n.at AND o.answer IS NOT NULL THEN o.answer ELSE c.text END, '')
  FROM c LEFT JOIN n ON n.conv_id = c.conv_id LEFT JOIN n o ON o.conv_id = xor(c.conv_id, 1)),
d AS (
  SELECT pair_id, turn, list_sort(list(role || chr(31) || text) FILTER (WHERE side = 0)) AS a, list_sort(list(role || chr(31) || text) FILTER (WHERE side = 1)) AS b
  FROM t GROUP BY pair_id, turn),
f AS (SELECT pair_id, min(turn) FILTER (WHERE a IS DISTINCT FROM b) AS fork FROM d GROUP BY pair_id),
r AS (
  SELECT t.*, fork IS NULL OR turn < fork AS shared,
    '<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(text, '<|', '< |') || chr(10) || '<|end|>' || chr(10) AS said,
    length(replace(role, '<|', '< |')) + 5 AS lead
  FROM t JOIN f USING (pair_id)),
p AS (SELECT *, CASE WHEN shared THEN 2 ELSE side END AS part FROM r WHERE NOT shared OR side = 0),
o AS (
  SELECT *, coalesce(sum(length(said)) OVER (PARTITION BY pair_id, part ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM p)
SELECT pair_id, count(*) FILTER (WHERE part = 2) AS n_prompt_turns,
  coalesce(string_agg(said, '' ORDER BY pos) FILTER (WHERE part = 2), '') AS prompt,
  coalesce(string_agg(said, '' ORDER BY pos) FILTER (WHERE part = 0), '') AS chosen,
  coalesce(string_agg((pos + lead)::BIGINT || '-' || (pos + length(said))::BIGINT, ',' ORDER BY pos) FILTER (WHERE part = 0 AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(said, '' ORDER BY pos) FILTER (WHERE part = 1), '') AS rejected,
  coalesce(string_agg((pos + lead)::BIGINT || '-' || (pos + length(said))::BIGINT, ',' ORDER BY pos) FILTER (WHERE part = 1 AND role = 'assistant'), '') AS rejected_spans
FROM o GROUP BY pair_id
"""

_SETS = f"""
w AS MATERIALIZED (SELECT doc_id, {_words(_ASCII_LOWER)} AS ws FROM {{docs}}),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [list_aggregate(ws, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4]) END) AS g
  FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM {{docs}} UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id WHERE r.root < l.b)
"""

OP4 = f"""
WITH RECURSIVE {_SETS.format(docs="documents")}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

OP6 = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id WHERE r.root < l.b),
c AS (SELECT vec_id, min(root) AS root FROM r GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.root AS component_id, c.root = e.vec_id AS kept
FROM embeddings e JOIN c USING (vec_id)
"""

_WINDOWS = f"""
w AS MATERIALIZED (SELECT doc_id, {_words("text")} AS ws FROM {{docs}}),
p AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
k AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, unnest(list_transform(range(1, len(ws) - 48), lambda i: sha256(list_aggregate(ws[i : i + 49], 'string_agg', ' ')))) AS h FROM w WHERE len(ws) >= 50),
o AS MATERIALIZED (SELECT h, min(doc_id) AS owner FROM k GROUP BY h),
x AS MATERIALIZED (SELECT k.doc_id, k.i FROM k JOIN o USING (h) WHERE owner < doc_id),
z AS MATERIALIZED (SELECT p.*, count(x.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone FROM p LEFT JOIN x ON x.doc_id = p.doc_id AND x.i = p.i)
"""

OP7 = f"""
WITH {_WINDOWS.format(docs="documents")}
SELECT d.doc_id, count(z.i) AS n_words, count(*) FILTER (WHERE z.gone) AS n_removed, sha256(coalesce(string_agg(z.word, ' ' ORDER BY z.i) FILTER (WHERE NOT z.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id GROUP BY d.doc_id
"""

ORACLES: dict[str, str] = {"op2_preference_formatting": OP2, "op4_jaccard_join": OP4, "op6_embedding_dedup": OP6, "op7_substring_dedup": OP7}
