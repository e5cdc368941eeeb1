"""DuckDB SQL for the queries that SQL can express over the whole tables."""

from __future__ import annotations

# 4-word shingles of lower-cased texts; pairs that share a shingle are counted in full.
_MINHASH = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n_a, any_value(b.n) AS n_b, count(*) AS shared
  FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (n_a + n_b - shared)),
two AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, far) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.node, t.b FROM reach r JOIN two t ON r.far = t.a),
root AS (SELECT node, min(far) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sets s JOIN root r ON r.node = s.doc_id
"""

_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || CAST(doc_id AS VARCHAR)) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM totals),
filled AS (
  SELECT *, cap / w AS ratio,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM placed),
level AS (
  SELECT min_by((1.5::DOUBLE * (SELECT sum(source_size) FROM totals) - held) / open, ratio) AS lvl
  FROM filled WHERE ratio >= (1.5::DOUBLE * (SELECT sum(source_size) FROM totals) - held) / open),
goal AS (
  SELECT source, source_size, CASE WHEN cap < lvl * w THEN cap ELSE lvl * w END AS target FROM placed, level),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM goal),
run AS (
  SELECT s.doc_id, s.size, c.source_size, c.target, c.whole, CAST(floor(c.target) AS BIGINT) - c.whole * c.source_size AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN cut c ON s.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + least(greatest(rest - before, 0), size) AS BIGINT) AS taken
FROM run
"""

_EMBEDDINGS = r"""
WITH RECURSIVE sound AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id < b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
two AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, far) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.node, t.b FROM reach r JOIN two t ON r.far = t.a),
root AS (SELECT node, min(far) AS component_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM two GROUP BY a)
SELECT r.node AS vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, r.component_id, r.node = r.component_id AS kept
FROM root r LEFT JOIN degree d ON d.a = r.node
"""

# Pages of a source with the same text count as one.
_LINES = r"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS l FROM documents),
apart AS (SELECT DISTINCT source, text, l FROM pages),
counted AS (
  SELECT source, line, count(*) AS pages FROM (SELECT source, unnest(list_distinct(l)) AS line FROM apart)
  WHERE trim(line, ' ') <> '' GROUP BY source, line),
totals AS (SELECT source, count(*) AS pages FROM apart GROUP BY source),
boiler AS (
  SELECT c.source, list(c.line) AS gone FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.pages >= 5 AND c.pages >= 0.005::DOUBLE * t.pages GROUP BY c.source),
left_over AS (
  SELECT p.doc_id, p.text, p.l,
         list_filter(p.l, lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(b.gone, []), x)) AS k
  FROM pages p LEFT JOIN boiler b ON p.source IS NOT DISTINCT FROM b.source),
kept AS (
  SELECT doc_id, text, l,
         CASE WHEN length(array_to_string(k, '')) < 0.5::DOUBLE * length(array_to_string(l, '')) THEN l ELSE k END AS k
  FROM left_over)
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l) - len(k), 0) AS BIGINT) AS n_dropped,
       CASE WHEN text IS NULL THEN NULL WHEN len(k) < len(l) THEN array_to_string(k, chr(10)) ELSE text END AS text
FROM kept
"""

_RANKING = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
sized AS (SELECT doc_id, t, len(t) AS n FROM split WHERE len(t) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_all FROM sized),
held AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM sized) GROUP BY 1, 2, 3),
spread AS (SELECT term, count(*) AS df FROM held GROUP BY term),
asked AS (
  SELECT item_id, term, count(*) AS r FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY 1, 2),
weighed AS (
  SELECT a.item_id, a.term, a.r * CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM asked a JOIN spread s ON a.term = s.term, total),
scored AS (
  SELECT q.item_id, h.doc_id,
         CAST(sum(q.w * ((1000000000 * h.tf) // (1000 * h.tf + 8 * (25 + (75 * h.n * n_docs) // n_all)))) AS BIGINT) AS score
  FROM weighed q JOIN held h ON q.term = h.term, total GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 10
"""

SQL: dict[str, str] = {
    "op1_minhash": _MINHASH,
    "op2_mixing": _MIXING,
    "op4_embeddings": _EMBEDDINGS,
    "op9_line_dedup": _LINES,
    "op12_ranking": _RANKING,
}
