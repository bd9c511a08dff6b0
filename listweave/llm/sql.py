"""SQL with the results of those queries of this folder that it can express."""

from __future__ import annotations

OP11 = r"""
WITH doc AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), sized AS (
  SELECT *, len(terms)::BIGINT AS n FROM doc WHERE len(terms) > 0
), corpus AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sized
), item AS (
  SELECT row_number() OVER () AS item, item_id,
         regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark WHERE text IS NOT NULL
), asked AS (
  SELECT item, item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item, item_id, unnest(terms) AS term FROM item) GROUP BY ALL
), tf AS (
  SELECT row, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL
), weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term) CROSS JOIN corpus
), scored AS (
  SELECT item, item_id, row, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))
         )::BIGINT AS score
  FROM tf JOIN weight USING (term) JOIN asked USING (term) CROSS JOIN corpus
  GROUP BY ALL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 20
"""

OP12 = r"""
WITH doc AS (
  SELECT doc_id, encode(coalesce(text, '')) AS data FROM documents
), strings AS (
  SELECT doc_id, p, array_slice(data, p + 1, p + 50) AS string
  FROM (SELECT doc_id, data, unnest(range(0, octet_length(data) - 49)) AS p FROM doc)
), firsts AS (
  SELECT string, min(doc_id) AS first_doc FROM strings
  GROUP BY string HAVING min(doc_id) < max(doc_id)
), repeated AS (
  SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS step
  FROM strings JOIN firsts USING (string) WHERE doc_id > first_doc
), numbered AS (
  SELECT doc_id, p,
         sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS span
  FROM repeated
), spans AS (
  SELECT doc_id, span, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, span
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL
  SELECT doc_id, coalesce(max(b), 0), octet_length(any_value(data))
  FROM doc LEFT JOIN spans USING (doc_id) GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(hex(array_slice(data, a + 1, b)), '' ORDER BY a) AS rest
  FROM gaps JOIN doc USING (doc_id) GROUP BY doc_id
), removed AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, octet_length(data)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM doc JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

OP13 = r"""
WITH usable AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
         list_dot_product(a.q, b.q)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), banded AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM scored JOIN positive USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM banded WHERE rank <= 10
"""
