"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op8_byte_bpe
from .exact_search import op1_exact_search
from .gif import op4_gif_media
from .jaccard_join import op7_jaccard_join
from .language_id import op10_language_id
from .packing import op5_sequence_packing
from .scoring import op3_lm_scores
from .sharding import op9_byte_shards
from .suffix_dedup import op2_suffix_dedup
from .token_counts import op6_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_search,
        op2_suffix_dedup,
        op3_lm_scores,
        op4_gif_media,
        op5_sequence_packing,
        op6_token_counts,
        op7_jaccard_join,
        op8_byte_bpe,
        op9_byte_shards,
        op10_language_id,
    )
}

ORACLE_SQL = {
    "op1_exact_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op7_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id,
         list_filter(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
           lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE
    WHEN words IS NULL OR len(words) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(words) - 2),
           lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS sh
  FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
  GROUP BY ALL
), link AS (SELECT x, y FROM common WHERE 100 * c >= 90 * (nx + ny - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, r.component_id
FROM s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = s.doc_id
""",
}
