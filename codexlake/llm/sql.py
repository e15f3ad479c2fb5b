"""SQL for the pipeline queries that SQL can express, over the whole tables."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words are runs without blank, tab, line feed, vertical tab, form feed and carriage return.
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS w FROM documents
), s AS (
    SELECT doc_id, list_distinct(CASE
        WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
    FROM w
), n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT both_ways.b, r.c FROM r JOIN both_ways ON both_ways.a = r.doc_id)
SELECT doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, CAST(min(r.c) AS BIGINT) AS component_id
FROM n JOIN r USING (doc_id) GROUP BY doc_id
"""

OP2 = """
WITH v AS (
    SELECT vec_id, CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, unnest(generate_series(1, len(w) - 49)) AS i, w FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM x),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM k),
j AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS j, unnest(w) AS word FROM d),
g AS (
    SELECT j.doc_id, j.j, j.word,
           max(f.i) OVER (PARTITION BY j.doc_id ORDER BY j.j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
    FROM j LEFT JOIN f ON f.doc_id = j.doc_id AND f.i = j.j AND f.first < f.doc_id
), a AS (
    SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""

#: All pairs, so it holds as far as the index' recall is 1, as on the tables it is run on.
OP8 = """
WITH RECURSIVE u AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, CAST(min(c) AS BIGINT) AS component_id, vec_id = min(c) AS kept
FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id
"""

ORACLE_SQL = {"op1_ngram_jaccard": OP1, "op2_mtree_topk": OP2, "op6_substring_dedup": OP6, "op8_embedding_near_dedup": OP8}
