"""SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

# Lower-cases A to Z only, as the contracts say; SQL's own lower() would touch other letters too
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    # Texts with one set of shingles are one node ("sets"), so copies are not expanded into pairs
    "op4_near_dedup": f"""
        WITH RECURSIVE w AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
                WHEN len(words) > 0 THEN [array_to_string(words, ' ')]
                ELSE [] END) AS shingle
            FROM w),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
        sets AS MATERIALIZED (
            SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS node
            FROM (SELECT doc_id, list_sort(list(shingle)) AS body FROM s GROUP BY doc_id)),
        r AS MATERIALIZED (SELECT s.doc_id AS node, shingle FROM s JOIN sets USING (doc_id) WHERE doc_id = node),
        links AS MATERIALIZED (
            SELECT a.node AS a, b.node AS b
            FROM r a JOIN r b ON a.shingle = b.shingle AND a.node <> b.node
            JOIN n na ON na.doc_id = a.node JOIN n nb ON nb.doc_id = b.node
            GROUP BY a.node, b.node, na.n_shingles, nb.n_shingles
            HAVING 100 * count(*) >= 75 * (na.n_shingles + nb.n_shingles - count(*))),
        reach AS (
            SELECT DISTINCT node, node AS reached FROM r
            UNION
            SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.reached),
        parts AS (SELECT node, min(reached) AS component_id FROM reach GROUP BY node)
        SELECT d.doc_id, coalesce(n.n_shingles, 0) AS n_shingles, coalesce(p.component_id, d.doc_id) AS component_id,
               d.doc_id = coalesce(p.component_id, d.doc_id) AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN sets ON sets.doc_id = d.doc_id
        LEFT JOIN parts p ON p.node = sets.node
    """,
    "op7_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {LOWER} AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
        FROM t
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                   list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE a.vec_id % 100 = 0),
        p AS (
            SELECT anchor_id, vec_id, score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id,
               row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
               s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
             AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
        QUALIFY rank <= 5
    """,
    "op13_source_divergence": f"""
        WITH d AS (
            SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LOWER} AS body
            FROM documents),
        w AS (
            SELECT nr, lang, source,
                   unnest(regexp_extract_all(body, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
            FROM d),
        t AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
        k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT nr) >= 10),
        l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        dense AS (
            SELECT g.lang, g.source, k.term, coalesce(t.n, 0) AS n, sum(coalesce(t.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
            FROM g JOIN k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
        p AS (
            SELECT dense.lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 2)) // (dense.total + 2 * v)::HUGEINT)::BIGINT AS p
            FROM dense JOIN l USING (lang)),
        q AS (
            SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v)::HUGEINT)::BIGINT AS q
            FROM k JOIN l USING (lang)),
        sums AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY ALL),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        marks AS (
            SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value
            FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, 'pair' AS part, item, value,
               row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank
        FROM pairs
        UNION ALL
        SELECT lang, source, 'term' AS part, item, value,
               row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank
        FROM marks QUALIFY rank <= 10
    """,
}
