"""What the pN_ queries must give, in plain SQL where SQL can say it. Problems 5 and 10 are tested otherwise; of 4, 8
and 9, whose results SQL cannot make, it says what they must keep."""

from __future__ import annotations

#: White space of any script but the newline, as RE2 writes it.
WS = r"[\t\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CHUNKS = "(SELECT chunk_key, min(source) AS source, min(text) AS text FROM chunks GROUP BY chunk_key)"
LINE = rf"trim(regexp_replace(lower(regexp_replace(l, '\p{{Nd}}+', '0', 'g')), '{WS}+', ' ', 'g'))"
AHEAD = " + ".join(f"(a.{s} IS NOT NULL AND (b.{s} IS NULL OR a.{s} > b.{s}))::INT" for s in ("semantic_score", "bm25_score", "rerank_score"))


#: The cells of a term's two-by-two table with their row and column sums.
CELLS = (("tf", "cf", "m"), ("cf - tf", "cf", "n - m"), ("m - tf", "n - cf", "m"), ("n - cf - m + tf", "n - cf", "n - m"))
LOG_LIKELIHOOD = " + ".join(f"CASE WHEN {k} > 0 THEN ({k}) * ln(({k}) * n / (({a}) * ({b}))) ELSE 0 END" for k, a, b in CELLS)


def repeated() -> str:
    """f: each occurrence of a line that is repeated in its source."""
    return f"""WITH c AS (SELECT * FROM {CHUNKS} WHERE source IS NOT NULL),
            l AS (SELECT chunk_key, source, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS l FROM (SELECT *, string_split(text, chr(10)) AS ls FROM c WHERE text IS NOT NULL)),
            n AS (SELECT chunk_key, source, line_no, {LINE} AS line FROM l WHERE line_no > 1),
            k AS (SELECT source, line, count(DISTINCT chunk_key) AS docs FROM n WHERE line <> '' GROUP BY ALL),
            s AS (SELECT source, count(*) AS total FROM c GROUP BY source),
            f AS (SELECT chunk_key, line_no FROM n JOIN k USING (source, line) JOIN s USING (source) WHERE docs >= 10 AND docs * 10 >= total)"""


def ranking() -> str:
    """Robust rank aggregation of three scores: worst ranks of ties, the least beta order statistic, corrected."""
    scores = ("semantic_score", "bm25_score", "rerank_score")
    ranks = ", ".join(f"count(*) OVER (PARTITION BY query_id ORDER BY {s} DESC NULLS LAST RANGE UNBOUNDED PRECEDING) AS k{i}" for i, s in enumerate(scores))
    r = "list_sort([k0 / n, k1 / n, k2 / n])"
    tails = "3 * r[1] * (1 - r[1]) ** 2 + 3 * r[1] ** 2 * (1 - r[1]) + r[1] ** 3", "3 * r[2] ** 2 * (1 - r[2]) + r[2] ** 3", "r[3] ** 3"
    return f"""WITH d AS (SELECT query_id, chunk_key, {", ".join(f"max({s}) AS {s}" for s in scores)} FROM retrieval_results GROUP BY query_id, chunk_key),
            k AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, {ranks} FROM d), s AS (SELECT *, {r} AS r FROM k),
            p AS (SELECT *, least(1.0, 3 * least({", ".join(tails)})) AS significance FROM s)
            SELECT query_id, chunk_key, {", ".join(scores)}, round(significance, 9) AS significance,
              row_number() OVER (PARTITION BY query_id ORDER BY significance, k0 + k1 + k2, chunk_key) AS position FROM p"""


def sql() -> dict[str, str]:
    return {
        "p1_ranking": ranking(),
        "p1_found": f"""WITH r AS (SELECT DISTINCT query_id, chunk_key, semantic_score, bm25_score, rerank_score FROM retrieval_results)
            SELECT a.query_id, a.chunk_key FROM r a JOIN r b ON a.query_id = b.query_id AND a.chunk_key <> b.chunk_key GROUP BY ALL HAVING min({AHEAD}) >= 2""",
        "p2_found": """WITH v AS MATERIALIZED (SELECT vec_id, e / sqrt(n) AS scale, v FROM (SELECT vec_id, v, 1.0::DOUBLE AS e, list_sum(list_transform(v, lambda x: x * x)) AS n FROM
              (SELECT vec_id, min(embedding)::DOUBLE[] AS v FROM chunk_vectors WHERE len(embedding) = 64 GROUP BY vec_id)) WHERE isfinite(n) AND n > 0),
            c AS (SELECT a.vec_id AS x, b.vec_id AS y, list_dot_product(a.v, b.v) * a.scale * b.scale AS cos FROM v a JOIN v b ON a.vec_id <> b.vec_id),
            t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(cos, 9) DESC, y) AS r FROM c) WHERE r <= 5)
            SELECT DISTINCT least(x, y) AS vec_id_a, greatest(x, y) AS vec_id_b FROM t WHERE cos >= 0.9""",
        "p3_found": f"{repeated()} SELECT chunk_key, line_no::INT AS line_no FROM f",
        "p3_cleaned": f"""{repeated()}, g AS (SELECT chunk_key, list(line_no ORDER BY line_no) AS nos FROM f GROUP BY chunk_key)
            SELECT chunk_key, array_to_string(nos, ',') AS removed_lines,
              CASE WHEN nos IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda l, i: NOT list_contains(nos, i)), chr(10)) END AS text
            FROM chunks LEFT JOIN g USING (chunk_key)""",
        "p4_found": f"SELECT chunk_key FROM {CHUNKS} WHERE length(text) > 1200",
        "p4_rejoined": f"SELECT chunk_key, md5(text) AS md5, true AS fits, true AS repeats, true AS in_order FROM {CHUNKS} WHERE length(text) > 1200",
        "p8_text": "SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents",
        "p9_whole": "SELECT doc_id, true AS fits, true AS whole FROM documents",
        "p6_found": rf"""WITH w AS (SELECT chunk_key, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {CHUNKS}),
            s AS MATERIALIZED (SELECT DISTINCT chunk_key, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run FROM (SELECT chunk_key, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
            z AS (SELECT chunk_key, count(*) AS n FROM s GROUP BY chunk_key HAVING count(*) >= 60),
            b AS (SELECT x.chunk_key AS chunk_key_a, y.chunk_key AS chunk_key_b, count(*) AS shared FROM s x JOIN s y ON x.run = y.run AND x.chunk_key < y.chunk_key GROUP BY ALL)
            SELECT chunk_key_a, chunk_key_b FROM b JOIN z p ON p.chunk_key = chunk_key_a JOIN z q ON q.chunk_key = chunk_key_b WHERE shared * 10 >= 6 * (p.n + q.n - shared)""",
        "p6_groups": rf"""WITH RECURSIVE w AS (SELECT chunk_key, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {CHUNKS}),
            s AS MATERIALIZED (SELECT DISTINCT chunk_key, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run FROM (SELECT chunk_key, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
            c AS MATERIALIZED (SELECT chunk_key, n, min(chunk_key) OVER (PARTITION BY runs) AS class_id FROM
              (SELECT chunk_key, count(*) AS n, list(run ORDER BY run) AS runs FROM s GROUP BY chunk_key HAVING count(*) >= 60)),
            r AS (SELECT s.chunk_key, run, n FROM s JOIN c ON c.chunk_key = s.chunk_key WHERE c.chunk_key = class_id),
            b AS (SELECT x.chunk_key AS class_id, y.chunk_key AS other FROM r x JOIN r y ON x.run = y.run AND x.chunk_key <> y.chunk_key
              GROUP BY ALL HAVING count(*) * 10 >= 6 * (min(x.n) + min(y.n) - count(*))),
            l AS (SELECT class_id, count(*) AS links FROM b GROUP BY class_id),
            p AS (SELECT class_id AS v, class_id AS root FROM b UNION SELECT b.other, p.root FROM p JOIN b ON b.class_id = p.v),
            g AS (SELECT v AS class_id, min(root) AS group_id FROM p GROUP BY v)
            SELECT chunk_key, class_id, coalesce(links, 0) AS links, coalesce(group_id, class_id) AS group_id FROM c LEFT JOIN l USING (class_id) LEFT JOIN g USING (class_id)""",
        "p7_scores": f"""WITH t AS (SELECT chunk_key, term, count(*)::DOUBLE AS tf FROM (SELECT chunk_key, unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) AS term FROM {CHUNKS}) GROUP BY ALL),
            d AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM t GROUP BY term),
            r AS (SELECT chunk_key, sum(tf) AS m FROM t GROUP BY chunk_key),
            c AS (SELECT * FROM t JOIN d USING (term) JOIN r USING (chunk_key) CROSS JOIN (SELECT sum(tf) AS n FROM t)),
            s AS (SELECT *, 2 * ({LOG_LIKELIHOOD}) AS g FROM c)
            SELECT chunk_key, term, tf::BIGINT AS tf, df, cf::BIGINT AS cf, round(CASE WHEN tf * n >= cf * m THEN g ELSE -g END, 6) + 0.0 AS score FROM s""",
        "p7_found": f"""WITH t AS (SELECT chunk_key, term, count(*) AS tf FROM (SELECT chunk_key, unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) AS term FROM {CHUNKS}) GROUP BY ALL),
            d AS (SELECT term, count(*) AS df FROM t GROUP BY term)
            SELECT chunk_key, term FROM t JOIN d USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 12""",
    }
