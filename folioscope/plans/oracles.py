"""The same queries in plain SQL, written apart from the DataFrame plans, to check them against another engine."""

from __future__ import annotations

from ..functions.text import LOW_VALUE, TOPICS

#: Appended to every seventh section of the acts put together from their sections: a commencement footnote.
FOOTNOTE = "\n7. 3rd May, 1987.— Ss. 4 to 9 [but not rule (6)], vide notification No. S.O. 55(B), see Gazette of India, Extraordinary, Part IV, sec. 1(k).\n(2) What the leaf before had begun is carried on below the note."

#: White space of any script, as RE2 writes it.
WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Fixed values, as RE2 writes them: the forms of section heads, chapter heads and footnotes, and lines of noise.
SECTION = r"(?m)^(?:Section\s+)?(\d+[A-Z]?)\.\s+(.+?)\.[—–―-]"
CHAPTER = r"(?m)^CHAPTER\s+([IVXLCDM]+|[0-9]+)\s*\n(.+)$"
DATE = r"(?i)^\d{1,2}(st|nd|rd|th)?\s+(January|February|March|April|May|June|July|August|September|October|November|December)[,]?\s+\d{4}$"
MARKERS = r"(?i)vide notification|gazette of india|S\.O\.\s*\d|w\.e\.f\.|shall come into force|extraordinary,?\s*part"
DATED = r"(?i)^\d{1,2}\.\s+\d{1,2}(st|nd|rd|th)?\s+\w+,?\s*\d{4}"
BLOCK = r"(?is)^\d{1,2}\.\s+\d{1,2}(st|nd|rd|th)?\s+\w+,?\s*\d{4}\.?\s*[-–—.]{1,2}.*?(?:Extraordinary,?\s*Part\s*[IVX]+,?\s*sec\.\s*\d+\([a-z]+\)\.|see Gazette of India[^.]*\.|vide notification[^.]*\.)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def clean(x: str) -> str:
    noise = [rf"^{WS}*\p{{Nd}}+{WS}*$", "(?i)THE GAZETTE OF INDIA", "(?i)MINISTRY OF LAW", rf"^{WS}*—{WS}*$", "(?i)jftLVªh laö", r"(?i)REGISTERED NO\.", "(?i)EXTRAORDINARY"]
    keep = " AND ".join(f"NOT regexp_matches(l, {q(n)})" for n in noise)
    lines = f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: {keep}), chr(10))"
    return strip(f"regexp_replace(regexp_replace({lines}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')")


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, {q(f'([.!?;—]){WS}+([A-Z(\"])')}, '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda z: {strip('z')}), lambda z: z <> '')"


def merged(x: str, most: int) -> str:
    flushed = "CASE WHEN a.cur = '' THEN a.out ELSE list_append(a.out, a.cur) END"
    step = (
        f"CASE WHEN length(z) > {most} THEN {{'cur': '', 'out': list_append({flushed}, z)}} "
        f"WHEN length(a.cur) + length(z) + 1 <= {most} THEN {{'cur': CASE WHEN a.cur = '' THEN z ELSE a.cur || ' ' || z END, 'out': a.out}} "
        f"ELSE {{'cur': z, 'out': {flushed}}} END"
    )
    return f"list_reduce({sentences(x)}, lambda a, z: {step}, {{'cur': '', 'out': []::VARCHAR[]}})"


def pieces(x: str, most: int = 1200, least: int = 80, always: bool = False) -> str:
    m = merged(x, most)
    split = f"list_filter((SELECT CASE WHEN m.cur = '' THEN m.out ELSE list_append(m.out, m.cur) END FROM (SELECT {m} AS m)), lambda y: length(y) >= {least})"
    return split if always else f"CASE WHEN length({x}) <= {most} THEN [{x}] ELSE {split} END"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-zA-Z0-9]+')"


def topics(x: str, default: bool = True) -> str:
    low = f"lower(coalesce({x}, ''))"
    cases = ", ".join(f"CASE WHEN {' OR '.join(f'contains({low}, {q(w)})' for w in words)} THEN {q(t)} END" for t, words in TOPICS.items())
    found = f"list_filter([{cases}], lambda t: t IS NOT NULL)"
    return f"CASE WHEN len({found}) = 0 THEN ['general'] ELSE {found} END" if default else found


def chunks(*cols: str) -> str:
    return f"(SELECT DISTINCT {', '.join(('chunk_key', *cols))} FROM chunks)"


RESULTS = "(SELECT DISTINCT result_id, query_id, chunk_key, act_name, section_number, category, source, semantic_score, bm25_score, score, rerank_score, final_score FROM retrieval_results)"
STEM = r"regexp_replace(source, '\.[^.]*$', '')"
TITLE = f"array_to_string(list_transform(regexp_extract_all(replace({STEM}, '_', ' '), '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1:1]) || lower(w[2:])), '')"

ACTS = f"""acts_text AS (
  SELECT regexp_replace(source, '\\.json$', '') AS doc, string_agg(part, chr(10) ORDER BY section_key, part) AS text
  FROM (SELECT section_key, source,
          CASE WHEN section_key % 5 = 0 THEN 'CHAPTER ' || (section_key % 20 + 1)::VARCHAR || chr(10) || coalesce(chapter, '') || chr(10) ELSE '' END
          || coalesce(text, '') || CASE WHEN section_key % 7 = 0 THEN {q(FOOTNOTE)} ELSE '' END AS part
        FROM (SELECT DISTINCT section_key, source, chapter, text FROM parsed_sections))
  GROUP BY source)"""


def spans(x: str) -> str:
    with_chapters = f"regexp_replace({x}, {q(CHAPTER)}, chr(2) || '\\2' || chr(3) || '\\0', 'g')"
    parts = f"string_split(regexp_replace({with_chapters}, {q(SECTION)}, chr(1) || '\\0', 'g'), chr(1))"
    return f"""marked AS (SELECT doc, {parts} AS parts FROM source_text),
rows_ AS (SELECT doc, unnest(range(len(parts))) AS pos, unnest(parts) AS part FROM marked),
bare AS (SELECT doc, pos, regexp_replace(part, '\\x02[^\\x03]*\\x03', '', 'g') AS part, {strip("list_last(regexp_extract_all(part, '\\x02([^\\x03]*)\\x03', 1))")} AS chapter_in FROM rows_),
spans AS (SELECT doc, pos, {strip(f"regexp_extract(part, {q(SECTION)}, 1)")} AS section_number, {strip(f"regexp_extract(part, {q(SECTION)}, 2)")} AS section_title, {strip("part")} AS span,
  coalesce(last_value(chapter_in IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'General') AS chapter FROM bare)"""


def folded() -> str:
    rest = f"regexp_replace(span, {q(BLOCK)}, '')"
    stripped = strip("l")
    dropped = f"array_to_string(list_filter(string_split(rest, chr(10)), lambda l: NOT (regexp_matches(l, {q(MARKERS)}) OR regexp_matches({stripped}, {q(DATED)}))), chr(10))"
    remainder = strip(f"CASE WHEN regexp_matches(rest, {q(MARKERS)}) OR regexp_matches({strip('rest')}, {q(DATED)}) THEN {dropped} ELSE rest END")
    return f"""classed AS (SELECT *, regexp_matches(section_title, {q(DATE)}) OR regexp_matches(substring(span, 1, 300), {q(MARKERS)}) AS footnote, {rest} AS rest FROM spans WHERE pos >= 1 AND length(span) >= 50),
islands AS (SELECT *, sum(CASE WHEN footnote THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY pos) AS island, {remainder} AS remainder FROM classed),
folded AS (SELECT doc, max(pos) FILTER (NOT footnote) AS pos, max(section_number) FILTER (NOT footnote) AS section_number, max(section_title) FILTER (NOT footnote) AS section_title,
  max(chapter) FILTER (NOT footnote) AS chapter,
  CASE WHEN count(*) FILTER (footnote AND remainder <> '') > 0 THEN regexp_replace(max(span) FILTER (NOT footnote), {q(f"{WS}+$")}, '') || chr(10) || string_agg(remainder, chr(10) ORDER BY pos) FILTER (footnote AND remainder <> '')
    ELSE max(span) FILTER (NOT footnote) END AS text
  FROM islands WHERE island > 0 GROUP BY doc, island),
best AS (SELECT *, min(pos) OVER (PARTITION BY doc, section_number) AS place,
  row_number() OVER (PARTITION BY doc, section_number ORDER BY regexp_matches(section_title, {q(DATE)}), CASE WHEN NOT regexp_matches(section_title, {q(DATE)}) THEN length(text) END DESC NULLS LAST, pos) AS r FROM folded)"""


def act_rows(select: str, cleaned: bool = False) -> str:
    text = clean("text") if cleaned else "text"
    return f"WITH {ACTS}, source_text AS (SELECT doc, {text} AS text FROM acts_text), {spans('text')}, {folded()} {select}"


def paragraphs(docs: str) -> str:
    split = f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {strip('p')}), lambda p: length(p) > 100)"
    return f"SELECT doc, unnest(range(1, len(ps) + 1)) AS pos, unnest(ps) AS text FROM (SELECT doc, {split} AS ps FROM {docs} WHERE NOT regexp_matches(text, {q(SECTION)}))"


BM25 = f"""toks AS (SELECT chunk_key, {tokens("coalesce(text, '')")} AS toks FROM {chunks("text")}),
lens AS (SELECT chunk_key, len(toks) AS len FROM toks),
total AS (SELECT count(*)::DOUBLE AS n, sum(len)::DOUBLE / count(*) AS avgdl FROM lens),
postings AS (SELECT chunk_key, term, count(*)::DOUBLE AS tf FROM (SELECT chunk_key, unnest(toks) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df, ln((SELECT n FROM total) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf0 FROM postings GROUP BY term),
terms AS (SELECT term, df, CASE WHEN idf0 < 0 THEN 0.25::DOUBLE * (SELECT avg(idf0) FROM dfs) ELSE idf0 END AS idf FROM dfs)"""
LEXICAL_TEXT = "concat_ws(' ', trim(concat_ws(' ', expanded_query, array_to_string(anchors, ' '), coalesce(category, ''), array_to_string(intents, ' '))), array_to_string(anchors, ' '))"


def bm25(text: str) -> str:
    return f"""WITH {BM25},
asked AS (SELECT query_id, term, count(*)::DOUBLE AS qf FROM (SELECT query_id, unnest({tokens(text)}) AS term FROM retrieval_queries) GROUP BY ALL),
scored AS (SELECT query_id, chunk_key, sum(qf * idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (SELECT avgdl FROM total)))) AS score
  FROM asked JOIN terms USING (term) JOIN postings USING (term) JOIN lens USING (chunk_key) GROUP BY ALL)"""


VECTORS = "(SELECT vec_id, min(embedding)::DOUBLE[] AS v, min(metadata.category) AS category FROM chunk_vectors WHERE len(embedding) = 64 GROUP BY vec_id)"
FINITE = "(SELECT * FROM " + VECTORS + " WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)"
NONZERO = "(SELECT * FROM " + FINITE + " WHERE len(list_filter(v, lambda x: x <> 0)) > 0)"
SQUARED = "list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))"
PROTOTYPES = "protos AS (SELECT label::VARCHAR AS category, min(vec_id) AS pos, arg_min(embedding, vec_id)::DOUBLE[] AS p FROM embeddings GROUP BY label)"
ROUTED = f"""{PROTOTYPES},
cosines AS (SELECT vec_id AS query_id, category, pos, list_cosine_similarity(embedding::DOUBLE[], p) AS score FROM embeddings, protos),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS r FROM cosines),
routed AS (SELECT query_id, CASE WHEN score >= 0.5 THEN category END AS category, round(score, 4) AS confidence FROM placed WHERE r = 1)"""
FEATURES = f"""feat AS (SELECT *,
  CASE WHEN len(list_intersect(coalesce({tokens("query")}, []), coalesce({tokens("section_title")}, []))) = 0 THEN -0.05::DOUBLE ELSE 0.02::DOUBLE END AS title,
  CASE WHEN asked IS NULL OR asked = '' OR category IS NULL OR category = '' THEN 0.0::DOUBLE WHEN category = asked THEN 0.10::DOUBLE WHEN contains(array_to_string(topics, ', '), asked) THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END AS category_bonus,
  CASE WHEN len(list_filter(coalesce(anchors, []), lambda a: contains(lower(a), lower(coalesce(act_name, ''))))) > 0 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS anchor_bonus,
  len(list_intersect(coalesce(intents, []), topics)) * 0.08::DOUBLE AS intent_boost FROM full_),
fused AS (SELECT *, 0.7::DOUBLE * semantic + 0.3::DOUBLE * (1 / (1 + exp(-z))) + category_bonus + anchor_bonus + intent_boost + title AS score FROM feat)"""
CANDIDATES = f"""cand AS (SELECT r.result_id, r.query_id, r.chunk_key, r.act_name, r.section_number, r.category, r.semantic_score AS semantic,
    (r.bm25_score - avg(r.bm25_score) OVER w) / (stddev_pop(r.bm25_score) OVER w + 1e-6::DOUBLE) AS z FROM {RESULTS} r WINDOW w AS (PARTITION BY query_id)),
full_ AS (SELECT c.*, q.original_query AS query, q.intents, q.anchors, q.category AS asked, k.section_title, k.text, {topics("k.text")} AS topics
  FROM cand c JOIN retrieval_queries q USING (query_id) JOIN {chunks("section_title", "text")} k USING (chunk_key)),
{FEATURES}"""

RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, result_id) AS rank FROM {RESULTS})"
OUTCOMES = f"""{RANKED},
gold AS (SELECT query_id, upper(substring(arg_min(act_name, result_id), 1, 12)) AS pact, arg_min(section_number, result_id) AS psec, substring(arg_max(act_name, result_id), 1, 12) AS sact FROM {RESULTS} WHERE query_id % 4 <> 0 GROUP BY query_id),
hits AS (SELECT r.query_id, min(rank) FILTER (contains(lower(act_name), lower(pact)) AND (psec = '' OR psec = section_number)) AS primary_rank, min(rank) FILTER (contains(lower(act_name), lower(sact))) AS secondary_rank
  FROM ranked r JOIN gold g USING (query_id) GROUP BY r.query_id),
outcomes AS (SELECT query_id, primary_rank, secondary_rank, primary_rank AS strict_rank, coalesce(primary_rank, secondary_rank) AS relaxed_rank FROM (SELECT DISTINCT query_id FROM retrieval_queries) LEFT JOIN hits USING (query_id))"""
KEYED = "keyed AS (SELECT doc_id, coalesce(source, '') || '/' || doc_kind || ':' || md5(coalesce(text, '')) AS file_key FROM documents), manifest AS (SELECT DISTINCT file_key FROM keyed WHERE doc_id IN (SELECT doc_id FROM doc_subject_labels))"
CACHED = "(SELECT metadata.chunk_id AS chunk_id, min(embedding) AS embedding FROM chunk_vectors WHERE len(embedding) = 64 GROUP BY 1)"
FETCHED = """(SELECT source, arg_min(url, pos) FILTER (status = 200 AND (contains(kind, 'pdf') OR contains(kind, 'octet-stream'))) AS url
  FROM (SELECT source, doc_id AS pos, 'u' || doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN 200 ELSE 404 END AS status,
    lower(CASE doc_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/PDF' ELSE 'application/octet-stream' END) AS kind FROM documents) GROUP BY source)"""


def knn(metric: str, rows: str, k: int, on: str = "") -> str:
    return f"WITH v AS MATERIALIZED {rows}, d AS (SELECT a.vec_id AS query_id, b.vec_id, {metric} AS distance FROM v a JOIN v b ON a.vec_id % 50 = 0 {on}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), vec_id) AS rank FROM d)"


def finish(before: bool) -> str:
    base = f"b AS (SELECT *, round(0.4::DOUBLE * rerank_score + 0.6::DOUBLE * score, 6) AS f FROM {RESULTS})"
    one = "row_number() OVER (PARTITION BY query_id, act_name, section_number ORDER BY f DESC NULLS LAST, result_id)"
    cut = "row_number() OVER (PARTITION BY query_id ORDER BY f DESC NULLS LAST, result_id)"
    first, second = (one, cut) if before else (cut, one)
    lim = ("1", "10") if before else ("10", "1")
    return f"WITH {base}, x AS (SELECT *, {first} AS n FROM b), y AS (SELECT * EXCLUDE (n), {second} AS n FROM x WHERE n <= {lim[0]}), z AS (SELECT * FROM y WHERE n <= {lim[1]}) SELECT query_id, result_id, f AS final_score, {cut} AS rank FROM z"


def embedded(x: str) -> str:
    """The hashing embedder, as a list of 64 numbers that went through float32."""
    hashes = f"list_transform({tokens(x)}, lambda t: ('0x' || substring(md5(t), 1, 8))::BIGINT)"
    v = f"(SELECT list_transform(range(64), lambda d: coalesce(list_sum(list_transform(list_filter(hs, lambda h: h % 64 = d), lambda h: CASE WHEN (h // 64) % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)), 0.0::DOUBLE)) FROM (SELECT {hashes} AS hs))"
    return f"(SELECT list_transform(v, lambda x: CASE WHEN n > 0 THEN (x / sqrt(n))::FLOAT::DOUBLE ELSE 0.0::DOUBLE END) FROM (SELECT v, list_sum(list_transform(v, lambda x: x * x)) AS n FROM (SELECT {v} AS v)))"


def cascade(search: str) -> str:
    cols = ("text", "citation", "section_number", "section_title", "chapter", "act_name", "short_name", "year", "category", "source")
    pair = f"list_distinct({tokens("query || '. Related legal concepts: ' || array_to_string(intents, ' ')")})"
    shown = tokens("coalesce(act_name, '') || ' Section ' || coalesce(section_number, '') || ' ' || coalesce(section_title, '') || '. ' || text")
    return f"""{bm25(LEXICAL_TEXT)},
docs AS MATERIALIZED (SELECT chunk_key, text, citation, section_number, section_title, act_name, lower(category) AS category, {topics("text")} AS topics, {embedded(search)} AS e FROM {chunks(*cols)}),
asked_ AS MATERIALIZED (SELECT query_id, original_query AS query, coalesce(intents, []) AS intents, coalesce(anchors, []) AS anchors, category AS asked,
  {embedded("trim(concat_ws(' ', expanded_query, array_to_string(anchors, ' '), coalesce(category, ''), array_to_string(intents, ' ')))")} AS main,
  {embedded("array_to_string(anchors, ' ')")} AS anchor FROM retrieval_queries),
mixed AS (SELECT *, CASE WHEN len(anchors) > 0 THEN list_transform(range(1, 65), lambda i: 0.7::DOUBLE * main[i] + 0.3::DOUBLE * anchor[i]) ELSE list_transform(range(1, 65), lambda i: 0.7::DOUBLE * main[i]) END AS q FROM asked_),
dist AS (SELECT m.query_id, d.chunk_key, round(list_sum(list_transform(range(1, 65), lambda i: (m.q[i] - d.e[i]) * (m.q[i] - d.e[i]))), 12) AS distance FROM mixed m JOIN docs d ON m.asked IS NULL OR m.asked = d.category),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_key) AS r FROM dist) WHERE r <= 50),
stats AS (SELECT query_id, sum(score) / (SELECT n FROM total) AS mean, sqrt(greatest(sum(score * score) / (SELECT n FROM total) - (sum(score) / (SELECT n FROM total)) ** 2, 0.0)) AS std FROM scored GROUP BY query_id),
full_ AS (SELECT n.query_id, n.chunk_key, n.distance, exp(-n.distance) AS semantic, coalesce(s.score, 0.0) AS bm25, coalesce((coalesce(s.score, 0.0) - t.mean) / (t.std + 1e-6::DOUBLE), 0.0) AS z,
  m.query, m.intents, m.anchors, m.asked, d.* EXCLUDE (chunk_key, e)
  FROM near n LEFT JOIN scored s ON s.query_id = n.query_id AND s.chunk_key = n.chunk_key LEFT JOIN stats t ON t.query_id = n.query_id JOIN mixed m ON m.query_id = n.query_id JOIN docs d ON d.chunk_key = n.chunk_key WHERE coalesce(d.text, '') <> ''),
{FEATURES},
cut AS (SELECT * FROM (SELECT * EXCLUDE (score), round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, distance, chunk_key) AS r FROM fused) WHERE r <= 20),
pairs AS (SELECT *, {pair} AS qt, {shown} AS dt FROM cut),
reranked AS (SELECT *, coalesce(len(list_intersect(qt, dt))::DOUBLE / nullif(len(qt), 0), 0.0) AS rr FROM pairs),
final AS (SELECT *, 0.4::DOUBLE * rr + 0.6::DOUBLE * score AS f FROM reranked),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, chunk_key) AS k FROM final) WHERE k <= 5),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, act_name, section_number ORDER BY f DESC, chunk_key) AS o FROM top) WHERE o = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, chunk_key) AS rank, chunk_key, act_name, section_number, citation, round(semantic, 4) AS semantic_score, round(bm25, 4) AS bm25_score, round(score, 4) + 0.0::DOUBLE AS score, round(rr, 4) AS rerank_score, round(f, 4) AS final_score FROM one"""


def ingested(rows: str) -> str:
    """x: the chunks that a store makes of rows: none of low value, an id once a category, with the file that comes first."""
    low = " OR ".join(f"contains(lower(coalesce(section_title, '')), {q(p)})" for p in LOW_VALUE)
    return f"""s AS (SELECT *, {pieces('text')} AS ps FROM {rows} WHERE text IS NOT NULL AND NOT ({low})),
            u AS (SELECT coalesce(category, 'general') AS category, coalesce(source, '') AS source, version, act_name, section_number, unnest(range(len(ps))) AS chunk_index, unnest(ps) AS piece FROM s),
            x AS (SELECT category, chunk_id, version, min(source) AS source FROM (SELECT *, sha256(coalesce(act_name, '') || '|' || coalesce(section_number, '') || '|' || chunk_index || '|' || piece) AS chunk_id FROM u) GROUP BY ALL)"""


RERANKED = f"""WITH {CANDIDATES}, p AS (SELECT *, list_distinct({tokens("query || '. Related legal concepts: ' || coalesce(array_to_string(intents, ' '), '')")}) AS qt,
            {tokens("coalesce(act_name, '') || ' Section ' || coalesce(section_number, '') || ' ' || coalesce(section_title, '') || '. ' || text")} AS dt FROM fused),
            s AS (SELECT *, CASE WHEN coalesce(text, '') <> '' THEN coalesce(len(list_intersect(qt, dt))::DOUBLE / nullif(len(qt), 0), 0.0) END AS rr FROM p)
            SELECT result_id, round(rr, 4) AS rerank_score, round(0.4::DOUBLE * rr + 0.6::DOUBLE * score, 4) AS final_score FROM s"""
METRICS = f"""WITH {OUTCOMES}, k AS (SELECT 'strict' AS kind, strict_rank AS rank FROM outcomes UNION ALL SELECT 'relaxed', relaxed_rank FROM outcomes),
            a AS (SELECT kind, count(*) AS cases, count(*) FILTER (rank <= 1) AS hit_1, count(*) FILTER (rank <= 3) AS hit_3, count(*) FILTER (rank <= 5) AS hit_5, sum(coalesce(1.0::DOUBLE / rank, 0.0)) / count(*) AS mrr FROM k GROUP BY kind)
            SELECT kind, cases, hit_1, hit_3, hit_5, round(100.0::DOUBLE * hit_1 / cases, 4) AS hit_1_percent, round(100.0::DOUBLE * hit_3 / cases, 4) AS hit_3_percent, round(100.0::DOUBLE * hit_5 / cases, 4) AS hit_5_percent, round(mrr, 4) AS mrr FROM a"""
SECTIONS = "(SELECT DISTINCT section_key, category, act_name, year, chapter, section_number, section_title, topics, text, citation, char_count, short_name, source FROM parsed_sections)"
#: What comes to the store of the tests, and of it the chunks of each file's latest version.
STORED = f"""v AS (SELECT *, 1 AS version FROM {SECTIONS} WHERE source IS NOT NULL UNION ALL SELECT * REPLACE ('New: ' || text AS text), 2 FROM {SECTIONS} WHERE source IS NOT NULL AND year % 2 = 0),
            m AS (SELECT coalesce(category, 'general') AS category, source, max(version) AS version FROM v GROUP BY ALL), {ingested('v')}, live AS (SELECT x.* FROM x JOIN m USING (category, source, version))"""


def contexts() -> str:
    cosine = lambda a, b: f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    told = "array_to_string(string_split(prototype, ', '), ' ') || ' ' || subject || ' ' || prototype || ' ' || replace('about_' || subject, '_', ' ')"
    return f"""WITH asked AS MATERIALIZED (SELECT query_id, original_query AS query, {embedded('original_query')} AS v FROM retrieval_queries),
            areas AS MATERIALIZED (SELECT subject, subject_no AS pos, {embedded('prototype')} AS p, {embedded(told)} AS i FROM subject_areas),
            c AS (SELECT query_id, subject, pos, {cosine('v', 'p')} AS score FROM asked, areas),
            routed AS (SELECT query_id, CASE WHEN score >= 0.2 THEN subject END AS category, round(score, 4) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS r FROM c) WHERE r = 1),
            near AS (SELECT a.query_id, subject, pos, list_dot_product(v, i) AS score FROM asked a JOIN routed r USING (query_id) JOIN areas ON CASE WHEN r.confidence >= 0.2 THEN r.category END IS NULL OR r.category = subject),
            gap AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM near),
            m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM gap WHERE score >= 0.2 AND best - score <= 0.05::DOUBLE) WHERE rank <= 2)"""


def sql() -> dict[str, str]:
    low = " OR ".join(f"contains(lower(coalesce(section_title, '')), {q(p)})" for p in [*LOW_VALUE, "inquiry into", "penalty in respect of"])
    number = "coalesce(nullif(regexp_extract(lower(x), '(section|sec)\\s+(\\d+)', 2), ''), nullif(regexp_extract(lower(x), '\\b(\\d{2,4})\\b', 1), ''))"
    sections = "(SELECT DISTINCT section_key, act_name, section_number, section_title, chapter, short_name, year, category, source, text, citation FROM parsed_sections)"
    e = lambda x: f"coalesce({x}, '')"
    search = strip(f"{e('act_name')} || chr(10) || {e('section_number')} || ' ' || {e('section_title')} || chr(10) || {e('chapter')} || chr(10) || chr(10) || {e('text')}")
    shown = f"CASE WHEN len({topics('text', False)}) > 0 THEN array_to_string({topics('text', False)}, ', ') ELSE 'general' END"
    paged = "(SELECT doc_id AS doc, text FROM documents WHERE text IS NOT NULL)"
    title = "array_to_string(list_transform(regexp_extract_all(replace(doc, '_', ' '), '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1:1]) || lower(w[2:])), '')"
    dot = "list_sum(list_transform(range(1, 65), lambda i: m[i] * m[i]))"
    return {
        "clean_text": f"SELECT doc_id, {clean('text')} AS text FROM documents",
        "sentence_split": f"SELECT doc_id, unnest(range(1, len(ss) + 1)) AS pos, unnest(ss) AS sentence FROM (SELECT doc_id, {sentences('text')} AS ss FROM documents WHERE text IS NOT NULL)",
        "tokenize_alnum": f"SELECT chunk_key, len({tokens('text')}) AS n, array_to_string({tokens('text')}, ' ') AS tokens FROM {chunks('text')} WHERE text IS NOT NULL",
        "tokenize_ws": f"SELECT chunk_key, len(w) AS n, coalesce(array_to_string(w, ' '), '') AS tokens FROM (SELECT chunk_key, list_filter(regexp_split_to_array(lower(text), {q(WS + '+')}), lambda x: x <> '') AS w FROM {chunks('text')} WHERE text IS NOT NULL)",
        "act_metadata": f"SELECT source, {TITLE} AS act_name, substring({STEM}, 1, 12) AS short_name, 0 AS year, 'Unknown' AS ministry FROM (SELECT DISTINCT source FROM chunks WHERE source IS NOT NULL)",
        "metadata_lookup": f"SELECT c.source, coalesce(a.act_name, {TITLE.replace('source', 'c.source')}) AS act_name, coalesce(a.ministry, 'Unknown') AS ministry FROM (SELECT DISTINCT source FROM chunks WHERE source IS NOT NULL) c LEFT JOIN (SELECT * FROM acts WHERE year > 0) a ON a.source = c.source",
        "topic_tags": f"SELECT chunk_key, array_to_string({topics('text')}, ', ') AS topics FROM {chunks('text')}",
        "topic_histogram": f"SELECT topic, count(*) AS n FROM (SELECT unnest({topics('text')}) AS topic FROM {chunks('text')}) GROUP BY topic",
        "low_value_filter": f"SELECT * FROM {chunks('section_title')} WHERE NOT ({low})",
        "search_text": f"SELECT chunk_key, {search} AS search_text FROM {chunks('act_name', 'section_number', 'section_title', 'chapter', 'text')}",
        "document_text": f"SELECT chunk_key, 'Act: ' || {e('act_name')} || chr(10) || 'Category: ' || {e('category')} || chr(10) || 'Section: ' || {e('section_number')} || chr(10) || 'Title: ' || {e('section_title')} || chr(10) || 'Topics: ' || {shown} || chr(10) || chr(10) || {e('text')} AS document_text FROM {chunks('act_name', 'category', 'section_number', 'section_title', 'text')}",
        "section_number_extract": f"SELECT query_id, {number} AS section_number FROM (SELECT query_id, original_query AS x FROM retrieval_queries UNION ALL SELECT doc_id, text FROM documents)",
        "section_split": act_rows("SELECT doc, pos, section_number, section_title, length(span) AS chars, md5(span) AS md5 FROM spans WHERE pos >= 1"),
        "chapter_asof": act_rows("SELECT doc, pos, section_number, chapter FROM spans WHERE pos >= 1"),
        "footnote_classify": act_rows(f"SELECT doc, pos, regexp_matches(section_title, {q(DATE)}) OR regexp_matches(substring(span, 1, 300), {q(MARKERS)}) AS footnote FROM spans WHERE pos >= 1"),
        "footnote_fold": act_rows("SELECT doc, pos, section_number, length(text) AS chars, md5(text) AS md5 FROM folded"),
        "section_dedupe": act_rows("SELECT doc, place AS pos, section_number, section_title, chapter, md5(text) AS md5 FROM best WHERE r = 1"),
        "paragraph_fallback": f"SELECT doc, pos, 'P' || pos AS section_number, text FROM ({paragraphs(paged)})",
        "parse_acts": act_rows(
            f"SELECT doc AS path, {title} AS act_name, substring(doc, 1, 12) AS short_name, chapter, section_number, section_title, {title} || ' › Section ' || section_number || ' › ' || section_title AS citation, length(text) AS char_count, pos, md5(text) AS md5 FROM "
            f"(SELECT doc, place AS pos, section_number, section_title, chapter, text FROM best WHERE r = 1 UNION ALL SELECT doc, pos, 'P' || pos, 'Paragraph ' || pos, 'Unknown', text FROM ({paragraphs('source_text')}))",
            True,
        ),
        "greedy_chunks": f"SELECT doc_id, unnest(range(len(ps))) AS pos, unnest(ps) AS chunk FROM (SELECT doc_id, {pieces('text')} AS ps FROM documents WHERE text IS NOT NULL)",
        "legacy_chunks": f"SELECT doc_id, unnest(range(len(ps))) AS pos, unnest(ps) AS chunk FROM (SELECT doc_id, {pieces('text', 900, 80, True)} AS ps FROM documents WHERE text IS NOT NULL)",
        "chunk_records": f"""WITH s AS (SELECT *, {pieces('text')} AS ps FROM {sections} WHERE text IS NOT NULL),
            x AS (SELECT * EXCLUDE (ps, text, citation), citation AS cit, len(ps) AS total_chunks, unnest(range(len(ps))) AS chunk_index, unnest(ps) AS piece FROM s)
            SELECT section_key, 'Section ' || section_number || ' ' || section_title || chr(10) || chr(10) || piece AS text, cit || CASE WHEN total_chunks > 1 THEN ' (part ' || (chunk_index + 1) || '/' || total_chunks || ')' ELSE '' END AS citation,
            section_number, section_title, coalesce(chapter, '') AS chapter, act_name, coalesce(short_name, '') AS short_name, year, coalesce(category, 'general') AS category, coalesce(source, '') AS source, chunk_index,
            sha256(coalesce(act_name, '') || '|' || coalesce(section_number, '') || '|' || chunk_index || '|' || piece) AS chunk_id, total_chunks FROM x""",
        "bm25_stats": f"WITH {BM25} SELECT term, df, round(idf, 4) AS idf FROM terms",
        "bm25_scores": f"{bm25(LEXICAL_TEXT)} SELECT query_id, chunk_key, round(score, 4) + 0.0::DOUBLE AS score FROM scored",
        "bm25_topk": f"{bm25('original_query')}, every AS (SELECT q.query_id, l.chunk_key, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM retrieval_queries) q CROSS JOIN lens l LEFT JOIN scored s ON s.query_id = q.query_id AND s.chunk_key = l.chunk_key), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_key) AS rank FROM every) SELECT query_id, chunk_key, round(score, 4) + 0.0::DOUBLE AS score, rank FROM r WHERE rank <= 5",
        "bm25_zscore_sigmoid": f"{bm25(LEXICAL_TEXT)}, every AS (SELECT q.query_id, l.chunk_key, s.score AS own, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM retrieval_queries) q CROSS JOIN lens l LEFT JOIN scored s ON s.query_id = q.query_id AND s.chunk_key = l.chunk_key), z AS (SELECT *, (score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-6::DOUBLE) AS z FROM every WINDOW w AS (PARTITION BY query_id)) SELECT query_id, chunk_key, round(z, 4) + 0.0::DOUBLE AS z, round(1 / (1 + exp(-z)), 4) AS squashed FROM z WHERE own IS NOT NULL",
        "knn_l2": f"{knn(SQUARED, FINITE, 50)} SELECT query_id, vec_id, round(distance, 4) + 0.0::DOUBLE AS distance, round(exp(-distance), 4) AS similarity, rank FROM r WHERE rank <= 50",
        "knn_filtered": f"{knn(SQUARED, FINITE, 20, 'AND (a.category IS NULL OR a.category = b.category)')} SELECT query_id, vec_id, round(distance, 4) + 0.0::DOUBLE AS distance, rank FROM r WHERE rank <= 20",
        "knn_cosine": f"{knn('1 - list_cosine_similarity(a.v, b.v)', NONZERO, 10)} SELECT query_id, vec_id, round(distance, 4) + 0.0::DOUBLE AS distance, rank FROM r WHERE rank <= 10",
        "cosine_scores": f"WITH {ROUTED} SELECT query_id, category, round(score, 4) + 0.0::DOUBLE AS score FROM cosines",
        "vector_mix": f"WITH {PROTOTYPES}, x AS (SELECT vec_id, embedding::DOUBLE[] AS v, p FROM embeddings e JOIN protos ON category = e.label::VARCHAR), y AS (SELECT vec_id, v, list_transform(range(1, 65), lambda i: CASE WHEN vec_id % 2 = 0 THEN 0.7::DOUBLE * v[i] + 0.3::DOUBLE * p[i] ELSE 0.7::DOUBLE * v[i] END) AS m FROM x) SELECT vec_id, round({dot}, 4) AS norm2, round(list_sum(list_transform(range(1, 65), lambda i: (m[i] - v[i]) * (m[i] - v[i]))), 4) AS moved FROM y",
        "route_category": f"WITH {ROUTED} SELECT query_id, category, confidence FROM routed",
        "route_ranked": f"WITH {ROUTED} SELECT query_id, r - 1 AS pos, category, round(score, 4) + 0.0::DOUBLE AS score FROM placed",
        "intent_gap_topk": contexts() + " SELECT query_id, 'about_' || subject AS intent, round(score, 4) + 0.0::DOUBLE AS score, rank FROM m",
        "query_context": contexts() + """, l AS (SELECT query_id, string_agg('about_' || subject, '|' ORDER BY rank) AS intents, string_agg(replace('about_' || subject, '_', ' '), ' ' ORDER BY rank) AS words, string_agg(subject, '|' ORDER BY rank) AS anchors, max(score) AS best FROM m GROUP BY query_id)
            SELECT query_id, query || coalesce(' ' || words, '') AS expanded_query, coalesce(intents, '') AS intents, category, round(coalesce(best, 0.0), 4) AS confidence, coalesce(anchors, '') AS anchors FROM asked JOIN routed USING (query_id) LEFT JOIN l USING (query_id)""",
        "intent_text": "SELECT subject, array_to_string(list_concat(string_split(prototype, ', '), hindi_terms, [prototype, replace(subject, '_', ' ')]), ' ') AS intent_text FROM subject_areas",
        "diagnostic_acts": f"WITH {CANDIDATES} SELECT query_id, result_id, act_name, round(score, 4) + 0.0::DOUBLE AS score FROM fused WHERE act_name IN (SELECT act_name FROM acts WHERE year % 2 = 0)",
        "fusion_features": f"WITH {CANDIDATES} SELECT result_id, title, category_bonus, anchor_bonus, round(intent_boost, 4) AS intent_boost FROM feat",
        "fusion_score": f"WITH {CANDIDATES} SELECT result_id, round(score, 4) + 0.0::DOUBLE AS score FROM fused",
        "fusion_top20": f"WITH {CANDIDATES}, o AS (SELECT query_id, result_id, round(score, 6) AS score FROM fused), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, result_id) AS rank FROM o) SELECT query_id, result_id, score, rank FROM r WHERE rank <= 20",
        "min_score_and_filter": f"WITH {CANDIDATES} SELECT query_id, result_id, round(score, 4) + 0.0::DOUBLE AS score FROM fused WHERE score >= 0.45 AND (asked IS NULL OR category = asked)",
        "rerank_overlap": RERANKED,
        "rerank_blend": f"SELECT result_id, round(0.4::DOUBLE * rerank_score + 0.6::DOUBLE * score, 4) AS final_score FROM {RESULTS}",
        "rerank_min_max": f"SELECT result_id, round(0.4::DOUBLE * (rerank_score - min(rerank_score) OVER w) / (max(rerank_score) OVER w - min(rerank_score) OVER w + 1e-8::DOUBLE) + 0.6::DOUBLE * score, 4) AS final_score FROM {RESULTS} WINDOW w AS (PARTITION BY query_id)",
        "limit_then_dedupe": finish(False),
        "dedupe_then_limit": finish(True),
        "first_match_rank": f"WITH {OUTCOMES} SELECT * FROM outcomes",
        "hit_mrr": METRICS,
        "duplicate_citations": f"SELECT query_id, act_name, section_number, count(*) AS n FROM {RESULTS} GROUP BY ALL HAVING count(*) > 1",
        "category_leakage": f"SELECT r.query_id, count(*) AS leaks FROM {RESULTS} r JOIN (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'criminal' ELSE category END AS category FROM retrieval_queries) q USING (query_id) WHERE coalesce(q.category, '') <> '' AND coalesce(r.category, '') <> '' AND r.category <> q.category GROUP BY r.query_id",
        "wrong_but_sure": f"WITH {OUTCOMES} SELECT o.query_id, round(r.score, 4) AS final_score FROM outcomes o JOIN ranked r USING (query_id) WHERE o.strict_rank IS NULL AND r.rank = 1 AND r.score >= 0.4",
        "source_histogram": f"SELECT source, count(*) AS n FROM {chunks('source')} GROUP BY source",
        "distinct_acts": f"SELECT query_id, string_agg(act_name, '|' ORDER BY act_name) AS acts FROM (SELECT DISTINCT query_id, act_name FROM {RESULTS}) GROUP BY query_id",
        "fetch_first_success": f"SELECT * FROM {FETCHED}",
        "fetch_summary": f"SELECT url IS NOT NULL AS ok, count(*) AS n FROM {FETCHED} GROUP BY 1",
        "incremental_new": f"WITH {KEYED} SELECT doc_id, file_key FROM keyed WHERE file_key NOT IN (SELECT file_key FROM manifest)",
        "incremental_skipped": f"WITH {KEYED} SELECT doc_id, file_key FROM keyed WHERE file_key IN (SELECT file_key FROM manifest)",
        "ingest_summary": f"WITH {KEYED} SELECT count(*) FILTER (file_key NOT IN (SELECT file_key FROM manifest)) AS \"new\", count(*) FILTER (file_key IN (SELECT file_key FROM manifest)) AS skipped, count(*) AS total FROM keyed",
        "embed_cache_miss": f"SELECT DISTINCT chunk_key, chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM {CACHED} WHERE chunk_id IS NOT NULL)",
        "embed_cache_attach": f"SELECT c.chunk_key, round(v.embedding[1]::DOUBLE, 4) AS \"first\" FROM (SELECT DISTINCT chunk_key, chunk_id FROM chunks) c JOIN {CACHED} v USING (chunk_id)",
        "replace_source": f"WITH o AS (SELECT * FROM {chunks('source')}), n AS (SELECT source FROM acts WHERE act_key % 2 = 0) SELECT chunk_key, source FROM o WHERE source IS NULL OR source NOT IN (SELECT source FROM n) UNION ALL SELECT -chunk_key, source FROM o WHERE source IN (SELECT source FROM n)",
        "hybrid_retrieve": cascade(search),
        "retrieve_candidates": cascade(search).replace("FROM retrieval_queries", "FROM (SELECT * REPLACE (CASE WHEN query_id % 3 = 0 THEN 'criminal' ELSE category END AS category) FROM retrieval_queries)")
        .replace("WHERE r <= 20)", "WHERE r <= 20 AND score >= 0.3)").rsplit("SELECT query_id, row_number()", 1)[0]
        + "SELECT query_id, chunk_key, category, round(score, 4) + 0.0::DOUBLE AS score, 'result' AS kind, asked AS asked_category FROM one UNION ALL SELECT query_id, chunk_key, category, round(round(score, 9), 4) + 0.0::DOUBLE, 'candidate', asked FROM fused",
        "nearest_texts": f"""WITH a AS MATERIALIZED (SELECT query_id, {embedded('original_query')} AS v FROM retrieval_queries), b AS MATERIALIZED (SELECT chunk_key, {embedded("coalesce(text, '')")} AS v FROM {chunks('text')}),
            d AS (SELECT query_id, chunk_key, round({SQUARED}, 12) AS distance FROM a, b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_key) AS rank FROM d)
            SELECT query_id, chunk_key, round(distance, 4) + 0.0::DOUBLE AS distance, rank FROM r WHERE rank <= 5""",
        "stream_ingest": f"WITH {ingested(f'(SELECT *, 1 AS version FROM {SECTIONS})')} SELECT source, count(*) AS n FROM x GROUP BY source",
        "store_chunks": f"WITH {STORED} SELECT source, category, chunk_id FROM live",
        "store_vectors": f"WITH {STORED} SELECT source, count(*) AS n FROM live GROUP BY source UNION ALL SELECT DISTINCT source || ':' || version, 1 FROM v",
        "bm25_saved": f"WITH {BM25} SELECT term, df, round(idf, 4) AS idf FROM terms",
        "scan_files": f"SELECT coalesce(category, 'none') AS category, md5(regexp_replace(text, '[\\n\\r\\f]+', ' ', 'g')) AS md5 FROM (SELECT DISTINCT section_key, category, text FROM parsed_sections) WHERE trim(regexp_replace(coalesce(text, ''), '[\\n\\r\\f]+', ' ', 'g')) <> ''",
        "sections_json": "SELECT coalesce(category, 'none') AS category, act_name, section_number, section_title, array_to_string(topics, '|') AS topics, md5(text) AS md5 FROM (SELECT DISTINCT section_key, category, act_name, section_number, section_title, topics, text FROM parsed_sections)",
        "dimension_json": "SELECT subject_no, subject, prototype, array_to_string(hindi_terms, '|') AS hindi_terms FROM subject_areas",
        "fetch_failed": f"SELECT source FROM {FETCHED} WHERE url IS NULL",
        "fetch_documents": """SELECT act_key, CASE WHEN failed THEN NULL ELSE 'host/' || CASE WHEN act_key % 2 = 0 THEN 'first/' ELSE 'second/' END || act_key END AS url, CASE WHEN failed THEN NULL ELSE 'act ' || act_key END AS content, failed
            FROM (SELECT act_key, act_key % 5 = 0 AS failed FROM acts)""",
        "parse_failed": f"""WITH docs AS (SELECT doc_id AS doc, {clean("split_part(text, chr(10), 1)")} AS text FROM documents WHERE text IS NOT NULL), source_text AS (SELECT * FROM docs), {spans('text')}, {folded()},
            p AS (SELECT DISTINCT doc FROM folded UNION SELECT doc FROM ({paragraphs('docs')}))
            SELECT doc_id::VARCHAR AS path, CASE WHEN text IS NULL THEN 'no text' ELSE 'no sections' END AS reason FROM documents WHERE doc_id NOT IN (SELECT doc FROM p)""",
        "rerank_batched": RERANKED,
        "leaked_results": f"SELECT r.query_id, result_id, act_name, section_number, r.category, q.category AS category_filter FROM {RESULTS} r JOIN (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'criminal' ELSE category END AS category FROM retrieval_queries) q USING (query_id) WHERE coalesce(q.category, '') <> '' AND coalesce(r.category, '') <> '' AND r.category <> q.category",
        "eval_passed": f"WITH {OUTCOMES} SELECT count(*) AS cases, count(*) FILTER (strict_rank IS NULL) AS misses, count(*) FILTER (strict_rank IS NULL) = 0 AS passed FROM outcomes",
        "eval_report": METRICS,
        "assign_ids": "SELECT doc_id, 99 + row_number() OVER (ORDER BY coalesce(source, ''), doc_id) AS number FROM documents",
    }
