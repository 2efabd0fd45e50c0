"""Every query by name, each over its whole tables. Their SQL is in `oracles`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, FusionConfig, RouteConfig
from ..functions import text as T
from ..functions.embed import hashing, pairs_from_batches
from ..operators import chunks as C
from ..operators import evaluation, fusion, ingestion, lexical, routing, sections, vectors
from ..session import broadcast_if_small, read, shared_folder, staged
from ..sources import files
from ..sources.store import Store
from ..streaming.ingest import ingest_stream
from . import oracles
from .retrieve import SHOWN, contexts, nearest_texts as probe, retrieve, retrieve_all

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
c = F.col


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r4(name: str):
    """To four decimals, and no negative zero."""
    return F.round(name, 4) + F.lit(0.0)


def quick_r4(name: str):
    """r4 for results of very many rows: F.round makes a decimal number of each, about a third of the JVM's time. For |x| < 10^14 and no NaN."""
    return F.signum(name) * F.floor(F.abs(name) * 10000.0 + 0.5) / F.lit(10000.0) + F.lit(0.0)


def chunks_of(s: SparkSession, d: str, *cols: str) -> DataFrame:
    """Chunks delivered again count once."""
    return read(s, d, "chunks").select("chunk_key", *cols).distinct()


def sections_of(s: SparkSession, d: str, *cols: str) -> DataFrame:
    return read(s, d, "parsed_sections").select("section_key", *cols).distinct()


def results_of(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "retrieval_results").drop("retrieved_at").distinct()


# Text ------------------------------------------------------------------------------------------------------------


@query
def clean_text(s, d):
    return read(s, d, "documents").select("doc_id", T.clean(c("text")).alias("text"))


@query
def sentence_split(s, d):
    rows = read(s, d, "documents").select("doc_id", F.posexplode(T.sentences(c("text"))).alias("pos", "sentence"))
    return rows.select("doc_id", (c("pos") + 1).cast("long").alias("pos"), "sentence")


@query
def tokenize_alnum(s, d):
    toks = T.tokens(c("text"))
    return chunks_of(s, d, "text").select("chunk_key", F.size(toks).cast("long").alias("n"), F.array_join(toks, " ").alias("tokens")).where("tokens is not null")


@query
def tokenize_ws(s, d):
    toks = T.tokens_ws(c("text"))
    return chunks_of(s, d, "text").where("text is not null").select("chunk_key", F.size(toks).cast("long").alias("n"), F.array_join(toks, " ").alias("tokens"))


@query
def act_metadata(s, d):
    rows = read(s, d, "chunks").where("source is not null").select("source").distinct().withColumn("stem", files.stem(c("source")))
    return rows.select("source", *(v.alias(k) for k, v in sections.act_metadata(c("stem")).items()))


@query
def metadata_lookup(s, d):
    """Metadata by source from the acts, with what the file's name tells where there is none."""
    rows = read(s, d, "chunks").where("source is not null").select("source").distinct().withColumn("stem", files.stem(c("source")))
    known = read(s, d, "acts").where("year > 0").select("source", "act_name", "ministry")
    meta = sections.act_metadata(c("stem"))
    return files.with_defaults(rows, known, "source", {k: meta[k] for k in ("act_name", "ministry")}).drop("stem")


@query
def topic_tags(s, d):
    found = T.topics(c("text"), default=True)
    return chunks_of(s, d, "text").select("chunk_key", F.array_join(found, ", ").alias("topics"))


@query
def topic_histogram(s, d):
    rows = chunks_of(s, d, "text").select(F.explode(T.topics(c("text"), default=True)).alias("topic"))
    return rows.groupBy("topic").agg(F.count("*").alias("n"))


@query
def low_value_filter(s, d):
    phrases = [*T.LOW_VALUE, "inquiry into", "penalty in respect of"]
    return chunks_of(s, d, "section_title").where(~T.is_low_value(c("section_title"), phrases))


@query
def search_text(s, d):
    cols = ("act_name", "section_number", "section_title", "chapter", "text")
    return chunks_of(s, d, *cols).select("chunk_key", T.search_text(*map(c, cols)).alias("search_text"))


@query
def document_text(s, d):
    cols = ("act_name", "category", "section_number", "section_title", "text")
    shown = T.document_text(c("act_name"), c("category"), c("section_number"), c("section_title"), T.topics(c("text")), c("text"))
    return chunks_of(s, d, *cols).select("chunk_key", shown.alias("document_text"))


@query
def section_number_extract(s, d):
    rows = read(s, d, "retrieval_queries").select("query_id", "original_query").unionByName(read(s, d, "documents").select(c("doc_id").alias("query_id"), c("text").alias("original_query")))
    return rows.select("query_id", T.section_number(c("original_query")).alias("section_number"))


# Sections --------------------------------------------------------------------------------------------------------


def acts_text(s: SparkSession, d: str) -> DataFrame:
    """Whole acts, put together from their sections, with chapter heads, and footnotes as amended prints have them."""
    text = F.concat(
        F.when(c("section_key") % 5 == 0, F.concat(F.lit("CHAPTER "), (c("section_key") % 20 + 1).cast("string"), F.lit("\n"), F.coalesce("chapter", F.lit("")), F.lit("\n"))).otherwise(""),
        F.coalesce("text", F.lit("")),
        F.when(c("section_key") % 7 == 0, F.lit(oracles.FOOTNOTE)).otherwise(""),
    )
    rows = sections_of(s, d, "source", "chapter", "text").withColumn("part", text)
    rows = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("section_key", "part"))).alias("parts"))
    return rows.select(F.regexp_replace("source", r"\.json$", "").alias("doc"), F.array_join(F.transform("parts", lambda x: x["part"]), "\n").alias("text"))


@query
def section_split(s, d):
    rows = sections.spans(acts_text(s, d)).where("pos >= 1")
    return rows.select("doc", c("pos").cast("long").alias("pos"), "section_number", "section_title", F.length("span").cast("long").alias("chars"), F.md5("span").alias("md5"))


@query
def chapter_asof(s, d):
    rows = sections.with_chapters(sections.spans(acts_text(s, d)))
    return rows.select("doc", c("pos").cast("long").alias("pos"), "section_number", "chapter")


@query
def footnote_classify(s, d):
    rows = sections.spans(acts_text(s, d)).where("pos >= 1")
    return rows.select("doc", c("pos").cast("long").alias("pos"), sections.is_footnote(c("section_title"), c("span")).alias("footnote"))


@query
def footnote_fold(s, d):
    rows = sections.fold_footnotes(sections.with_chapters(sections.spans(acts_text(s, d))))
    return rows.select("doc", c("pos").cast("long").alias("pos"), "section_number", F.length("text").cast("long").alias("chars"), F.md5("text").alias("md5"))


@query
def section_dedupe(s, d):
    rows = sections.dedupe_numbers(sections.fold_footnotes(sections.with_chapters(sections.spans(acts_text(s, d)))))
    return rows.select("doc", c("pos").cast("long").alias("pos"), "section_number", "section_title", "chapter", F.md5("text").alias("md5"))


@query
def paragraph_fallback(s, d):
    docs = read(s, d, "documents").select(c("doc_id").alias("doc"), "text").where("text is not null")
    return sections.paragraphs(docs).select("doc", c("pos").cast("long").alias("pos"), "section_number", "text")


@query
def parse_acts(s, d):
    raw = acts_text(s, d).select(c("doc").alias("path"), F.lit("statute").alias("category"), "text")
    rows = sections.parse_acts(raw)
    return rows.select("path", "act_name", "short_name", "chapter", "section_number", "section_title", "citation", c("char_count").cast("long").alias("char_count"), c("pos").cast("long").alias("pos"), F.md5("text").alias("md5"))


@query
def parse_failed(s, d):
    """Documents without text, and those without section heads whose paragraphs are all short."""
    docs = read(s, d, "documents").select(c("doc_id").cast("string").alias("path"), F.lit("statute").alias("category"), F.substring_index("text", "\n", 1).alias("text"))
    return sections.parse_failures(docs, sections.parse_acts(docs))


# Chunks ----------------------------------------------------------------------------------------------------------


@query
def greedy_chunks(s, d):
    rows = read(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(C.pieces(c("text"))).alias("pos", "chunk"))
    return rows.select("doc_id", c("pos").cast("long").alias("pos"), "chunk")


@query
def legacy_chunks(s, d):
    rows = read(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(C.legacy_pieces(c("text"))).alias("pos", "chunk"))
    return rows.select("doc_id", c("pos").cast("long").alias("pos"), "chunk")


@query
def chunk_records(s, d):
    rows = sections_of(s, d, "act_name", "section_number", "section_title", "chapter", "short_name", "year", "category", "source", "text", "citation")
    return C.chunk_sections(rows, keep=("section_key",)).withColumns({x: c(x).cast("long") for x in ("chunk_index", "total_chunks")})


# Lexical retrieval -----------------------------------------------------------------------------------------------


def index_of(s: SparkSession, d: str) -> lexical.Bm25Index:
    return lexical.build(chunks_of(s, d, "text"), "chunk_key", "text")


def lexical_queries(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "retrieval_queries").select("query_id", routing.lexical_text(c("expanded_query"), c("anchors"), c("category"), c("intents")).alias("text"))


@query
def bm25_stats(s, d):
    return index_of(s, d).terms.select("term", "df", F.round("idf", 4).alias("idf"))


@query
def bm25_saved(s, d):
    """The statistics of an index that was saved and loaded again."""
    folder = f"{shared_folder(s)}/bm25-{uuid.uuid4().hex}"
    lexical.save(index_of(s, d), folder)
    return lexical.load(s, folder).terms.select("term", "df", F.round("idf", 4).alias("idf"))


@query
def bm25_scores(s, d):
    rows = lexical.scores(index_of(s, d), lexical_queries(s, d), "query_id", "text")
    return rows.select(c("query").alias("query_id"), c("doc").alias("chunk_key"), quick_r4("score").alias("score"))


@query
def bm25_topk(s, d):
    rows = lexical.top_k(index_of(s, d), read(s, d, "retrieval_queries"), "query_id", "original_query", 5)
    return rows.select(c("query").alias("query_id"), c("doc").alias("chunk_key"), r4("score").alias("score"), c("rank").cast("long").alias("rank"))


@query
def bm25_zscore_sigmoid(s, d):
    index = index_of(s, d)
    rows = lexical.z_scores(index, *lexical.scores_and_moments(index, lexical_queries(s, d), "query_id", "text"))
    return rows.select(c("query").alias("query_id"), c("doc").alias("chunk_key"), quick_r4("z").alias("z"), quick_r4("squashed").alias("squashed"))


# Vectors ---------------------------------------------------------------------------------------------------------


def vectors_of(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "chunk_vectors").select("vec_id", "embedding", c("metadata.category").alias("category"))
    return rows.where(F.size("embedding") == 64).groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.min("category").alias("category"))


@query
def knn_l2(s, d):
    """Queries are the rows whose id 50 divides, against all rows."""
    rows = vectors_of(s, d)
    found = vectors.knn(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", "embedding", 50)
    return found.select(c("query").alias("query_id"), c("id").alias("vec_id"), r4("distance").alias("distance"), F.round(vectors.similarity(c("distance")), 4).alias("similarity"), c("rank").cast("long").alias("rank"))


@query
def knn_filtered(s, d):
    rows = vectors_of(s, d)
    found = vectors.knn(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", "embedding", 20, "l2sq", "category")
    return found.select(c("query").alias("query_id"), c("id").alias("vec_id"), r4("distance").alias("distance"), c("rank").cast("long").alias("rank"))


@query
def knn_cosine(s, d):
    rows = vectors_of(s, d)
    found = vectors.knn(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", "embedding", 10, "cosine")
    return found.select(c("query").alias("query_id"), c("id").alias("vec_id"), r4("distance").alias("distance"), c("rank").cast("long").alias("rank"))


def prototypes_of(s: SparkSession, d: str) -> DataFrame:
    """A label's vector of the lowest id stands for it."""
    rows = read(s, d, "embeddings").groupBy("label").agg(F.min("vec_id").alias("pos"), F.min_by("embedding", "vec_id").alias("vector"))
    return rows.select(c("label").cast("string").alias("category"), "pos", "vector")


def embedded(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "embeddings").select(c("vec_id").alias("query_id"), c("embedding").alias("vector"))


@query
def cosine_scores(s, d):
    return routing.route_scores(embedded(s, d), prototypes_of(s, d)).select("query_id", "category", r4("score").alias("score"))


@query
def vector_mix(s, d):
    """Each vector mixed with its label's prototype; without one where its id is odd."""
    rows = read(s, d, "embeddings").select("vec_id", "embedding", c("label").cast("string").alias("category"))
    rows = rows.join(broadcast_if_small(prototypes_of(s, d)), "category").withColumn("anchor", F.when(c("vec_id") % 2 == 0, c("vector")))
    mixed = rows.withColumn("mixed", vectors.mix(c("embedding"), c("anchor")))
    return mixed.select("vec_id", F.round(vectors.dot(c("mixed"), c("mixed")), 4).alias("norm2"), F.round(vectors.squared_l2(c("mixed"), c("embedding")), 4).alias("moved"))


# Routing ---------------------------------------------------------------------------------------------------------


@query
def route_category(s, d):
    rows = routing.route(routing.route_scores(embedded(s, d), prototypes_of(s, d)))
    return rows.select("query_id", "category", "confidence")


@query
def route_ranked(s, d):
    """All scores of a query, best first."""
    rows = routing.route(routing.route_scores(embedded(s, d), prototypes_of(s, d)))
    return rows.select("query_id", F.posexplode("all_scores").alias("pos", "x")).select("query_id", c("pos").cast("long").alias("pos"), "x.category", "x.score")


SUBJECTS = Config(route=RouteConfig(threshold=0.2, intent_floor=0.2))


def areas_of(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, prototypes and intents: both dimensions are the subject areas."""
    areas = read(s, d, "subject_areas")
    prototypes = areas.select(c("subject").alias("category"), c("subject_no").alias("pos"), "prototype")
    intents = areas.select(F.concat(F.lit("about_"), c("subject")).alias("intent"), c("subject").alias("category"), F.array(c("subject")).alias("anchors"), "prototype", F.split("prototype", ", ").alias("examples"), c("subject_no").alias("pos"))
    return read(s, d, "retrieval_queries").select("query_id", c("original_query").alias("query")), prototypes, intents


@query
def intent_gap_topk(s, d):
    asked, prototypes, intents = areas_of(s, d)
    text = routing.intent_text(c("examples"), c("anchors"), c("prototype"), c("intent"))
    vectors_ = asked.select("query_id", hashing()(c("query")).alias("vector"))
    routed = routing.route(routing.route_scores(vectors_, prototypes.select("category", "pos", hashing()(c("prototype")).alias("vector"))), SUBJECTS.route)
    rows = routing.match_intents(vectors_, routed, intents.withColumn("vector", hashing()(text)), SUBJECTS.route)
    return rows.select("query_id", "intent", r4("score").alias("score"), c("rank").cast("long").alias("rank"))


@query
def query_context(s, d):
    """Contexts from the queries' texts; queries, prototypes and intents are embedded by the same embedder."""
    rows = contexts(*areas_of(s, d), SUBJECTS)
    return rows.select("query_id", "expanded_query", F.array_join("intents", "|").alias("intents"), "category", F.round("confidence", 4).alias("confidence"), F.array_join("anchors", "|").alias("anchors"))


@query
def intent_text(s, d):
    text = routing.intent_text(F.split("prototype", ", "), c("hindi_terms"), c("prototype"), c("subject"))
    return read(s, d, "subject_areas").select("subject", text.alias("intent_text"))


# Fusion ----------------------------------------------------------------------------------------------------------


def candidates(s: SparkSession, d: str) -> DataFrame:
    rows = results_of(s, d)
    stats = rows.groupBy("query_id").agg(F.avg("bm25_score").alias("mean"), F.stddev_pop("bm25_score").alias("std"))
    rows = rows.join(broadcast_if_small(stats), "query_id").withColumn("z", (c("bm25_score") - c("mean")) / (c("std") + 1e-6))
    queries = read(s, d, "retrieval_queries").select("query_id", c("original_query").alias("query"), "intents", "anchors", c("category").alias("asked_category"))
    titles = chunks_of(s, d, "section_title", "text").withColumn("topics", T.topics(c("text"), default=True))
    rows = rows.select("result_id", "query_id", "chunk_key", "act_name", "section_number", "category", c("semantic_score").alias("semantic"), c("rerank_score").alias("given_rerank"), "z")
    return rows.join(broadcast_if_small(queries), "query_id").join(titles, "chunk_key")


@query
def fusion_features(s, d):
    rows = candidates(s, d)
    return rows.select(
        "result_id", fusion.title_overlap(c("query"), c("section_title")).alias("title"), fusion.category_bonus(c("asked_category"), c("category"), c("topics")).alias("category_bonus"),
        fusion.anchor_bonus(c("anchors"), c("act_name")).alias("anchor_bonus"), F.round(fusion.intent_boost(c("intents"), c("topics")), 4).alias("intent_boost"),
    )


@query
def fusion_score(s, d):
    return fusion.fuse(candidates(s, d)).select("result_id", r4("score").alias("score"))


@query
def fusion_top20(s, d):
    rows = fusion.best(fusion.fuse(candidates(s, d)).withColumn("score", F.round("score", 6)), 20, "score", "result_id")
    return rows.select("query_id", "result_id", "score", c("rank").cast("long").alias("rank"))


@query
def min_score_and_filter(s, d):
    rows = fusion.kept(fusion.fuse(candidates(s, d)), 0.45, "asked_category")
    return rows.select("query_id", "result_id", r4("score").alias("score"))


@query
def diagnostic_acts(s, d):
    """The candidates from the acts of even years."""
    acts = read(s, d, "acts").where("year % 2 = 0").select("act_name").distinct()
    rows = fusion.of_acts(fusion.fuse(candidates(s, d)), acts)
    return rows.select("query_id", "result_id", "act_name", r4("score").alias("score"))


@query
def rerank_overlap(s, d):
    rows = fusion.rerank(fusion.fuse(candidates(s, d)))
    return rows.select("result_id", F.round("rerank_score", 4).alias("rerank_score"), F.round("final_score", 4).alias("final_score"))


@query
def rerank_batched(s, d):
    """A scorer that takes lists of pairs, as a cross-encoder does; here the share of the query's words that the document has."""
    import re

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        found = [[set(re.findall("[a-z0-9]+", x.lower())) for x in pair] for pair in pairs]
        return [len(a & b) / len(a) if a else 0.0 for a, b in found]

    rows = fusion.rerank(fusion.fuse(candidates(s, d)), scorer=pairs_from_batches(score))
    return rows.select("result_id", F.round("rerank_score", 4).alias("rerank_score"), F.round("final_score", 4).alias("final_score"))


@query
def rerank_blend(s, d):
    rows = fusion.blend(results_of(s, d))
    return rows.select("result_id", F.round("final_score", 4).alias("final_score"))


@query
def rerank_min_max(s, d):
    rows = fusion.blend(results_of(s, d), FusionConfig(min_max_rerank=True))
    return rows.select("result_id", F.round("final_score", 4).alias("final_score"))


@query
def limit_then_dedupe(s, d):
    rows = fusion.finish(fusion.blend(results_of(s, d)).withColumn("final_score", F.round("final_score", 6)), 10, "result_id")
    return rows.select("query_id", "result_id", "final_score", c("rank").cast("long").alias("rank"))


@query
def dedupe_then_limit(s, d):
    rows = fusion.finish(fusion.blend(results_of(s, d)).withColumn("final_score", F.round("final_score", 6)), 10, "result_id", cfg=FusionConfig(dedupe_before_limit=True))
    return rows.select("query_id", "result_id", "final_score", c("rank").cast("long").alias("rank"))


# Evaluation ------------------------------------------------------------------------------------------------------


def ranked(s: SparkSession, d: str) -> DataFrame:
    return fusion.best(results_of(s, d), 1 << 30, "score", "result_id")


def gold_of(s: SparkSession, d: str) -> DataFrame:
    """The act and section of a query's first result by id are right; any section of its last one's act will do. Of every fourth query nothing is."""
    rows = results_of(s, d).where("query_id % 4 <> 0").groupBy("query_id").agg(F.min_by(F.struct("act_name", "section_number"), "result_id").alias("a"), F.max_by("act_name", "result_id").alias("b"))
    primary = rows.select("query_id", F.lit("primary").alias("kind"), F.upper(F.substring("a.act_name", 1, 12)).alias("act"), c("a.section_number").alias("section"))
    return primary.unionByName(rows.select("query_id", F.lit("secondary").alias("kind"), F.substring("b", 1, 12).alias("act"), F.lit("").alias("section")))


def outcomes_of(s: SparkSession, d: str) -> DataFrame:
    return evaluation.outcomes(ranked(s, d), gold_of(s, d), read(s, d, "retrieval_queries"))


@query
def first_match_rank(s, d):
    rows = outcomes_of(s, d)
    return rows.select("query_id", *(c(x).cast("long").alias(x) for x in rows.columns[1:]))


@query
def hit_mrr(s, d):
    return evaluation.metrics(outcomes_of(s, d))


@query
def duplicate_citations(s, d):
    return evaluation.duplicate_citations(results_of(s, d))


@query
def category_leakage(s, d):
    asked = F.when(c("query_id") % 3 == 0, "criminal").otherwise(c("category"))
    cases = read(s, d, "retrieval_queries").select("query_id", asked.alias("category_filter"))
    return evaluation.category_leaks(results_of(s, d), cases)


@query
def leaked_results(s, d):
    """Which results leaked, with act, section and category."""
    asked = F.when(c("query_id") % 3 == 0, "criminal").otherwise(c("category"))
    cases = read(s, d, "retrieval_queries").select("query_id", asked.alias("category_filter"))
    return evaluation.leaked_results(results_of(s, d), cases).select("query_id", "result_id", "act_name", "section_number", "category", "category_filter")


@query
def eval_passed(s, d):
    return evaluation.passed(outcomes_of(s, d))


@query
def eval_report(s, d):
    """The metrics written as a report and read again."""
    folder = f"{shared_folder(s)}/report-{uuid.uuid4().hex}"
    rows = hit_mrr(s, d)
    files.write_report(rows, folder)
    return s.read.schema(rows.schema).json(f"{folder}/json").select(rows.columns)


@query
def wrong_but_sure(s, d):
    rows = ranked(s, d).withColumn("final_score", c("score"))
    return evaluation.wrong_but_sure(rows, outcomes_of(s, d), 0.4).withColumn("final_score", F.round("final_score", 4))


# Sources, ingestion ----------------------------------------------------------------------------------------------


@query
def source_histogram(s, d):
    return chunks_of(s, d, "source").groupBy("source").agg(F.count("*").alias("n"))


@query
def distinct_acts(s, d):
    return results_of(s, d).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("act_name")), "|").alias("acts"))


def attempts(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(c("doc_id") % 4 == 0, "text/html").when(c("doc_id") % 4 == 1, "application/PDF").otherwise("application/octet-stream")
    status = F.when(c("doc_id") % 3 == 0, 200).otherwise(404)
    return read(s, d, "documents").select("source", c("doc_id").alias("pos"), F.concat(F.lit("u"), c("doc_id").cast("string")).alias("url"), status.alias("status"), kind.alias("content_type"))


@query
def fetch_first_success(s, d):
    return files.first_fetched(attempts(s, d), "source")


@query
def fetch_summary(s, d):
    return files.fetch_summary(files.first_fetched(attempts(s, d), "source"))


def keyed(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "documents").select("doc_id", ingestion.file_key(F.coalesce("source", F.lit("")), c("doc_kind"), F.coalesce("text", F.lit(""))).alias("file_key"))
    return rows


def manifest_of(s: SparkSession, d: str) -> DataFrame:
    """The keys of the labelled documents."""
    return keyed(s, d).join(read(s, d, "doc_subject_labels").select("doc_id").distinct(), "doc_id", "left_semi")


@query
def fetch_failed(s, d):
    return files.failed_fetches(files.first_fetched(attempts(s, d), "source"), "source")


@query
def fetch_documents(s, d):
    """The acts fetched from an invented host that has no document at the first address of every other act, and none of some acts."""

    def get(url: str) -> tuple[int, str, bytes]:
        number = int(url.rsplit("/", 1)[1])
        if "/first/" in url and number % 2:
            return 404, "text/html", b""
        if number % 5 == 0:
            raise TimeoutError("no answer")
        return 200, "application/pdf", f"act {number}".encode()

    number = c("act_key").cast("string")
    rows = read(s, d, "acts").select("act_key", F.array(F.concat(F.lit("host/first/"), number), F.concat(F.lit("host/second/"), number)).alias("urls"))
    return files.fetch(rows, "act_key", get).select("act_key", "url", c("content").cast("string").alias("content"), c("error").isNotNull().alias("failed"))


@query
def scan_files(s, d):
    """Texts written to files by category, found again at any depth; the category comes from the folder."""
    folder = f"{shared_folder(s)}/files-{uuid.uuid4().hex}"
    one_line = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\n\r\f]+", " ")
    sections_of(s, d, "category", "text").select(F.coalesce("category", F.lit("none")).alias("category"), one_line.alias("value")).where("trim(value) <> ''").write.partitionBy("category").text(folder)
    rows = files.scan_documents(s, folder, files.text_pages, "*.txt")
    lines = rows.select(F.regexp_replace("category", "^category=", "").alias("category"), F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.select(c("category"), F.md5("line").alias("md5"))


@query
def sections_json(s, d):
    """Parsed sections written as JSON and read again."""
    folder = f"{shared_folder(s)}/sections-{uuid.uuid4().hex}"
    cols = ("category", "act_name", "section_number", "section_title", "topics", "text")
    rows = sections_of(s, d, *cols).select(F.coalesce("category", F.lit("none")).alias("category"), *cols[1:])
    files.write_sections(rows, folder)
    return files.read_sections(s, folder).select("category", "act_name", "section_number", "section_title", F.array_join("topics", "|").alias("topics"), F.md5("text").alias("md5"))


@query
def dimension_json(s, d):
    """The subject areas written as one JSON array and read again."""
    path = f"{shared_folder(s)}/areas-{uuid.uuid4().hex}"
    files.write_dimension(read(s, d, "subject_areas").select("subject_no", "subject", "prototype", "hindi_terms"), path)
    rows = files.read_dimension(s, path, "subject_no int, subject string, prototype string, hindi_terms array<string>")
    return rows.select("subject_no", "subject", "prototype", F.array_join("hindi_terms", "|").alias("hindi_terms"))


@query
def incremental_new(s, d):
    return ingestion.new_rows(keyed(s, d), manifest_of(s, d), "file_key").select("doc_id", "file_key")


@query
def incremental_skipped(s, d):
    return ingestion.skipped_rows(keyed(s, d), manifest_of(s, d), "file_key").select("doc_id", "file_key")


@query
def ingest_summary(s, d):
    rows, known = keyed(s, d), manifest_of(s, d)
    return ingestion.summary(ingestion.new_rows(rows, known, "file_key"), ingestion.skipped_rows(rows, known, "file_key"), rows)


def cached(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "chunk_vectors").where(F.size("embedding") == 64)
    return rows.groupBy(c("metadata.chunk_id").alias("chunk_id")).agg(F.min("embedding").alias("embedding"))


@query
def embed_cache_miss(s, d):
    return ingestion.new_rows(read(s, d, "chunks").select("chunk_key", "chunk_id").distinct(), cached(s, d), "chunk_id").select("chunk_key", "chunk_id")


@query
def embed_cache_attach(s, d):
    rows = ingestion.attach(read(s, d, "chunks").select("chunk_key", "chunk_id").distinct(), cached(s, d), "chunk_id")
    return rows.select("chunk_key", F.round(c("embedding")[0].cast("double"), 4).alias("first"))


@query
def replace_source(s, d):
    """The chunks with those of every source that has new rows replaced; the second half of the acts are new."""
    old = chunks_of(s, d, "source")
    new = old.join(read(s, d, "acts").where("act_key % 2 = 0").select("source"), "source", "left_semi").withColumn("chunk_key", -c("chunk_key"))
    return ingestion.replace_source(old, new)


@query
def assign_ids(s, d):
    return ingestion.assign_ids(read(s, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source")), ["source", "doc_id"], 100, "number").select("doc_id", c("number").cast("long").alias("number"))


# The whole cascade -----------------------------------------------------------------------------------------------


def corpus(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The chunks and their vectors."""
    cols = [x for x in SHOWN if x not in ("text",)]
    rows = chunks_of(s, d, "text", *cols).withColumnRenamed("chunk_key", "doc")
    rows = staged(rows.withColumn("category", F.lower("category")).withColumn("topics", T.topics(c("text"), default=True)), "corpus")
    text = T.search_text(*(c(x) for x in ("act_name", "section_number", "section_title", "chapter", "text")))
    return rows, rows.select("doc", "category", hashing(64)(text).alias("embedding"))


@query
def hybrid_retrieve(s, d):
    """All queries against all chunks; both sides by the hashing embedder, in the routed category."""
    found = retrieve(read(s, d, "retrieval_queries"), *corpus(s, d))
    return found.select("query_id", c("rank").cast("long").alias("rank"), c("doc").alias("chunk_key"), "act_name", "section_number", "citation", "semantic_score", "bm25_score", r4("score").alias("score"), F.round("rerank_score", 4).alias("rerank_score"), F.round("final_score", 4).alias("final_score"))


INGESTED = ("category", "act_name", "year", "chapter", "section_number", "section_title", "topics", "text", "citation", "char_count", "short_name", "source")


@query
def stream_ingest(s, d):
    """The parsed sections as a stream of files into a new store, run twice; the second run finds nothing new."""
    base = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    sections_of(s, d, *INGESTED).drop("section_key").withColumn("ministry", F.lit(None).cast("string")).write.parquet(f"{base}/in")
    store = Store(s, f"{base}/store")
    for run in ("first", "again"):
        ingest_stream(s, f"{base}/in", store, f"{base}/{run}").awaitTermination()
    return store.rows_by_source()


def stored(s: SparkSession, d: str) -> Store:
    """The acts' sections in a store, of which those of even years came a second time, changed, and the store was compacted."""
    store = Store(s, f"{shared_folder(s)}/store-{uuid.uuid4().hex}")
    rows = sections_of(s, d, *INGESTED).drop("section_key").where("source is not null").withColumn("ministry", F.lit(None).cast("string"))
    store.ingest(rows.withColumn("file_key", F.concat("source", F.lit(":1"))), reset=True)
    changed = rows.where("year % 2 = 0").withColumns({"file_key": F.concat("source", F.lit(":2")), "text": F.concat(F.lit("New: "), "text")})
    store.ingest(changed)
    store.compact()
    return store


@query
def store_chunks(s, d):
    return stored(s, d).chunks.select("source", "category", "chunk_id")


@query
def store_vectors(s, d):
    """Every chunk of the store has its vector, and the cache one for each text that was embedded."""
    store = stored(s, d)
    rows = store.vectors.join(store.chunks.select("category", "chunk_id"), ["category", "chunk_id"]).groupBy("source").agg(F.count("*").alias("n"))
    return rows.unionByName(store.manifest.select(c("file_key").alias("source"), F.lit(1).cast("long").alias("n")))


@query
def nearest_texts(s, d):
    """A look at the store: the nearest chunks of each query's text."""
    rows = chunks_of(s, d, "text").select(c("chunk_key").alias("doc"), hashing(64)(c("text")).alias("embedding"))
    found = probe(read(s, d, "retrieval_queries").select("query_id", c("original_query").alias("query")), rows, 5)
    return found.select("query_id", c("doc").alias("chunk_key"), r4("distance").alias("distance"), c("rank").cast("long").alias("rank"))


@query
def retrieve_candidates(s, d):
    """All candidates of the cascade beside its results, with a category filter on some queries and a least score."""
    asked = read(s, d, "retrieval_queries").withColumn("category_filter", F.when(c("query_id") % 3 == 0, "criminal"))
    got = retrieve_all(asked, *corpus(s, d), min_score=0.3)
    cols = ["query_id", c("doc").alias("chunk_key"), "category", r4("score").alias("score")]
    rows = got.candidates.select(*cols, F.lit("candidate").alias("kind")).unionByName(got.results.select(*cols, F.lit("result").alias("kind")))
    return rows.join(broadcast_if_small(got.contexts.select("query_id", "asked_category")), "query_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.sql().items() if k in QUERIES}
