"""The retrieval cascade for a batch of queries, as one plan.

Context (category, intents, expanded text), the nearest vectors of the routed category, their BM25 scores
standardised over the whole corpus, fusion, rerank of the best, the top k, distinct citations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.embed import Embedder, hashing
from ..operators import fusion, lexical, routing, vectors
from ..session import broadcast_if_small, staged

SHOWN = ["text", "citation", "section_number", "section_title", "chapter", "act_name", "short_name", "year", "category", "source"]


def contexts(queries: DataFrame, prototypes: DataFrame, intents: DataFrame, cfg: Config = Config(), embed: Embedder | None = None) -> DataFrame:
    """query_id, query -> a context row each, as `retrieve` takes them.

    prototypes: category, prototype, in the order in which ties are broken (column pos). intents: intent, category,
    anchors, prototype, examples, pos. Both are dimension tables; they and the queries are embedded once.
    """
    embed = embed or hashing()
    c = F.col
    asked = staged(queries.select("query_id", "query", embed(c("query")).alias("vector")), "asked")
    known = staged(prototypes.select("category", "pos", embed(c("prototype")).alias("vector")), "prototypes")
    text = routing.intent_text(c("examples"), c("anchors"), c("prototype"), c("intent"))
    wanted = staged(intents.select("intent", "category", "anchors", "pos", embed(text).alias("vector")), "intents")
    routed = staged(routing.route(routing.route_scores(asked, known), cfg.route), "routed")
    return routing.context(asked, routed, routing.match_intents(asked, routed, wanted, cfg.route))


def nearest_texts(queries: DataFrame, store: DataFrame, k: int = 20, category: str | None = None, embed: Embedder | None = None, dim: int = 64) -> DataFrame:
    """For a look at the store: query_id, doc, distance, rank of the k nearest rows of each query's text."""
    embed = embed or hashing(dim)
    rows = store.where(F.col("category") == category) if category else store
    found = vectors.knn(rows, queries.select("query_id", embed(F.col("query")).alias("vector")), "doc", "embedding", "query_id", "vector", k, dim=dim)
    return found.select(F.col("query").alias("query_id"), F.col("id").alias("doc"), "distance", "rank")


@dataclass(frozen=True)
class Retrieved:
    """What a batch of queries gave: results, the contexts they were asked with, all candidates with their features and scores."""

    results: DataFrame
    contexts: DataFrame
    candidates: DataFrame


def retrieve(queries: DataFrame, chunks: DataFrame, store: DataFrame, cfg: Config = Config(), top_k: int | None = None, min_score: float | None = None, embed: Embedder | None = None, dim: int = 64) -> DataFrame:
    """The results of `retrieve_all`: query_id, rank, doc, SHOWN, topics, semantic_score, bm25_score, score, rerank_score, final_score."""
    return retrieve_all(queries, chunks, store, cfg, top_k, min_score, embed, dim).results


def retrieve_all(queries: DataFrame, chunks: DataFrame, store: DataFrame, cfg: Config = Config(), top_k: int | None = None, min_score: float | None = None, embed: Embedder | None = None, dim: int = 64) -> Retrieved:
    """queries: a context row each (query_id, original_query, expanded_query, intents, anchors, category, category_filter or not).

    chunks: doc, topics and SHOWN. store: doc, category, embedding. A category_filter of the query takes the place of
    its routed category.
    """
    f = cfg.fusion
    embed = embed or hashing(dim)
    c = F.col
    asked = F.coalesce("category_filter", "category") if "category_filter" in queries.columns else c("category")
    none = F.array().cast("array<string>")
    q = queries.select("query_id", c("original_query").alias("query"), F.coalesce("expanded_query", "original_query").alias("expanded"), F.coalesce("intents", none).alias("intents"), F.coalesce("anchors", none).alias("anchors"), asked.alias("asked_category"))
    parts = (c("expanded"), c("anchors"), c("asked_category"), c("intents"))
    q = q.withColumn("main_text", routing.query_text(*parts)).withColumn("lexical_text", routing.lexical_text(*parts))
    q = q.withColumn("main", embed(c("main_text"))).withColumn("anchor", F.when(F.size("anchors") > 0, embed(F.array_join("anchors", " "))))
    q = staged(q.withColumn("vector", vectors.mix(c("main"), c("anchor"), f.main_vector, f.anchor_vector)).drop("main", "anchor"), "queries")

    near = vectors.knn(store, q, "doc", "embedding", "query_id", "vector", f.vector_depth, filter_col="category", query_filter="asked_category", dim=dim)
    near = near.select(c("query").alias("query_id"), c("id").alias("doc"), "distance", vectors.similarity(c("distance")).alias("semantic"))
    index = lexical.build(chunks, "doc", "text", cfg.bm25)
    near = staged(near, "near")
    pairs = near.select(c("query_id").alias("query"), "doc")
    scored, moments = (x.withColumnRenamed("query", "query_id") for x in lexical.scores_and_moments(index, q, "query_id", "lexical_text", pairs))

    rows = near.join(scored, ["query_id", "doc"], "left").join(broadcast_if_small(moments), "query_id", "left")
    bm25 = F.coalesce("score", F.lit(0.0))
    z = F.coalesce((bm25 - c("mean")) / (c("std") + f.std_guard), F.lit(0.0))
    rows = rows.select("query_id", "doc", "distance", "semantic", bm25.alias("bm25"), z.alias("z"))
    rows = rows.join(broadcast_if_small(q.select("query_id", "query", "intents", "anchors", "asked_category")), "query_id")
    rows = rows.join(chunks.select("doc", "topics", *SHOWN), "doc").where(F.coalesce("text", F.lit("")) != "")
    # To nine decimals, so that the order of a sum decides nothing.
    candidates = staged(fusion.fuse(rows, f).withColumn("score", F.round("score", 9)), "fused")
    rows = fusion.best(candidates, f.fused_depth, "score", "distance", "doc", out="_r").drop("_r")
    rows = fusion.finish(fusion.rerank(fusion.kept(rows, min_score), f), top_k or f.top_k, "doc", cfg=f)
    shown = [F.round("semantic", 4).alias("semantic_score"), F.round("bm25", 4).alias("bm25_score")]
    results = rows.select("query_id", "rank", "doc", *SHOWN, "topics", *shown, "score", "rerank_score", "final_score")
    return Retrieved(results, q.drop("vector"), candidates)
