"""Candidates to results: features, fusion, rerank, top k, distinct citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FusionConfig
from ..functions.text import tokens
from ..session import broadcast_if_small


def title_overlap(query: Column, title: Column, cfg: FusionConfig = FusionConfig()) -> Column:
    shared = F.size(F.array_intersect(F.coalesce(tokens(query), F.array().cast("array<string>")), F.coalesce(tokens(title), F.array().cast("array<string>"))))
    return F.when(shared == 0, F.lit(cfg.title_miss)).otherwise(F.lit(cfg.title_hit))


def category_bonus(asked: Column, category: Column, topics: Column, cfg: FusionConfig = FusionConfig()) -> Column:
    """For the same category; a smaller one where the asked category occurs in the topics."""
    there = asked.isNotNull() & (asked != "") & category.isNotNull() & (category != "")
    return F.when(there & (category == asked), cfg.category_bonus).when(there & F.contains(F.array_join(topics, ", "), asked), cfg.topic_bonus).otherwise(0.0)


def anchor_bonus(anchors: Column, act: Column, cfg: FusionConfig = FusionConfig()) -> Column:
    """For an act whose name occurs in an anchor. An empty name occurs in any."""
    low = F.lower(F.coalesce(act, F.lit("")))
    return F.when(F.exists(F.coalesce(anchors, F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), low)), cfg.anchor_bonus).otherwise(0.0)


def intent_boost(intents: Column, topics: Column, cfg: FusionConfig = FusionConfig()) -> Column:
    none = F.array().cast("array<string>")
    return F.size(F.array_intersect(F.coalesce(intents, none), F.coalesce(topics, none))) * F.lit(cfg.intent_boost)


def fuse(rows: DataFrame, cfg: FusionConfig = FusionConfig()) -> DataFrame:
    """Adds score to rows with query, asked_category, anchors, intents, section_title, category, topics, act_name, semantic, z."""
    c = F.col
    score = (
        F.lit(cfg.semantic) * c("semantic")
        + F.lit(cfg.lexical) * (1 / (1 + F.exp(-c("z"))))
        + category_bonus(c("asked_category"), c("category"), c("topics"), cfg)
        + anchor_bonus(c("anchors"), c("act_name"), cfg)
        + intent_boost(c("intents"), c("topics"), cfg)
        + title_overlap(c("query"), c("section_title"), cfg)
    )
    return rows.withColumn("score", score)


def best(rows: DataFrame, k: int, by: str, *ties: str, query: str = "query_id", out: str = "rank") -> DataFrame:
    """The k best of each query. Nulls are last."""
    w = Window.partitionBy(query).orderBy(F.desc_nulls_last(by), *ties)
    return rows.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def lexical_overlap(query: Column, document: Column) -> Column:
    """The default reranker: the share of the query's different tokens that the document has."""
    q = F.array_distinct(F.coalesce(tokens(query), F.array().cast("array<string>")))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, tokens(document))).cast("double"), F.size(q)), F.lit(0.0))


def pair_texts(query: Column, intents: Column, act: Column, number: Column, title: Column, text: Column) -> tuple[Column, Column]:
    e = lambda c: F.coalesce(c, F.lit(""))
    asked = F.concat(query, F.lit(". Related legal concepts: "), F.array_join(F.coalesce(intents, F.array().cast("array<string>")), " "))
    return asked, F.concat(e(act), F.lit(" Section "), e(number), F.lit(" "), e(title), F.lit(". "), text)


def rerank(rows: DataFrame, cfg: FusionConfig = FusionConfig(), scorer: Callable[[Column, Column], Column] = lexical_overlap) -> DataFrame:
    """Adds rerank_score and final_score; rows without text get neither and come last."""
    c = F.col
    pair = pair_texts(c("query"), c("intents"), c("act_name"), c("section_number"), c("section_title"), c("text"))
    rows = rows.withColumn("rerank_score", F.when(F.coalesce(c("text"), F.lit("")) != "", scorer(*pair)))
    return blend(rows, cfg)


def blend(rows: DataFrame, cfg: FusionConfig = FusionConfig()) -> DataFrame:
    r = F.col("rerank_score")
    if cfg.min_max_rerank:
        span = rows.groupBy("query_id").agg(F.min(r).alias("_low"), F.max(r).alias("_high"))
        rows = rows.join(broadcast_if_small(span), "query_id")
        r = (r - F.col("_low")) / (F.col("_high") - F.col("_low") + 1e-8)
        return rows.withColumn("final_score", F.lit(cfg.rerank) * r + F.lit(cfg.retrieval) * F.col("score")).drop("_low", "_high")
    return rows.withColumn("final_score", F.lit(cfg.rerank) * r + F.lit(cfg.retrieval) * F.col("score"))


def finish(rows: DataFrame, k: int, *ties: str, cfg: FusionConfig = FusionConfig()) -> DataFrame:
    """Cut to k, then one row a citation, so fewer than k may be left; the other way round if the config says so."""
    order = [F.desc_nulls_last("final_score"), *ties]
    one = Window.partitionBy("query_id", "act_name", "section_number").orderBy(*order)
    if cfg.dedupe_before_limit:
        rows = rows.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    rows = best(rows, k, "final_score", *ties, out="rank")
    rows = rows.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n", "rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def kept(rows: DataFrame, min_score: float | None = None, asked: str | None = None, by: str = "score") -> DataFrame:
    """Rows of at least that score and, where the column `asked` names a category, of that category."""
    if min_score is not None:
        rows = rows.where(F.col(by) >= min_score)
    return rows.where(F.col(asked).isNull() | (F.col("category") == F.col(asked))) if asked else rows


def of_acts(rows: DataFrame, acts: list[str] | DataFrame, by: str = "score") -> DataFrame:
    """For diagnosis: the candidates from some acts (names, or a table with act_name)."""
    rows = rows.where(F.col("act_name").isin(*acts)) if isinstance(acts, list) else rows.join(broadcast_if_small(acts.select("act_name").distinct()), "act_name", "left_semi")
    return rows
