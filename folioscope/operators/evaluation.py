"""Rank metrics and structural checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small


def outcomes(results: DataFrame, gold: DataFrame, cases: DataFrame) -> DataFrame:
    """query_id, primary_rank, secondary_rank, strict_rank, relaxed_rank of every case; null for a miss.

    results: query_id, rank, act_name, section_number. gold: query_id, kind ("primary" or "secondary"), act,
    section: an act matches where the gold act occurs in its name, in any case; an empty section matches any.
    The relaxed rank is the primary one if there is one, else the secondary, not the lesser of both.
    """
    hit = F.contains(F.lower(F.coalesce("r.act_name", F.lit(""))), F.lower("g.act")) & ((F.col("g.section") == "") | (F.col("g.section") == F.col("r.section_number")))
    matched = results.alias("r").join(gold.alias("g"), (F.col("r.query_id") == F.col("g.query_id")) & hit)
    ranks = matched.groupBy(F.col("r.query_id").alias("query_id")).agg(*(F.min(F.when(F.col("g.kind") == k, F.col("r.rank"))).alias(f"{k}_rank") for k in ("primary", "secondary")))
    rows = cases.select("query_id").distinct().join(ranks, "query_id", "left")
    return rows.select("query_id", "primary_rank", "secondary_rank", F.col("primary_rank").alias("strict_rank"), F.coalesce("primary_rank", "secondary_rank").alias("relaxed_rank"))


def metrics(rows: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """kind, cases, hits and percentages at each k, mrr: a miss counts 0, all cases in the denominator."""
    kinds = F.explode(F.array(F.struct(F.lit("strict").alias("kind"), F.col("strict_rank").alias("rank")), F.struct(F.lit("relaxed").alias("kind"), F.col("relaxed_rank").alias("rank"))))
    rows = rows.select(kinds.alias("x")).select("x.kind", "x.rank")
    hits = [F.count_if(F.col("rank") <= k).alias(f"hit_{k}") for k in ks]
    rows = rows.groupBy("kind").agg(F.count("*").alias("cases"), *hits, (F.sum(F.coalesce(1 / F.col("rank"), F.lit(0.0))) / F.count("*")).alias("mrr"))
    return rows.select("kind", "cases", *(f"hit_{k}" for k in ks), *(F.round(100.0 * F.col(f"hit_{k}") / F.col("cases"), 4).alias(f"hit_{k}_percent") for k in ks), F.round("mrr", 4).alias("mrr"))


def duplicate_citations(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id", "act_name", "section_number").agg(F.count("*").alias("n")).where("n > 1")


def passed(rows: DataFrame) -> DataFrame:
    """cases, misses, passed: whether every case is met strictly. No cases pass."""
    misses = F.count_if(F.col("strict_rank").isNull())
    return rows.agg(F.count("*").alias("cases"), misses.alias("misses"), (misses == 0).alias("passed"))


def leaked_results(results: DataFrame, cases: DataFrame) -> DataFrame:
    """The results (with all their columns) of another category than the one asked for, where one was asked for."""
    asked = cases.where(F.coalesce("category_filter", F.lit("")) != "").select("query_id", "category_filter")
    return results.join(broadcast_if_small(asked), "query_id").where((F.coalesce("category", F.lit("")) != "") & (F.col("category") != F.col("category_filter")))


def category_leaks(results: DataFrame, cases: DataFrame) -> DataFrame:
    """query_id, leaks: how many results leaked."""
    return leaked_results(results, cases).groupBy("query_id").agg(F.count("*").alias("leaks"))


def wrong_but_sure(results: DataFrame, rows: DataFrame, score: float) -> DataFrame:
    """Cases whose first result scores at least `score` although none of their results is right."""
    first = results.where("rank = 1").select("query_id", "final_score")
    return rows.where("strict_rank is null").join(first, "query_id").where(F.col("final_score") >= score).select("query_id", "final_score")
