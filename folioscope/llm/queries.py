"""The pN_ queries: each problem's operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_duplicates as nd
from . import distinctive_terms as dt
from . import encoding, oracles, packing, rank_fusion, scan_noise, site_lines, splitting, subjects
from . import similar_vectors as sv
from .common import staged, table


SCORES = ["semantic_score", "bm25_score", "rerank_score"]


def p1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rank_fusion.aggregate_ranks(table(spark, sf_dir, "retrieval_results"), "query_id", "chunk_key", SCORES)
    return rows.withColumn("significance", F.round("significance", 9))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_ranking(spark, sf_dir).where("position = 1").select("query_id", "chunk_key")


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = sv.similar_vectors(table(spark, sf_dir, "chunk_vectors"), "vec_id", "embedding", k=5, dim=64)
    return near.select(F.col("id_a").alias("vec_id"), F.col("id_b").alias("near_vec_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = sv.similar_vectors(table(spark, sf_dir, "chunk_vectors"), "vec_id", "embedding", k=5, dim=64).where("cosine >= 0.9")
    return near.select(F.least("id_a", "id_b").alias("vec_id_a"), F.greatest("id_a", "id_b").alias("vec_id_b")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, sf_dir, "chunks"), "chunk_key", "source", "text", least=10, share=0.1).select("chunk_key", F.col("line_no").cast("int").alias("line_no"))


def p3_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = site_lines.without_repeated(table(spark, sf_dir, "chunks").select("chunk_key", "source", "text"), "chunk_key", "source", "text", least=10, share=0.1)
    return rows.select("chunk_key", "text", F.array_join("removed_lines", ",").alias("removed_lines"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunks"), "chunk_key", "text", limit=1200, overlap=150)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pieces(spark, sf_dir).where("chunk_index = 0 and total_chunks > 1").select("chunk_key")


def p4_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces put together without what they repeat; whether each fits, repeats the end of the one before, and has its place."""
    rows = p4_pieces(spark, sf_dir).groupBy("chunk_key").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "total_chunks", "overlap", "text"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: F.substr(x["text"], x["overlap"] + 1)), "")
    before = lambda i: F.element_at("p", F.greatest(i, F.lit(1)))["text"]
    repeats = F.transform("p", lambda x, i: (i == 0) & (x["overlap"] == 0) | (i > 0) & (x["overlap"] <= 150) & F.endswith(before(i), F.left(x["text"], x["overlap"])))
    places = F.transform("p", lambda x, i: (x["chunk_index"] == i) & (x["total_chunks"] == F.size("p")))
    return rows.select(
        "chunk_key", F.md5(whole).alias("md5"), F.forall("p", lambda x: F.length(x["text"]) <= 1200).alias("fits"), F.forall(repeats, lambda x: x).alias("repeats"), F.forall(places, lambda x: x).alias("in_order")
    )


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.repair(table(spark, sf_dir, "parsed_sections"), "section_key", "text", "act_name", "chapter", "section_title")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_repaired(spark, sf_dir).select("section_key", F.explode("noise").alias("x")).select("section_key", "x.line_no", "x.kind")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, members = nd.near_duplicates(table(spark, sf_dir, "chunks"), "chunk_key", "text", width=3, similarity=0.6, least=60)
    return nd.groups(pairs, members).toDF("chunk_key", "class_id", "links", "group_id")


def record_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of records, as this query's rows are, from pairs of classes and membership. Where nearly all classes have one member this adds little."""
    more = members.where("id <> class_id")
    own = more.select(F.col("class_id").alias("id_a"), F.col("id").alias("id_b"))
    peers = more.alias("p").join(more.alias("q"), (F.col("p.class_id") == F.col("q.class_id")) & (F.col("p.id") < F.col("q.id"))).select(F.col("p.id").alias("id_a"), F.col("q.id").alias("id_b"))
    a = pairs.select("id_a", "id_b").join(more.withColumnRenamed("class_id", "id_a").withColumnRenamed("id", "m"), "id_a", "left").select(F.explode(F.array_compact(F.array("id_a", "m"))).alias("id_a"), "id_b").distinct()
    b = a.join(more.withColumnRenamed("class_id", "id_b").withColumnRenamed("id", "m"), "id_b", "left").select("id_a", F.explode(F.array_compact(F.array("id_b", "m"))).alias("id_b")).distinct()
    return b.unionByName(own).unionByName(peers).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, members = nd.near_duplicates(table(spark, sf_dir, "chunks"), "chunk_key", "text", width=3, similarity=0.6, least=60)
    return record_pairs(pairs, members).toDF("chunk_key_a", "chunk_key_b")


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dt.distinctive_terms(table(spark, sf_dir, "chunks"), "chunk_key", "text", r"[a-z]{5,}")
    return rows.withColumn("score", F.round("score", 6) + F.lit(0.0))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Staged, as Spark would else drop the unread score, and with it the work, from the plan.
    return staged(p7_scores(spark, sf_dir), "scores").where("tf >= 3 and df between 2 and 12").select("chunk_key", "term")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the ids give back."""
    return encoding.decode(p8_ids(spark, sf_dir), "doc_id", "ids").select("doc_id", F.md5("text").alias("md5"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", capacity=2048)


def p9_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all of a document's tokens lie in containers, none of which holds more than its capacity."""
    rows = staged(p9_containers(spark, sf_dir), "containers")
    used = staged(rows.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("used")), "used")
    pieces = rows.join(used, "container", "left").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max("piece").alias("last"), F.sum("tokens").alias("tokens"), F.max(F.coalesce("used", F.lit(0))).alias("used"), F.bool_and(F.col("container").isNotNull() == (F.col("tokens") > 0)).alias("placed")
    )
    ids = p8_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("size"))
    fits = (F.col("used") <= 2048) & F.col("placed")
    whole = (F.col("tokens") == F.col("size")) & (F.col("n") == F.col("last") + 1) & (F.col("n") == F.greatest(F.ceil(F.col("size") / 2048), F.lit(1)))
    return ids.join(pieces, "doc_id", "left").select("doc_id", F.coalesce(fits, F.lit(False)).alias("fits"), F.coalesce(whole, F.lit(False)).alias("whole"))


def p10_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_subject_labels"), table(spark, sf_dir, "subject_areas"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_subjects(spark, sf_dir).select("doc_id", "subject")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
