"""Sections to chunks: sentences, packed in order up to a size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions.text import sentences


def merge(parts: Column, max_chars: int) -> Column:
    """Sentences joined by a blank while the result fits; one that fits nowhere stands alone."""
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        cur, out = a["cur"], a["out"]
        flushed = F.when(cur == "", out).otherwise(F.concat(out, F.array(cur)))
        return (
            F.when(F.length(s) > max_chars, F.struct(F.lit("").alias("cur"), F.concat(flushed, F.array(s)).alias("out")))
            .when(F.length(cur) + F.length(s) + 1 <= max_chars, F.struct(F.when(cur == "", s).otherwise(F.concat(cur, F.lit(" "), s)).alias("cur"), out.alias("out")))
            .otherwise(F.struct(s.alias("cur"), flushed.alias("out")))
        )

    return F.aggregate(parts, start, step, lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))


def pieces(text: Column, cfg: ChunkConfig = ChunkConfig()) -> Column:
    """The text itself if it is short enough, else its merged sentences that are not too short."""
    split = F.filter(merge(sentences(text), cfg.max_chars), lambda c: F.length(c) >= cfg.min_chars)
    return F.when(F.length(text) <= cfg.max_chars, F.array(text)).otherwise(split)


def legacy_pieces(text: Column, cfg: ChunkConfig = ChunkConfig()) -> Column:
    return F.filter(merge(sentences(text), cfg.legacy_chars), lambda c: F.length(c) >= cfg.min_chars)


def chunk_id(act: Column, number: Column, index: Column, text: Column) -> Column:
    e = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("|", e(act), e(number), e(index), e(text)), 256)


def chunk_sections(sections: DataFrame, cfg: ChunkConfig = ChunkConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Sections (act_name, section_number, section_title, chapter, short_name, year, category, source, text, citation) to chunks.

    Null text gives no chunk.
    """
    rows = sections.where(F.col("text").isNotNull()).withColumn("_parts", pieces(F.col("text"), cfg))
    rows = rows.select("*", F.size("_parts").alias("total_chunks"), F.posexplode("_parts").alias("chunk_index", "_chunk")).drop("_parts")
    c = F.col
    part = F.when(c("total_chunks") > 1, F.concat(c("citation"), F.lit(" (part "), (c("chunk_index") + 1).cast("string"), F.lit("/"), c("total_chunks").cast("string"), F.lit(")"))).otherwise(c("citation"))
    head = F.concat(F.lit("Section "), c("section_number"), F.lit(" "), c("section_title"), F.lit("\n\n"), c("_chunk"))
    return rows.select(
        *keep, head.alias("text"), part.alias("citation"), "section_number", "section_title", F.coalesce("chapter", F.lit("")).alias("chapter"), "act_name", F.coalesce("short_name", F.lit("")).alias("short_name"), "year",
        F.coalesce("category", F.lit("general")).alias("category"), F.coalesce("source", F.lit("")).alias("source"), "chunk_index", chunk_id(c("act_name"), c("section_number"), c("chunk_index"), c("_chunk")).alias("chunk_id"), "total_chunks",
    )
