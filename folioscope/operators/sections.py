"""Text of whole acts to sections.

A document's matches are marked in one pass of a regular expression, and the text split at the marks: the same spans
as a scan for matches gives, without a Python loop. What depends on the order of a document's sections (chapters,
footnotes folded into the section before, duplicates) are windows over the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ParseConfig
from ..functions.text import clean, rstrip, strip, title_case

#: The forms of section heads, chapter heads and footnotes.
SECTION = r"(?dmU)^(?:Section\s+)?(\d+[A-Z]?)\.\s+(.+?)\.[—–―-]"
CHAPTER = r"(?dmU)^CHAPTER\s+([IVXLCDM]+|[0-9]+)\s*\n(.+)$"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE_TITLE = rf"(?i)^\d{{1,2}}(st|nd|rd|th)?\s+({MONTHS})[,]?\s+\d{{4}}$"
MARKERS = r"(?i)vide notification|gazette of india|S\.O\.\s*\d|w\.e\.f\.|shall come into force|extraordinary,?\s*part"
MARKERS_LAX = r"(?i)vide notification|gazette of india|S\.O\.\s*\d|w\.e\.f\.|extraordinary,?\s*part"
DATED_LINE = r"(?i)^\d{1,2}\.\s+\d{1,2}(st|nd|rd|th)?\s+\w+,?\s*\d{4}"
FOOTNOTE_BLOCK = (
    r"(?is)^\d{1,2}\.\s+\d{1,2}(st|nd|rd|th)?\s+\w+,?\s*\d{4}\.?\s*[-–—.]{1,2}"
    r".*?(?:Extraordinary,?\s*Part\s*[IVX]+,?\s*sec\.\s*\d+\([a-z]+\)\.|see Gazette of India[^.]*\.|vide notification[^.]*\.)"
)
MARK, OPEN, CLOSE = "\u0001", "\u0002", "\u0003"


def spans(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """doc, pos (from 1), section_number, section_title, span, chapter_in: the last chapter head in the span before the next one."""
    with_chapters = F.regexp_replace(F.col(text), CHAPTER, f"{OPEN}$2{CLOSE}$0")
    parts = F.split(F.regexp_replace(with_chapters, SECTION, f"{MARK}$0"), MARK)
    rows = docs.select(doc, F.posexplode(parts).alias("pos", "part"))
    chapters = F.regexp_extract_all("part", F.lit(f"{OPEN}([^{CLOSE}]*){CLOSE}"), 1)
    bare = F.regexp_replace("part", f"{OPEN}[^{CLOSE}]*{CLOSE}", "")
    return rows.select(doc, "pos", bare.alias("part"), strip(F.try_element_at(chapters, F.lit(-1))).alias("chapter_in")).select(
        doc, "pos", strip(F.regexp_extract("part", SECTION, 1)).alias("section_number"), strip(F.regexp_extract("part", SECTION, 2)).alias("section_title"), strip(F.col("part")).alias("span"), "chapter_in"
    )


def with_chapters(rows: DataFrame, doc: str = "doc", default: str = "General") -> DataFrame:
    """Sections only (pos >= 1), each with the nearest chapter before it."""
    before = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("chapter", F.coalesce(F.last("chapter_in", ignorenulls=True).over(before), F.lit(default))).where("pos >= 1").drop("chapter_in")


def is_footnote(title: Column, text: Column, cfg: ParseConfig = ParseConfig()) -> Column:
    markers = MARKERS if cfg.strict_footnotes else MARKERS_LAX
    return title.rlike(DATE_TITLE) | F.substring(text, 1, cfg.footnote_window).rlike(markers)


def footnote_remainder(text: Column) -> Column:
    """A footnote's span without its boilerplate: what of the act goes on after it."""
    rest = F.regexp_replace(text, FOOTNOTE_BLOCK, "")
    still = rest.rlike(MARKERS) | strip(rest).rlike(DATED_LINE)
    lines = F.filter(F.split(rest, "\n"), lambda x: ~(x.rlike(MARKERS) | strip(x).rlike(DATED_LINE)))
    return strip(F.when(still, F.array_join(lines, "\n")).otherwise(rest))


def fold_footnotes(rows: DataFrame, doc: str = "doc", cfg: ParseConfig = ParseConfig()) -> DataFrame:
    """Short spans dropped; a footnote's remainder goes to the end of the section kept before it."""
    rows = rows.where(F.length("span") >= cfg.min_section_chars).withColumn("footnote", is_footnote(F.col("section_title"), F.col("span"), cfg))
    order = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("island", F.sum((~F.col("footnote")).cast("int")).over(order))
    rest = F.when(F.col("footnote"), footnote_remainder(F.col("span")))
    more = F.transform(F.array_sort(F.collect_list(F.when(rest != "", F.struct(F.col("pos"), rest.alias("rest"))))), lambda x: x["rest"])
    head = {c: F.max(F.when(~F.col("footnote"), F.col(c))).alias(c) for c in ("pos", "section_number", "section_title", "chapter", "span")}
    kept = rows.where("island > 0").groupBy(doc, "island").agg(*head.values(), more.alias("more"))
    # Each remainder follows a text without white space at its end; a remainder has none itself.
    text = F.when(F.size("more") > 0, F.concat(rstrip(F.col("span")), F.lit("\n"), F.array_join("more", "\n"))).otherwise(F.col("span"))
    return kept.select(doc, "pos", "section_number", "section_title", "chapter", text.alias("text"))


def dedupe_numbers(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """One section a number: one with a real title before one with a date, then the longest, then the first; at the first one's place."""
    by = Window.partitionBy(doc, "section_number")
    dated = F.col("section_title").rlike(DATE_TITLE)
    best = by.orderBy(dated.cast("int"), F.when(~dated, F.length("text")).desc_nulls_last(), "pos")
    rows = rows.withColumn("place", F.min("pos").over(by)).withColumn("rank", F.row_number().over(best))
    return rows.where("rank = 1").drop("rank", "pos").withColumnRenamed("place", "pos")


def paragraphs(docs: DataFrame, doc: str = "doc", text: str = "text", cfg: ParseConfig = ParseConfig()) -> DataFrame:
    """For documents without section heads: paragraphs that are long enough, numbered P1, P2 and so on."""
    kept = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: F.length(p) > cfg.min_paragraph_chars)
    rows = docs.where(~F.coalesce(F.col(text), F.lit("")).rlike(SECTION)).select(doc, F.posexplode(kept).alias("i", "text"))
    number = F.concat(F.lit("P"), (F.col("i") + 1).cast("string"))
    return rows.select(doc, (F.col("i") + 1).alias("pos"), number.alias("section_number"), F.concat(F.lit("Paragraph "), (F.col("i") + 1).cast("string")).alias("section_title"), F.lit(cfg.fallback_chapter).alias("chapter"), "text")


def act_metadata(stem: Column) -> dict[str, Column]:
    """What the name of a file tells of its act."""
    return {
        "act_name": title_case(F.replace(stem, F.lit("_"), F.lit(" "))),
        "short_name": F.substring(stem, 1, 12),
        "year": F.lit(0),
        "ministry": F.lit("Unknown"),
    }


def parse_acts(raw: DataFrame, cfg: ParseConfig = ParseConfig(), noise: list[str] | None = None) -> DataFrame:
    """raw: path (the file's stem), category, text -> sections. Documents with null or empty text give none."""
    docs = raw.where(F.col("text").isNotNull()).select("path", "category", (clean(F.col("text"), noise) if noise else clean(F.col("text"))).alias("text"))
    found = dedupe_numbers(fold_footnotes(with_chapters(spans(docs, "path"), "path", cfg.default_chapter), "path", cfg), "path")
    rows = found.unionByName(paragraphs(docs, "path", cfg=cfg).select(found.columns))
    meta = {k: v.alias(k) for k, v in act_metadata(F.col("path")).items()}
    rows = rows.join(raw.select("path", "category"), "path").select("*", *meta.values())
    citation = F.concat(F.col("act_name"), F.lit(" › Section "), F.col("section_number"), F.lit(" › "), F.col("section_title"))
    return rows.select("path", "category", "act_name", "short_name", "year", "ministry", "chapter", "section_number", "section_title", "text", citation.alias("citation"), F.length("text").alias("char_count"), "pos")


def parse_failures(raw: DataFrame, sections: DataFrame) -> DataFrame:
    """path, reason: the documents that gave no section, for an error of the extraction (a column `error`, if there is one) or for what they hold."""
    error = F.col("error") if "error" in raw.columns else F.lit(None).cast("string")
    empty = F.when(F.col("text").isNull(), "no text").otherwise("no sections")
    return raw.select("path", F.coalesce(error, empty).alias("reason")).join(sections.select("path").distinct(), "path", "left_anti")
