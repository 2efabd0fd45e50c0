"""Incremental ingestion, as joins against what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def file_key(category: Column, name: Column, content: Column) -> Column:
    return F.concat(category, F.lit("/"), name, F.lit(":"), F.md5(content))


def new_rows(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    return rows.join(manifest.select(key).distinct(), key, "left_anti")


def skipped_rows(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    return rows.join(manifest.select(key).distinct(), key, "left_semi")


def embed_missing(rows: DataFrame, cache: DataFrame, key: str, text: str, embed: Callable[[Column], Column]) -> DataFrame:
    """The cache with the vectors of the keys it lacked. The key should come from the text that is embedded."""
    missing = new_rows(rows.select(key, text).dropDuplicates([key]), cache, key)
    return cache.select(key, "embedding").unionByName(missing.select(key, embed(F.col(text)).alias("embedding")))


def attach(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows without a vector are left out."""
    return rows.join(cache.select(key, "embedding"), key)


def replace_source(old: DataFrame, new: DataFrame, source: str = "source") -> DataFrame:
    """What is there, with all rows of the new rows' sources replaced."""
    return old.join(new.select(source).distinct(), source, "left_anti").unionByName(new.select(old.columns))


def assign_ids(rows: DataFrame, order: list[str], start: int = 0, out: str = "doc_id", parts: int = 64) -> DataFrame:
    """Running numbers in the given order, without bringing all rows to one task.

    Rows are dealt to ranges of the order; a range's first number is the count of the rows before it, from a table
    of one row a range. Equal rows get different numbers.
    """
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("_m", F.monotonically_increasing_id()).withColumns({"_p": F.shiftrightunsigned("_m", 33), "_i": F.col("_m").bitwiseAND((1 << 33) - 1)})
    numbered = staged(numbered, "numbered")  # both uses must see the same ranges
    counts = numbered.groupBy("_p").agg(F.count("*").alias("_n"))
    first = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_first"))
    return numbered.join(F.broadcast(first), "_p").withColumn(out, F.col("_first") + F.col("_i") + start).drop("_m", "_p", "_i", "_first")


def summary(new: DataFrame, skipped: DataFrame, total: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(new, "new").crossJoin(count(skipped, "skipped")).crossJoin(count(total, "total"))
