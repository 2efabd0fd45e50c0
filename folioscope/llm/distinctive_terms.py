"""How distinctive a term is per record: the log-likelihood ratio of its counts in the record and outside.

With tf the term's count in the record, cf in the collection, m the record's terms and N all terms, the table is
(tf, cf - tf; m - tf, N - cf - m + tf), and the score 2 * sum k ln(k * N / (row sum * column sum)), negative where
the record uses the term less than the rest does.

Nulls and empty texts have no terms. A record delivered again counts once. All counts are over all records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, once, staged


def log_likelihood(tf: Column, cf: Column, m: Column, n: Column) -> Column:
    rows = ((tf, cf, m), (cf - tf, cf, n - m), (m - tf, n - cf, m), (n - cf - m + tf, n - cf, n - m))
    g = sum((F.when(k > 0, k * F.ln(k * n / (a * b))).otherwise(0.0) for k, a, b in rows), F.lit(0.0)) * 2
    return F.when(tf * n >= cf * m, g).otherwise(-g)


def distinctive_terms(df: DataFrame, key: str, text: str, pattern: str = r"[a-z]{5,}", min_tf: int = 1, min_df: int = 1, max_df: int | None = None) -> DataFrame:
    """key, term, tf, df, cf, score of the terms a record uses at least min_tf times and min_df to max_df records use."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    terms = once(rows, "key", "text").select("key", F.regexp_extract_all(F.lower("text"), F.lit(pattern), 0).alias("terms"))
    # A record's terms meet where the record is, so that this count needs no shuffle of its own.
    counted = terms.select("key", F.size("terms").alias("m"), F.explode("terms").alias("term")).groupBy("key", "m", "term").agg(F.count("*").alias("tf"))
    counted = staged(counted, "terms")
    stats = counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    stats = staged(stats, "stats")
    total = stats.agg(F.sum("cf")).first()[0] or 0
    stats = stats.where(F.col("df").between(min_df, max_df if max_df is not None else 1 << 62))
    used = counted.where(F.col("tf") >= min_tf).join(broadcast_if_small(stats, 100_000), "term")
    d = [F.col(c).cast("double") for c in ("tf", "cf", "m")]
    return used.select(F.col("key").alias(key), "term", "tf", "df", "cf", log_likelihood(*d, F.lit(float(total))).alias("score"))
