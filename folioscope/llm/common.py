"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, dropped_at_exit, shared_folder, staged

__all__ = ["broadcast_if_small", "gathered", "kept_by", "once", "staged", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gathered(rows: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a task whose number its plan bounds; None if there are none."""
    t = [b for b in rows if b.num_rows]
    return pa.Table.from_batches(t) if t else None


def once(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """One row per key: rows delivered again count once. Rows without a key are left out.

    Rows of one key whose contents differ (which the tables do not have) give the least value of each
    column, so the result does not depend on the order of arrival.
    """
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.min(c).alias(c) for c in cols))


def kept_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """df as a table in the shared folder, in buckets by the key: sums and joins by it find its rows together."""
    spark = df.sparkSession
    table, n = f"{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/{table}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(table)
    dropped_at_exit(spark, path)
    return spark.table(table)
