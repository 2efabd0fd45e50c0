"""Ingestion as a stream: files that arrive in a folder are ingested once each.

The file source's checkpoint remembers the files of finished batches; a batch that is run again after a failure
finds its files in the store's manifest, so it changes nothing. Nothing is windowed, so there is no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.embed import Embedder
from ..sources.store import Store


def ingest_stream(spark: SparkSession, folder: str, store: Store, checkpoint: str, embed: Embedder | None = None, files_per_batch: int = 1000) -> StreamingQuery:
    """Parquet files of sections with a source column; starts a query that takes what is there and ends."""
    rows = spark.readStream.schema(schemas.SECTION + ", source string").option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def batch(df: DataFrame, _: int) -> None:
        # A file's key is its category, source and content, whatever the order of its rows.
        content = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("section_number", "section_title", "text")))
        name = F.concat(F.coalesce("category", F.lit("")), F.lit("/"), F.coalesce("source", F.lit("")), F.lit(":"))
        keyed = df.withColumns({"_h": content, "_n": name})
        digest = F.concat(F.hex(F.bit_xor("_h")), F.lit("-"), F.hex(F.bit_xor(F.xxhash64("_h", F.lit(1)))), F.lit("-"), F.count("*").cast("string"))
        keys = keyed.groupBy("_n").agg(digest.alias("_k"))
        store.ingest(keyed.join(keys, "_n").withColumn("file_key", F.concat("_n", "_k")).drop("_h", "_n", "_k"), embed)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
