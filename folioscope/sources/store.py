"""The store: chunks, vectors and the embedding cache as append-only Parquet tables, with a manifest of ingested files.

Every ingestion writes one version: its new rows only, under `version=N` of each table, and at last a marker that
commits it. Readers take the committed versions; of each file (category and source) the rows of its latest version are
the live ones, so a changed file replaces its old rows without their being read or written again. What a crash leaves
behind has no marker; the next ingestion takes the same number and overwrites it. `compact` rewrites the live rows as
one version. Ingestions into one store come one after another, as the batches of a stream do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.embed import Embedder, hashing
from ..functions.text import is_low_value, search_text
from ..operators.chunks import chunk_sections
from ..operators.ingestion import new_rows, summary
from ..session import broadcast_if_small, staged

TABLES = {
    "chunks": schemas.CHUNK + ", file_key string",
    "vectors": "id string, embedding array<float>, category string, chunk_id string, source string",
    "cache": "text_hash string, embedding array<float>",
    "manifest": schemas.MANIFEST,
    "sources": "category string, source string",
}
FILE = ["category", "source"]


@dataclass
class Store:
    spark: SparkSession
    folder: str

    def _path(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The committed ones."""
        p, fs = self._path("commits")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p)) if fs.exists(p) else []

    def table(self, name: str) -> DataFrame:
        """All committed rows of a table, with their version."""
        schema = TABLES[name] + ", version int"
        found = [f"{self.folder}/{name}/version={v}" for v in self.versions()]
        found = [x for x in found if self._path(x[len(self.folder) + 1 :])[1].exists(self._path(x[len(self.folder) + 1 :])[0])]
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*found)

    def live(self, name: str) -> DataFrame:
        """The rows of each file's latest version."""
        latest = self.table("sources").groupBy(*FILE).agg(F.max("version").alias("version"))
        rows, latest = self.table(name).alias("r"), broadcast_if_small(latest).alias("l")
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}")) for c in (*FILE, "version")]
        return rows.join(latest, same, "left_semi").drop("version")

    @property
    def chunks(self) -> DataFrame:
        return self.live("chunks")

    @property
    def vectors(self) -> DataFrame:
        return self.live("vectors")

    @property
    def cache(self) -> DataFrame:
        return self.table("cache").drop("version")

    @property
    def manifest(self) -> DataFrame:
        return self.table("manifest").drop("version")

    def reset(self) -> None:
        p, fs = self._path("")
        fs.delete(p, True)

    def rows_by_source(self) -> DataFrame:
        return self.chunks.groupBy("source").agg(F.count("*").alias("n"))

    def ingest(self, sections: DataFrame, embed: Embedder | None = None, reset: bool = False) -> DataFrame:
        """sections with source and file_key -> new, skipped, total. Rows of a source that changed replace its old ones.

        Running it again with the same files changes nothing: files are known by content, chunks by theirs.
        """
        if reset:
            self.reset()
        embed = embed or hashing()
        known = self.manifest
        fresh = new_rows(sections, known, "file_key")
        chunks = chunk_sections(fresh.where(~is_low_value(F.col("section_title"))), keep=("file_key",))
        once = F.row_number().over(Window.partitionBy("category", "chunk_id").orderBy("source", "citation"))
        chunks = staged(chunks.withColumn("_n", once).where("_n = 1").drop("_n"), "new-chunks")
        text = search_text(*(F.col(c) for c in ("act_name", "section_number", "section_title", "chapter", "text")))
        keyed = chunks.withColumn("search_text", text).withColumn("text_hash", F.sha2("search_text", 256))
        missing = new_rows(keyed.select("text_hash", "search_text").dropDuplicates(["text_hash"]), self.cache, "text_hash")
        added = staged(missing.select("text_hash", embed(F.col("search_text")).alias("embedding")), "new-cache")
        old = self.cache.join(broadcast_if_small(keyed.select("text_hash").distinct()), "text_hash", "left_semi")
        vectors = keyed.join(old.unionByName(added), "text_hash").select(F.concat_ws("::", "category", "chunk_id").alias("id"), "embedding", "category", "chunk_id", "source")
        files = fresh.select("file_key").distinct()
        counts = staged(summary(files, sections.join(known, "file_key", "left_semi").select("file_key").distinct(), sections.select("file_key").distinct()), "counts")
        if counts.first().new:
            # As chunks have them, so that a file whose rows are all of low value still replaces what it had.
            named = fresh.select(F.coalesce("category", F.lit("general")).alias("category"), F.coalesce("source", F.lit("")).alias("source")).distinct()
            self._commit({"chunks": chunks, "vectors": vectors, "cache": added, "manifest": files, "sources": named})
        return counts

    def _commit(self, tables: dict[str, DataFrame]) -> None:
        version = max(self.versions(), default=0) + 1
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/version={version}")
        p, fs = self._path(f"commits/{version}")
        fs.create(p, False).close()

    def compact(self) -> None:
        """Rewrites what is live as one version and drops the older ones."""
        before = self.versions()
        sources = self.table("sources").select(*FILE).distinct()
        cache = self.cache.dropDuplicates(["text_hash"])
        self._commit({"chunks": self.chunks, "vectors": self.vectors, "cache": cache, "manifest": self.manifest.distinct(), "sources": sources})
        for v in before:
            p, fs = self._path(f"commits/{v}")
            fs.delete(p, False)
            for name in TABLES:
                p, fs = self._path(f"{name}/version={v}")
                fs.delete(p, True)
