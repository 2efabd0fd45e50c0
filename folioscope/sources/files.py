"""Files in and out: page documents, parsed sections, dimension tables, fetch attempts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import broadcast_if_small


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def scan_documents(spark: SparkSession, folder: str, extract: Callable[[bytes], list[str]], pattern: str = "*.pdf") -> DataFrame:
    """Files under a folder, at any depth: path (stem), category (its folder), source (name), file_key, text, error.

    extract gives a file's pages as texts; empty pages are dropped, the others joined by newlines. A file that it
    fails on comes with its error and a null text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    files = files.select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for content in b["content"]:
                try:
                    texts.append("\n".join(p for p in extract(bytes(content)) if p and p.strip()))
                    errors.append(None)
                except Exception as e:
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": b["path"], "md5": b["md5"], "text": texts, "error": errors})

    rows = files.withColumn("md5", F.md5("content")).mapInPandas(run, "path string, md5 string, text string, error string")
    p = F.col("path")
    name = F.regexp_extract(p, r"([^/]+)$", 1)
    return rows.select(stem(p).alias("path"), parent(p).alias("category"), name.alias("source"), F.concat(parent(p), F.lit("/"), name, F.lit(":"), F.col("md5")).alias("file_key"), "text", "error")


def text_pages(content: bytes) -> list[str]:
    """The default extractor: UTF-8 text whose pages are parted by form feeds."""
    return content.decode("utf-8").split("\f")


def pdf_pages(content: bytes) -> list[str]:
    """The texts of a PDF's pages, with the library pypdf, where it is installed."""
    from io import BytesIO

    from pypdf import PdfReader

    return [page.extract_text() or "" for page in PdfReader(BytesIO(content)).pages]


def write_sections(sections: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """JSON lines, one folder a category."""
    sections.write.mode(mode).partitionBy("category").json(folder)


def read_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed sections, with source, path (stem) and category from where they lie.

    Files named part-* are JSON lines, as write_sections gives them; any other file is one array.
    """

    def rows(lines: bool) -> DataFrame:
        reader = spark.read.schema(schemas.SECTION).option("multiLine", not lines).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
        ours = F.col("_metadata.file_name").startswith("part-")
        return reader.json(folder).where(ours if lines else ~ours).withColumn("_file", F.col("_metadata.file_path"))

    f = F.col("_file")
    category = F.regexp_replace(parent(f), "^category=", "")
    both = rows(True).unionByName(rows(False))
    return both.withColumns({"source": F.regexp_extract(f, r"([^/]+)$", 1), "path": stem(f), "category": category}).drop("_file")


def read_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of intents, prototypes, topics or cases, as one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def with_defaults(rows: DataFrame, metadata: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Columns from a lookup table by key, with computed values where it has none."""
    found = rows.join(broadcast_if_small(metadata.select(key, *(F.col(c).alias(f"_{c}") for c in defaults))), key, "left")
    return found.withColumns({c: F.coalesce(f"_{c}", d) for c, d in defaults.items()}).drop(*(f"_{c}" for c in defaults))


def fetch(acts: DataFrame, key: str, get: Callable[[str], tuple[int, str, bytes]]) -> DataFrame:
    """key, url, content, error: the document of each row's `urls`, tried in order until one gives it.

    get gives status, content type and content of a url, or raises. Where none succeeds, url and content are null and
    error says what became of each. The fetching runs on the executors, a row after another; nothing is fetched twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, urls in zip(b["k"], b["urls"]):
                failed, got = [], (None, None)
                for url in urls if urls is not None else ():
                    try:
                        status, kind, content = get(url)
                        if status == 200 and ("pdf" in (kind or "").lower() or "octet-stream" in (kind or "").lower()):
                            got = (url, content)
                            break
                        failed.append(f"{url}: {status} {kind}")
                    except Exception as e:
                        failed.append(f"{url}: {type(e).__name__}: {e}")
                out.append((k, *got, None if got[0] else "; ".join(failed) or "no urls"))
            yield pd.DataFrame(out, columns=["k", "url", "content", "error"])

    kind = acts.schema[key].dataType.simpleString()
    return acts.select(F.col(key).alias("k"), "urls").mapInPandas(run, f"k {kind}, url string, content binary, error string").withColumnRenamed("k", key)


def first_fetched(attempts: DataFrame, key: str) -> DataFrame:
    """attempts: key, pos, url, status, content_type -> key, url (null if none succeeded): the first that gave a document."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    good = (F.col("status") == 200) & (F.contains(kind, F.lit("pdf")) | F.contains(kind, F.lit("octet-stream")))
    return attempts.groupBy(key).agg(F.min_by(F.when(good, F.col("url")), F.when(good, F.col("pos"))).alias("url"))


def fetch_summary(fetched: DataFrame) -> DataFrame:
    """How many were fetched and how many failed; see failed_fetches."""
    return fetched.groupBy(F.col("url").isNotNull().alias("ok")).agg(F.count("*").alias("n"))


def failed_fetches(fetched: DataFrame, key: str) -> DataFrame:
    """Which ones failed."""
    return fetched.where("url is null").select(key)


def write_dimension(rows: DataFrame, path: str) -> None:
    """A table of a few rows as one JSON array, as read_dimension takes it."""
    rows.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rows.columns)))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_report(metrics: DataFrame, folder: str) -> None:
    """A table of a few rows, as one JSON and one CSV file."""
    one = metrics.coalesce(1)
    one.write.mode("overwrite").json(f"{folder}/json")
    one.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
