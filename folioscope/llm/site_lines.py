"""Lines repeated across one site's documents: found, and removed from each document.

Lines are parted by newline and counted from 1. Two lines are the same if they differ only in letter case, in
white space (leading and trailing counts for nothing, any run is one space) or in their numbers (any run of
digits equals any other). A line is repeated if it stands in at least `least` documents of its source and in at
least the share `share` of them; documents with null or empty text count among these. Line 1 (a heading) and
blank lines are never removed. Rows with a null source or key are left out of the counts and kept as they are.
A row delivered again counts once; of a key that comes with several texts each text's lines count for it.

First pass: every task keeps a Misra-Gries summary of each source it meets, over hashes of the lines. Summaries merge:
counters of equal lines add up, and so does what each may have lost; a batch's own counts are a summary that is merged
into the task's, and the tasks' are merged by a groupBy. So no text is shuffled, a large source needs no task of
its own, and a task whose counters grow too many hands them on and starts anew. A line's counter and what was lost
are together at least its true count, so every repeated line is a candidate. Second pass: exact counts of the
candidates over all documents. The confirmed lines are removed with broadcast sets, one a source: a document holds
only so many lines, so at most 1 / `share` as many are repeated in its source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, staged

#: Counters of a summary below which it loses nothing, and counters of all summaries of a task.
CAPACITY, HELD = 512, 1_000_000


def lines_of(text: Column) -> Column:
    """The lines in the form in which they are compared."""
    digits = F.lower(F.regexp_replace(text, r"\p{Nd}+", "0"))
    return F.transform(F.split(F.regexp_replace(digits, r"(?U)[^\S\n]{2,}|[^\S\n ]", " "), "\n"), lambda x: F.trim(x))


class Summary:
    """A Misra-Gries summary of a source's lines: no counter is further below the true count than `lost`."""

    __slots__ = ("line", "count", "docs", "lost")

    def __init__(self, line: np.ndarray, count: np.ndarray, docs: int, lost: int = 0) -> None:
        self.line, self.count, self.docs, self.lost = line, count, docs, lost

    def merge(self, other: Summary, share: float) -> None:
        """Adds the counters and the losses; if there are too many counters, the one in the middle is subtracted from all."""
        line, at = np.unique(np.concatenate([self.line, other.line]), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate([self.count, other.count])).astype(np.int64)
        self.line, self.count, self.docs, self.lost = line, count, self.docs + other.docs, self.lost + other.lost
        if len(line) > max(CAPACITY, 2 * int(other.count.sum() / max(1, other.docs) / max(share, 1e-9))):
            # No more is lost than a quarter of what makes a line repeated, so that alone makes no candidate.
            self.drop(min(int(np.median(count)), int(share * self.docs / 4) - self.lost))

    def drop(self, n: int) -> None:
        if n > 0:
            kept = self.count > n
            self.line, self.count, self.lost = self.line[kept], self.count[kept] - n, self.lost + n


def _summaries(rows: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """source, line (a hash), n: the counters of each source, and, without a line, what they may have lost."""
    held: dict[str, Summary] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for s in held.values():
            s.drop(int(share * s.docs / 4) - s.lost)
        names = pa.array(list(held), pa.string())
        sizes = [len(s.line) for s in held.values()]
        if held:
            yield pa.RecordBatch.from_arrays([names, pa.nulls(len(held), pa.int64()), pa.array([s.lost for s in held.values()], pa.int64())], names=["source", "line", "n"])
            of = names.take(pa.array(np.repeat(np.arange(len(held)), sizes)))
            yield pa.RecordBatch.from_arrays([of, pa.array(np.concatenate([s.line for s in held.values()])), pa.array(np.concatenate([s.count for s in held.values()]))], names=["source", "line", "n"])
        held.clear()

    for b in rows:
        coded = b.column("source").dictionary_encode()
        doc, col = coded.indices.to_numpy(), b.column("lines")
        source, line = doc[pc.list_parent_indices(col).to_numpy()], col.flatten().to_numpy()
        order = np.lexsort((line, source))
        source, line = source[order], line[order]
        edge = np.flatnonzero(np.concatenate([[True], (source[1:] != source[:-1]) | (line[1:] != line[:-1])])) if len(line) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(line)))
        source, line = source[edge], line[edge]
        docs = np.bincount(doc, minlength=len(coded.dictionary))
        cut = np.searchsorted(source, np.arange(len(docs) + 1))
        for i, name in enumerate(coded.dictionary.to_pylist()):
            new = Summary(line[cut[i] : cut[i + 1]], count[cut[i] : cut[i + 1]].astype(np.int64), int(docs[i]))
            old = held.get(name)
            if old is None:
                held[name] = new
                size += len(new.line)
            else:
                size -= len(old.line)
                old.merge(new, share)
                size += len(old.line)
        if size + len(held) > HELD:
            yield from flush()
            size = 0
    yield from flush()


def _rows(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    rows = df.where(F.col(source).isNotNull() & F.col(key).isNotNull())
    return rows.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))


def _confirmed(rows: DataFrame, least: int, share: float) -> tuple[DataFrame, DataFrame]:
    """(hits, confirmed): the occurrences of candidates (key, source, line_no, line), and of these the repeated (source, line, docs)."""
    docs = staged(rows.select("source", "key").distinct().groupBy("source").agg(F.count("*").alias("all_docs")), "sources")
    hashed = F.transform(F.filter(F.slice(lines_of(F.col("text")), 2, 2_000_000_000), lambda x: x != ""), lambda x: F.xxhash64(x))
    found = rows.select("source", F.coalesce(F.array_distinct(hashed), F.array().cast("array<long>")).alias("lines"))
    merged = found.mapInArrow(lambda it: _summaries(it, share), "source string, line long, n long").groupBy("source", "line").agg(F.sum("n").alias("n"))
    merged = staged(merged, "summaries")
    lost = merged.where("line is null").select("source", F.col("n").alias("lost"))
    bar = broadcast_if_small(docs.where(F.col("all_docs") >= least).join(lost, "source"))
    known = merged.where("line is not null").join(bar, "source").where((F.col("n") + F.col("lost") >= least) & (F.col("n") + F.col("lost") >= share * F.col("all_docs") - 1e-9))
    candidates = staged(known.select("source", F.col("line").alias("h")), "candidates")
    lines = rows.select("key", "source", F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).where("pos > 0 and line <> ''")
    lines = lines.select("key", "source", (F.col("pos") + 1).alias("line_no"), "line", F.xxhash64("line").alias("h"))
    hits = staged(lines.join(broadcast_if_small(candidates), ["source", "h"], "left_semi").drop("h").distinct(), "hits")
    counts = hits.groupBy("source", "line").agg(F.count_distinct("key").alias("docs"))
    confirmed = counts.join(broadcast_if_small(docs), "source").where((F.col("docs") >= least) & (F.col("docs") >= share * F.col("all_docs"))).drop("all_docs")
    return hits, staged(confirmed, "confirmed")


def repeated_lines(df: DataFrame, key: str, source: str, text: str, least: int = 10, share: float = 0.1) -> DataFrame:
    """key, source, line_no, line (as compared), docs: each occurrence of a repeated line."""
    hits, confirmed = _confirmed(_rows(df, key, source, text), least, share)
    return hits.join(broadcast_if_small(confirmed), ["source", "line"]).select(F.col("key").alias(key), F.col("source"), "line_no", "line", "docs")


def without_repeated(df: DataFrame, key: str, source: str, text: str, least: int = 10, share: float = 0.1) -> DataFrame:
    """The rows of df, with the repeated lines gone from the text and `removed_lines`, the numbers of those (null for none)."""
    confirmed = _confirmed(_rows(df, key, source, text), least, share)[1]
    sets = confirmed.groupBy(F.col("source").alias("_source")).agg(F.collect_set("line").alias("_set"))
    rows = df.drop("removed_lines").join(broadcast_if_small(staged(sets, "sets"), 20_000), F.col(source).cast("string") == F.col("_source"), "left")
    numbers = F.filter(F.transform(lines_of(F.col(text)), lambda x, i: F.when((i > 0) & F.array_contains("_set", x), i + 1)), lambda x: x.isNotNull())
    rows = rows.withColumn("removed_lines", F.when(F.col(key).isNotNull() & F.col("_set").isNotNull() & (F.size(numbers) > 0), numbers)).drop("_source", "_set")
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("removed_lines", i + 1))
    return rows.withColumn(text, F.when(F.col("removed_lines").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
