"""Splitting oversized texts at natural boundaries, content-defined.

A rolling hash over the last 32 characters marks landmarks. A piece ends at the natural boundary nearest to the
first landmark past its least size: at the end of a paragraph if one lies within its least and greatest size,
else of a line, of a sentence, of a word; only where there is none of these at the landmark itself, and without a
landmark at the greatest size. As landmarks depend on nearby characters only, an edit alters the pieces next to
it and no others. A piece begins with the end of the piece before, up to `overlap` characters, from the start of
a word where one is in reach.

Sizes are counted in code points. The pieces without their overlaps, put together, are the text. Texts up to the
limit are left out; so are null texts and keys. A row delivered again counts once.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once

BOUNDARIES = (re.compile(r"\n[^\S\n]*\n\s*"), re.compile(r"\n\s*"), re.compile(r"[.!?;।]['\")\]]*\s+"), re.compile(r"\s+"))
WORD_START = re.compile(r"\s(?=\S)")
SPACING = 0x7F  # a landmark every 128 characters, on average


def landmarks(text: str) -> np.ndarray:
    """The places after which the rolling hash of the last 32 characters is a landmark."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    h = (c + np.uint32(0x9E37)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    width = 1
    while width < 32:  # h[i] sums the last 2 * width characters, each shifted by its distance
        h[width:] = h[width:] + (h[:-width] << np.uint32(width)) if len(h) > width else h[width:]
        width *= 2
    return np.flatnonzero(((h >> np.uint32(16)) & np.uint32(SPACING)) == 0) + 1


def split(text: str, limit: int = 1200, overlap: int = 150, least: int = 400) -> list[tuple[int, int, int]]:
    """(begin of the overlap, begin, end) of each piece; one piece for a text up to the limit."""
    n = len(text)
    if n <= limit:
        return [(0, 0, n)]
    marks = landmarks(text).tolist()
    ends = [[m.end() for m in p.finditer(text)] for p in BOUNDARIES]
    starts = [m.end() for m in WORD_START.finditer(text)]
    pieces, begin = [], 0
    while True:
        from_ = begin
        if begin:
            i = bisect_left(starts, begin - overlap)
            from_ = starts[i] if i < len(starts) and starts[i] < begin else begin - overlap
            while from_ < begin and unicodedata.combining(text[from_]):
                from_ += 1
        most = from_ + limit
        if n <= most:
            pieces.append((from_, begin, n))
            return pieces
        low = min(begin + least, most)
        i = bisect_left(marks, low)
        mark = marks[i] if i < len(marks) and marks[i] <= most else most
        cut = 0
        for place in ends:
            a, b = bisect_left(place, low), bisect_right(place, most)
            if a < b:
                j = bisect_left(place, mark, a, b)
                cut = min(place[max(a, j - 1) : min(b, j + 1)], key=lambda x: (abs(x - mark), x))
                break
        if not cut:
            cut = mark
            while cut > begin + 1 and unicodedata.combining(text[cut]):
                cut -= 1
        pieces.append((from_, begin, cut))
        begin = cut


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 1200, overlap: int = 150, least: int = 400) -> DataFrame:
    """key, chunk_index, total_chunks, overlap, text: the pieces of every text of more than `limit` code points."""
    if not 0 <= overlap < least <= limit - overlap:
        raise ValueError("0 <= overlap < least <= limit - overlap must hold")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                out = []
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    cuts = split(t, limit, overlap, least)
                    out += [(k, i, len(cuts), begin - a, t[a:end]) for i, (a, begin, end) in enumerate(cuts)]
                c = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c[0], part.schema.field(0).type), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.string())], names=["key", "chunk_index", "total_chunks", "overlap", "text"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(F.length("text") > limit)
    rows = once(rows, "key", "text")
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, chunk_index int, total_chunks int, overlap int, text string").withColumnRenamed("key", key)
