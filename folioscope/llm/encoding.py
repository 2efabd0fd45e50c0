"""Encoding of texts with a public byte-level BPE tokenizer, read from its rank file.

A text is split by the tokenizer's pattern; the merges of each part run on a segment tree over its byte
positions, whose nodes hold the leftmost minimum rank of a pair. A merge updates the leaves of the merged
position, of its live neighbour to the left and of the position that went, each in logarithmic time, so a part
of any length (a text without white space) takes n log n steps. Ids of short parts are kept, within a bound.

Defined ids: the empty list for an empty and for a null text. Strings that look like special tokens are
ordinary text. Every input row gives one output row.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tokenizer's published split pattern, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 62
KEPT, KEPT_CHARS = 200_000, 64


def default_ranks() -> str:
    """The rank file of byte_bpe_50k where the public tokenizers are installed."""
    found = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(found.origin) if found else "/opt/tokenizers"
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


class Encoder:
    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(pattern).findall
        # The same pattern where all characters are ASCII; white space is named, as \s would add control characters.
        self.split_ascii = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+").findall if pattern == PATTERN else None
        self.kept: dict[str, tuple[int, ...]] = {}

    def merge(self, part: bytes) -> tuple[int, ...]:
        ranks, longest, n = self.ranks, self.longest, len(part)
        if n == 1:
            return (ranks[part],)
        token = [part[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        size = 1 << (n - 1).bit_length()
        tree = [NONE] * (2 * size)  # a node: rank << 32 | position, so the least is the leftmost of the least rank
        for i in range(n - 1):
            r = ranks.get(part[i : i + 2])
            if r is not None:
                tree[size + i] = r << 32 | i
        for v in range(size - 1, 0, -1):
            a, b = tree[2 * v], tree[2 * v + 1]
            tree[v] = a if a < b else b

        def put(i: int, value: int) -> None:
            v = size + i
            tree[v] = value
            v >>= 1
            while v:
                a, b = tree[2 * v], tree[2 * v + 1]
                least = a if a < b else b
                if tree[v] == least:
                    break
                tree[v] = least
                v >>= 1

        def rank(i: int) -> int:
            j = right[i]
            if j >= n or len(token[i]) + len(token[j]) > longest:
                return NONE
            r = ranks.get(token[i] + token[j])
            return NONE if r is None else r << 32 | i

        while tree[1] < NONE:
            i = tree[1] & 0xFFFFFFFF
            j = right[i]
            token[i] += token[j]
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            put(j, NONE)
            put(i, rank(i))
            if left[i] >= 0:
                put(left[i], rank(left[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i]])
            i = right[i]
        return tuple(out)

    def part(self, part: str) -> tuple[int, ...]:
        ids = self.merge(part.encode("utf-8", "replace"))
        if len(part) <= KEPT_CHARS:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[part] = ids
        return ids

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        parts = self.split_ascii(text) if self.split_ascii and text.isascii() else self.split(text)
        kept, part = self.kept.get, self.part
        return np.fromiter(chain.from_iterable([kept(p) or part(p) for p in parts]), np.int32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), kind))


def encode(df: DataFrame, key: str, text: str, ranks: str | None = None) -> DataFrame:
    """key, ids: the token ids of every row's text, without special tokens."""
    path = ranks or default_ranks()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in rows:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), lists([e(t) for t in part.column(1).to_pylist()], pa.int32())], names=["k", "ids"])

    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, ids array<int>").withColumnRenamed("k", key)


def decode(df: DataFrame, key: str, ids: str, ranks: str | None = None) -> DataFrame:
    """key, text: the texts of lists of token ids. Bytes that are no text come out as replacement characters; null ids give null."""
    path = ranks or default_ranks()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: t for t, i in encoder(path).ranks.items()}
        for b in rows:
            texts = [None if x is None else b"".join([token[i] for i in x]).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    rows = df.select(F.col(key).alias("k"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, text string").withColumnRenamed("k", key)
