"""The boundary to models: an embedder turns a text column into a vector column.

The default hashes tokens to signed dimensions and scales to unit length: deterministic, needs no weights. Any
callable from Column to Column, such as an Arrow pandas UDF around an encoder, may take its place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens

Embedder = Callable[[Column], Column]
#: The instruction before a query, for encoders that want one.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def token_hash(token: str) -> int:
    """The first 32 bits of the token's MD5."""
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16)


def hashing(dim: int = 64) -> Embedder:
    """A token adds 1 or -1 (by one bit of its hash) to one dimension. Null and token-less texts give all zeros."""

    @F.arrow_udf("array<float>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}
        for toks in batches:
            coded = toks.flatten().dictionary_encode()
            names = coded.dictionary.to_pylist()
            if len(known) > 1_000_000:
                known.clear()
            h = np.array([known[t] if t in known else known.setdefault(t, token_hash(t)) for t in names], np.int64)
            out = np.zeros((len(toks), dim))
            if len(h):
                h = h[coded.indices.to_numpy()]
                np.add.at(out, (pc.list_parent_indices(toks).to_numpy(), h % dim), np.where(h // dim % 2 == 1, 1.0, -1.0))
            norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
            out = np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)
            yield pa.ListArray.from_arrays(np.arange(0, dim * len(toks) + 1, dim, dtype=np.int32), out.ravel())

    return lambda text: count(F.coalesce(tokens(text), F.array().cast("array<string>")))


def with_prefix(embedder: Embedder, prefix: str = QUERY_PREFIX) -> Embedder:
    return lambda text: embedder(F.concat(F.lit(prefix), text))


def from_batches(encode: Callable[[list[str]], np.ndarray], batch: int = 64) -> Embedder:
    """An encoder of lists of texts as an embedder; it is called in batches, on executors."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            rows = [v for lo in range(0, len(s), batch) for v in np.asarray(encode(s.iloc[lo : lo + batch].fillna("").tolist()), np.float32)]
            yield pd.Series(rows, index=s.index)

    return run


def pairs_from_batches(score: Callable[[list[tuple[str, str]]], np.ndarray], batch: int = 8) -> Callable[[Column, Column], Column]:
    """A cross-encoder of lists of (query, document) as a scorer of two text columns; it is called in batches, on executors."""

    @F.pandas_udf("double")
    def run(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, d in columns:
            pairs = list(zip(q.fillna("").tolist(), d.fillna("").tolist()))
            yield pd.Series([float(v) for lo in range(0, len(pairs), batch) for v in score(pairs[lo : lo + batch])], index=q.index, dtype="float64")

    return run
