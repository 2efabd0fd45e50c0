"""Vector arithmetic and exact nearest neighbours.

Single pairs are column expressions; a batch of queries against a table goes through numpy in Arrow batches: each
batch of rows is multiplied with the whole batch of queries. A task keeps one running list of the k best for each
query and gives it out once, at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries sent to every task at a time. A larger batch is joined in blocks of so many.
QUERIES = 20_000


def _d(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """NULL where a vector is all zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mix(main: Column, anchor: Column, w_main: float = 0.7, w_anchor: float = 0.3) -> Column:
    """The weighted sum; a null anchor counts as zeros, so the sum is shorter then. Not normalised again."""
    both = F.zip_with(_d(main), _d(anchor), lambda x, y: F.lit(w_main) * x + F.lit(w_anchor) * y)
    return F.when(anchor.isNull(), F.transform(_d(main), lambda x: F.lit(w_main) * x)).otherwise(both)


def similarity(distance: Column) -> Column:
    return F.exp(-distance)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _usable(col: pa.Array, dim: int) -> np.ndarray:
    if not len(col):
        return np.zeros(0, bool)
    n = pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    bad = pa.compute.is_in(pa.array(np.arange(len(col))), pa.compute.list_parent_indices(col).filter(pa.compute.invert(pa.compute.is_finite(pa.compute.list_flatten(col)).fill_null(False))))
    return (n == dim) & ~bad.to_numpy(zero_copy_only=False)


def knn(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query: str, query_vector: str, k: int = 50, metric: str = "l2sq", filter_col: str | None = None, query_filter: str | None = None, dim: int = 64) -> DataFrame:
    """query, id, distance, rank: the k nearest rows of each query, exact.

    metric "l2sq" (squared distance) or "cosine" (1 - cosine). With filter_col only rows whose value equals the
    query's are looked at, where the query has one. Vectors of another length, null or with NaN have no place.
    Ties, to twelve decimals, go to the lower id. Queries are taken in blocks of bounded size, each of which is sent to all tasks.
    """
    import pyarrow.compute  # noqa: F401

    spark = vectors.sparkSession
    cols = [F.col(query).cast("long").alias("query"), F.col(query_vector).cast("array<double>").alias("v"), (F.col(query_filter or filter_col).cast("string") if filter_col else F.lit(None).cast("string")).alias("f")]
    asked = queries.select(*cols).where("query is not null")
    blocks = max(1, -(-asked.count() // QUERIES))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(filter_col).cast("string") if filter_col else F.lit(None).cast("string")).alias("f")).where("id is not null")
    found = None
    for block in range(blocks):  # one block unless there are more than QUERIES queries
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).toArrow()
        held = spark.sparkContext.broadcast(_block(part, dim, metric))

        def run(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, x, fs, groups = held.value
            best, place = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)
            for b in it:
                ok = _usable(b.column("v"), dim)
                b = b.filter(pa.array(ok))
                if not b.num_rows or not len(ids):
                    continue
                y, rid, rf = _matrix(b.column("v"), dim), b.column("id").to_numpy(), np.array(b.column("f").to_pylist(), object)
                if metric == "cosine":
                    n = np.sqrt((y * y).sum(axis=1))
                    keep = n > 0
                    y, rid, rf = y[keep] / n[keep, None], rid[keep], rf[keep]
                for f, qs in groups.items():
                    sel = np.arange(len(rid)) if f is None else np.flatnonzero(rf == f)
                    for lo in range(0, len(qs) if len(sel) else 0, 512):
                        q = qs[lo : lo + 512]
                        yy = y[sel]
                        # The short form tells which rows may come near; the distances given are summed term by term.
                        near = (x[q] * x[q]).sum(axis=1)[:, None] + (yy * yy).sum(axis=1)[None, :] - 2 * x[q] @ yy.T
                        if metric == "cosine":
                            near /= 2
                        open_ = near.min(axis=1) <= best[q, -1] + 1e-6
                        q, near = q[open_], near[open_]
                        if not len(q):
                            continue
                        m = min(k + 8, len(sel))
                        at = np.argpartition(near, m - 1, axis=1)[:, :m]
                        d = 1 - (x[q][:, None, :] * yy[at]).sum(axis=2) if metric == "cosine" else ((x[q][:, None, :] - yy[at]) ** 2).sum(axis=2)
                        both, held_ids = np.concatenate([best[q], d.round(12)], axis=1), np.concatenate([place[q], rid[sel][at]], axis=1)
                        order = np.lexsort((held_ids, both), axis=1)[:, :k]
                        best[q], place[q] = np.take_along_axis(both, order, 1), np.take_along_axis(held_ids, order, 1)
            q, at = np.nonzero(best < np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(place[q, at]), pa.array(best[q, at])], names=["query", "id", "distance"])

        got = rows.mapInArrow(run, "query long, id long, distance double")
        found = got if found is None else found.unionByName(got)
    w = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block(part: pa.Table, dim: int, metric: str) -> tuple:
    part = part.combine_chunks()
    if not part.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, dim)), [], {}
    v = part["v"].combine_chunks() if isinstance(part["v"], pa.ChunkedArray) else part["v"]
    ok = _usable(v, dim)
    part = part.filter(pa.array(ok))
    v = part["v"].combine_chunks()
    x = _matrix(v, dim) if part.num_rows else np.zeros((0, dim))
    if metric == "cosine":
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        part, x = part.filter(pa.array((n > 0)[:, 0])), (x / np.where(n > 0, n, 1))[(n > 0)[:, 0]]
    fs = part["f"].to_pylist()
    groups: dict = {}
    for i, f in enumerate(fs):
        groups.setdefault(f, []).append(i)
    return part["query"].to_numpy(), x, fs, {f: np.array(i) for f, i in groups.items()}
