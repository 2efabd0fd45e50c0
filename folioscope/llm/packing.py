"""Filling containers of fixed capacity with texts that are alike, leaving as little room as possible.

Items that are alike come to one shard: an item goes by its most telling token, the one of the highest count times
inverse document frequency over all items. The tokens' items are counted; rare tokens share a shard up to
`shard` items, and a token with more has several, to which its items are dealt by a hash. The plan has a row a
token of the vocabulary, whatever the number of items. A shard holds a BM25 inverted index over the tokens of its
items. The longest unused item seeds a container; the index is asked with all its tokens, and the unused items that
share any fill the container greedily in the order of their score, as long as they fit; what room is left goes to the
longest unused items that still fit, best fit first. The items of containers that stay emptier than SLACK allows, which are
those filled last, are filled once more, by size alone, together with those of the TOGETHER shards around. A text longer than the capacity is cut into full containers and
a rest, which is an item like any other; nothing else is split.

Empty and null texts take no room: they come out with 0 tokens and no container. Equal texts are items of their
own. Ties go to the lower key, so the result does not depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, staged
from .encoding import default_ranks, encoder, lists

K1, B = 1.5, 0.75
SHARD = 1000
#: Room, as a share of the capacity, with which a container is done at first; shards whose rest is filled together.
SLACK, TOGETHER = 0.02, 64


def _items(rows: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    """key, piece, first token, tokens, and the different tokens with their counts; full containers of cut texts have none of these."""
    e = encoder(path)
    for b in rows:
        for lo in range(0, b.num_rows, 1000):
            part = b.slice(lo, 1000)
            out: list[tuple] = []
            for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = e(t)
                full = len(ids) // capacity if len(ids) > capacity else 0
                out += [(k, p, p * capacity, capacity, True, ids[:0], ids[:0]) for p in range(full)]
                rest = ids[full * capacity :]
                if len(rest) or not full:
                    term, tf = np.unique(rest, return_counts=True)
                    out.append((k, full, full * capacity, len(rest), len(rest) == capacity, term, tf.astype(np.int32)))
            c = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.bool_()), lists(list(c[5]), pa.int32()), lists(list(c[6]), pa.int32())],
                names=["key", "piece", "first", "tokens", "full", "terms", "tf"],
            )


def fill(size: np.ndarray, terms: list[np.ndarray], tf: list[np.ndarray], capacity: int) -> np.ndarray:
    """The container of each item of a shard, counted from 0. Items come in the order in which ties are broken."""
    n = len(size)
    doc = np.repeat(np.arange(n), [len(t) for t in terms])
    term = np.concatenate(terms).astype(np.int64) if n else np.zeros(0, np.int64)
    count = np.concatenate(tf).astype(np.float64) if n else np.zeros(0)
    order = np.argsort(term, kind="stable")
    names, at, df = np.unique(term[order], return_index=True, return_counts=True)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    length = np.array([x.sum() for x in tf], dtype=np.float64)
    norm = K1 * (1 - B + B * length / max(length.mean() if n else 1, 1))
    posted, weight = doc[order], count[order]
    weight = weight * (K1 + 1) / (weight + norm[posted]) * np.repeat(idf, df)
    start = np.append(at, len(posted))

    box, free, next_box = np.full(n, -1), np.ones(n, bool), 0
    sizes = size.tolist()
    shelf: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(n - 1, -1, -1):
        shelf[sizes[i]].append(i)  # the lowest place is taken first
    stocked = sum(1 << s for s in set(sizes))

    def longest(room: int) -> int:
        """The longest unused item of at most that size, or -1."""
        nonlocal stocked
        while True:
            s = (stocked & ((1 << (room + 1)) - 1)).bit_length() - 1
            if s < 1:
                return -1
            stack = shelf[s]
            while stack and not free[stack[-1]]:
                stack.pop()
            if stack:
                return stack[-1]
            stocked &= ~(1 << s)

    while (seed := longest(capacity)) >= 0:
        room = capacity - sizes[seed]
        box[seed], free[seed] = next_box, False
        if room:
            own = np.searchsorted(names, terms[seed])
            spans = [np.arange(start[t], start[t + 1]) for t in own]
            if spans:
                span = np.concatenate(spans)
                score = np.bincount(posted[span], weights=weight[span], minlength=n)
                near = np.flatnonzero(free & (score > 0) & (size <= room))
                for i in near[np.lexsort((near, -score[near]))].tolist():
                    if sizes[i] <= room:
                        box[i], free[i] = next_box, False
                        room -= sizes[i]
                        if not room:
                            break
            while room and (i := longest(room)) >= 0:
                box[i], free[i] = next_box, False
                room -= sizes[i]
        next_box += 1
    return box


def _spread(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many items each token is."""
    n = np.zeros(0, np.int64)
    for b in rows:
        more = np.bincount(b.column("terms").flatten().to_numpy())
        n, more = (n, more) if len(n) >= len(more) else (more, n)
        n[: len(more)] += more
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["token", "n"])


def telling(terms: pa.ListArray, tf: pa.ListArray, idf: np.ndarray) -> np.ndarray:
    """The token of the highest count times idf of each item, the lowest of equal ones; -1 for an item without tokens."""
    ends = terms.offsets.to_numpy() - terms.offsets.to_numpy()[0] if len(terms) else np.zeros(1, np.int64)
    token, count = terms.flatten().to_numpy(), tf.flatten().to_numpy()
    out, some = np.full(len(terms), -1, np.int64), np.flatnonzero(np.diff(ends))
    if len(some):
        weight = (count * idf[token]).round(9)
        most = np.repeat(np.maximum.reduceat(weight, ends[some]), np.diff(ends)[some])
        out[some] = np.minimum.reduceat(np.where(weight == most, token, len(idf)), ends[some])
    return out


def _told(rows: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How many items go by each token (counted from 1; 0: none)."""
    total = np.zeros(len(idf) + 1, np.int64)
    for b in rows:
        total += np.bincount(telling(b.column("terms"), b.column("tf"), idf) + 1, minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["token", "n"])


def shards_of(count: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each token: neighbours share one until it is full, a token of many items has its own."""
    first, number, at, held = np.zeros(len(count), np.int64), np.maximum(1, -(-count // shard)), 0, 0
    for t in np.flatnonzero(count).tolist():
        n = int(count[t])
        if held and held + n > shard:
            at, held = at + 1, 0
        first[t] = at
        if number[t] > 1:
            at, held = at + int(number[t]), 0
        else:
            held += n
    return first, number


def _dealt(rows: Iterator[pa.RecordBatch], idf: np.ndarray, first: np.ndarray, number: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in rows:
        t = telling(b.column("terms"), b.column("tf"), idf) + 1
        with np.errstate(over="ignore"):
            spread = ((b.column("key").to_numpy().astype(np.uint64) * np.uint64(31) + b.column("piece").to_numpy().astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first[t] + spread % number[t])], names=[*b.schema.names, "shard"])


def _filled(rows: Iterator[pa.RecordBatch], capacity: int, by: str = "shard", first_name: int = 0, slack: float = 1.0) -> Iterator[pa.RecordBatch]:
    """The container of each item; where one has more room than slack allows, its items come out to be filled again, then without their tokens."""
    t = gathered(rows)
    if t is None:
        return
    t = t.sort_by([(by, "ascending"), ("key", "ascending"), ("piece", "ascending")]).combine_chunks()
    shard = t[by].to_numpy()
    for s in np.unique(shard):
        lo, hi = np.searchsorted(shard, [s, s + 1])
        part = t.slice(lo, hi - lo)
        size = part["tokens"].to_numpy()
        terms, tf = (_arrays(part[c]) for c in ("terms", "tf"))
        box = np.full(len(size), -1)
        loose = np.flatnonzero((size > 0) & ~part["full"].to_numpy(zero_copy_only=False))
        box[loose] = fill(size[loose], [terms[i] for i in loose], [tf[i] for i in loose], capacity)
        full = np.flatnonzero((size > 0) & (box < 0))
        box[full] = box.max(initial=-1) + 1 + np.arange(len(full))
        free = capacity - np.bincount(box[box >= 0], weights=size[box >= 0], minlength=1)
        again = (box >= 0) & (free[box] > slack * capacity)
        name = pa.array(s * 10_000_000 + first_name + box, pa.int64(), mask=(box < 0) | again)
        kept = [part[c].combine_chunks() for c in ("key", "piece", "first", "tokens", "full")]
        none = pa.ListArray.from_arrays(pa.array(np.zeros(len(box) + 1, np.int32)), pa.array([], pa.int32()))
        yield pa.RecordBatch.from_arrays([*kept, none, none, part["shard"].combine_chunks(), pa.array(again), name], names=["key", "piece", "first", "tokens", "full", "terms", "tf", "shard", "again", "container"])


def _arrays(col: pa.ChunkedArray) -> list[np.ndarray]:
    col = col.combine_chunks()
    flat, ends = col.flatten().to_numpy(), col.offsets.to_numpy()
    ends = ends - ends[0]
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def pack(df: DataFrame, key: str, text: str, capacity: int = 2048, ranks: str | None = None, shard: int = SHARD) -> DataFrame:
    """key, piece, first (token), tokens, container: where every text, or piece of a longer one, goes."""
    path = ranks or default_ranks()
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    kind = "key long, piece int, first int, tokens int, full boolean, terms array<int>, tf array<int>"
    items = staged(rows.mapInArrow(lambda it: _items(it, path, capacity), kind), "items")

    def summed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], size: int) -> np.ndarray:
        """A count for each token of the vocabulary."""
        got = items.mapInArrow(f, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(size or int(max(got["token"].to_pylist(), default=0)) + 1, np.int64)
        out[got["token"].to_numpy()] = got["n"].to_numpy()
        return out

    df_of = summed(_spread, 0)
    idf = np.log(1 + (items.count() + 0.5) / (df_of + 0.5))
    first, number = shards_of(summed(lambda it: _told(it, idf), len(idf) + 1), shard)
    shards = int((first + number).max())
    dealt = items.mapInArrow(lambda it: _dealt(it, idf, first, number), kind + ", shard long")
    parts = min(shards, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // 8))
    kind += ", shard long"
    most = kind + ", again boolean, container long"
    filled = staged(dealt.repartitionById(parts, (F.col("shard") % parts).cast("int")).mapInArrow(lambda it: _filled(it, capacity, slack=SLACK), most), "filled")
    rest = filled.where("again").drop("again", "container").withColumn("around", F.floor(F.col("shard") / TOGETHER))
    parts = max(1, min(parts, shards // TOGETHER))
    rest = rest.repartitionById(parts, (F.col("around") % parts).cast("int")).mapInArrow(lambda it: _filled(it, capacity, "around", 9_000_000), most)
    out = ["key", "piece", "first", "tokens", "container"]
    return filled.where("not again").select(out).unionByName(rest.select(out)).withColumnRenamed("key", key)
