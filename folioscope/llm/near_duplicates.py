"""Near-duplicate records with small edits, by the generalised pigeonhole principle.

A text becomes the set of its runs of `width` words, and the set a vector of `PARTS * POSITIONS` minimum
hashes. Written one-hot, such a vector is binary; the bits that belong to one minimum hash exclude each other, so they
stay together. Two sets of similarity s differ in a share 1 - s of the minimum hashes.

Some minimum hashes carry a value that is common, as a run that many records share (a standing phrase) has a low hash
there; such positions bring false candidates, and bring them together. How the positions' common values go with each
other is measured over all records, and the positions that are most correlated form a partition.

Each partition gets its own threshold: -1 (not probed), 0 (all its positions equal) or 1 (all but one equal).
A dynamic program picks the thresholds that need the fewest candidates, as estimated for every partition and
threshold from second-moment sketches over *all* records, among those that find a pair at the similarity limit
with at least `1 - miss`. A pair that agrees in a probed partition is a candidate; a sketch of 128 further bits
drops most of the false ones on the spot (and one in 2,000 pairs at the limit), the rest is verified on the texts,
exactly. `miss` must be above 0: hashing promises no certainty.

A signature shared by very many records is known from a part of them before the records are dealt; its records are
cut to blocks, and a task gets two blocks. That plan changes where pairs are found, not which.

Nulls: a null or empty text has no runs and is in no pair. Records with fewer than `least` runs are left out.
Records with equal sets of runs form one class, of which only the representative (least key) is compared.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, gathered, once, staged

PARTS, POSITIONS, SKETCH = 24, 3, 128
BUCKETS = 1024
#: A group of records that share a signature is compared in one task up to this many, about; larger ones by blocks.
BLOCK = 4096
#: One in SEEN records is looked at to know the large groups, of which at most HOT are told to the tasks.
SEEN, HOT = 64, 500_000
FILED = "sig long, x int, y int, block int, id long, bits0 long, bits1 long"
WORD = re.compile(r"[a-z0-9]+")
MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of full avalanche."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hash(word: str) -> int:
    h = 0xCBF29CE484222325
    for b in word.encode():
        h = ((h ^ b) * 0x100000001B3) & MASK
    return h


class Runs:
    """Hashes of the different runs of words of many texts, end to end, with where each text begins."""

    def __init__(self, width: int) -> None:
        self.width, self.known = width, {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        known, flat, counts = self.known, [], []
        if len(known) > 1_000_000:  # a memory bound; entries come again when needed
            known.clear()
        for t in texts:
            words = WORD.findall(t.lower()) if t else []
            for w in words:
                h = known.get(w)
                if h is None:
                    h = known[w] = word_hash(w)
                flat.append(h)
            counts.append(len(words))
        h = np.array(flat, dtype=np.uint64)
        n, k = np.array(counts, dtype=np.int64), self.width
        doc = np.repeat(np.arange(len(n)), n)
        if len(h) < k:
            return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
        run = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            run = run * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        same = doc[: len(run)] == doc[k - 1 :]
        run, doc = _mix(run[same]), doc[: len(run)][same]
        order = np.lexsort((run, doc))
        run, doc = run[order], doc[order]
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
        run, doc = run[new], doc[new]
        return run, np.searchsorted(doc, np.arange(len(n) + 1))


def _seeds(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


def minima(run: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum hashes (cut to 16 bits, PARTS * POSITIONS a text) and sketch words (uint64, two a text). No text may be empty."""
    h, n = PARTS * POSITIONS, len(start) - 1
    out, bits = np.empty((n, h), np.uint16), np.zeros((n, SKETCH // 64), np.uint64)
    if not n:
        return out, bits
    low = (run >> np.uint64(32)).astype(np.uint32)
    mult = (_seeds(h + SKETCH, 7) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    add = (_seeds(h + SKETCH, 11) >> np.uint64(32)).astype(np.uint32)
    at = start[:-1]
    fine = run.astype(np.uint32)
    for j in range(h + SKETCH):
        # The two halves of the run's hash enter apart, so that no two functions are shifts of one another.
        x = low * mult[j] + (fine ^ add[j])
        x ^= x >> np.uint32(15)
        m = np.minimum.reduceat(x, at)
        if j < h:
            out[:, j] = (m * np.uint32(0x9E3779B1)) >> np.uint32(16)
        else:
            k = j - h
            bit = ((m * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint64)
            bits[:, k // 64] |= bit << np.uint64(k % 64)
    return out, bits


def variants(mins: np.ndarray, part: int, threshold: int, order: np.ndarray) -> list[np.ndarray]:
    """The signatures a record is filed and probed under in a partition; order: the positions, partition by partition."""
    own = mins[:, order[part * POSITIONS : (part + 1) * POSITIONS]].astype(np.uint64)
    kept = [range(POSITIONS)] if threshold == 0 else [[i for i in range(POSITIONS) if i != j] for j in range(POSITIONS)] if threshold == 1 else []
    out = []
    for cols in kept:
        tag = part * 64 + sum(1 << i for i in cols)
        s = np.full(len(own), (tag * 0x9E3779B97F4A7C15) & MASK, np.uint64)
        for i in cols:
            s = _mix((s ^ own[:, i]) * np.uint64(0x9FB21C651E98DF25))
        out.append(s)
    return out


def chance(similarity: float, threshold: int) -> float:
    """That a pair of that similarity agrees in a partition up to the threshold."""
    return sum(comb(POSITIONS, i) * (1 - similarity) ** i * similarity ** (POSITIONS - i) for i in range(threshold + 1))


def allocate(cost: dict[tuple[int, int], float], similarity: float, miss: float) -> list[int]:
    """Thresholds of least total cost whose chance to find a pair at the limit is at least 1 - miss.

    cost: of (partition, threshold). The logarithms of the chances to miss add up; they are counted in steps.
    """
    steps = 400
    need = -log(miss)
    gain = {t: int(-log(1 - chance(similarity, t)) / need * steps) for t in (0, 1)} | {-1: 0}
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in range(PARTS):
        after: dict[int, tuple[float, list[int]]] = {}
        for got, (spent, chosen) in best.items():
            for t in (-1, 0, 1):
                g, c = min(steps, got + gain[t]), spent + (cost[part, t] if t >= 0 else 0.0)
                if g not in after or c < after[g][0]:
                    after[g] = (c, [*chosen, t])
        best = after
    return best[max(best)][1]


def _signed(rows: Iterator[pa.RecordBatch], width: int, least: int) -> Iterator[pa.RecordBatch]:
    runs = Runs(width)
    for b in rows:
        for lo in range(0, b.num_rows, 2000):
            part = b.slice(lo, 2000)
            run, start = runs(part.column(1).to_pylist())
            n = np.diff(start)
            ok = n >= max(1, least)
            run, n = run[np.repeat(ok, n)], n[ok]
            start = np.concatenate([[0], np.cumsum(n)])
            mins, bits = minima(run, start)
            full = np.add.reduceat(_mix(run), start[:-1]) if len(n) else np.zeros(0, np.uint64)
            cls = _mix(full ^ n.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).filter(pa.array(ok)), pa.array(cls.view(np.int64)), pa.array([m.tobytes() for m in mins], pa.binary()), pa.array(bits[:, 0].view(np.int64)), pa.array(bits[:, 1].view(np.int64))],
                names=["id", "class", "mins", "bits0", "bits1"],
            )


def _common(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each position has each value, by buckets of these."""
    h = PARTS * POSITIONS
    total = np.zeros(h * BUCKETS, np.int64)
    for b in rows:
        m = _mins(b.column("mins"))
        total += np.bincount(((m % BUCKETS).astype(np.int64) + np.arange(h) * BUCKETS).ravel(), minlength=h * BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(h * BUCKETS)), pa.array(total)], names=["i", "n"])


def _together(rows: Iterator[pa.RecordBatch], common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """In how many records two positions both have a common value."""
    h = PARTS * POSITIONS
    total = np.zeros((h, h))
    for b in rows:
        x = common[np.arange(h), _mins(b.column("mins")) % BUCKETS].astype(np.float32)
        total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(h * h)), pa.array(total.ravel().astype(np.int64))], names=["i", "n"])


def grouped(together: np.ndarray, n: int) -> np.ndarray:
    """The positions, partition by partition: the most correlated ones together."""
    p = np.diag(together) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = (together / n - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(like, -9)
    free, order = set(range(len(p))), []
    while free:
        left = sorted(free)
        sub = like[np.ix_(left, left)]
        own = [left[int(sub.max(axis=1).argmax())]]
        while len(own) < POSITIONS:
            rest = [i for i in left if i not in own]
            own.append(max(rest, key=lambda i: (like[i, own].sum(), -i)))
        order += own
        free -= set(own)
    return np.array(order)


def _moments(rows: Iterator[pa.RecordBatch], order: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Signed counts by bucket: their squares estimate how many pairs share a signature."""
    total = np.zeros((PARTS, 2, BUCKETS), np.int64)
    for b in rows:
        m = _mins(b.column("mins"))
        for part in range(PARTS):
            for t in (0, 1):
                for s in variants(m, part, t, order):
                    sign = 1 - 2 * ((s >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
                    total[part, t] += np.bincount((s & np.uint64(BUCKETS - 1)).astype(np.int64), weights=sign, minlength=BUCKETS).astype(np.int64)
    at = np.indices(total.shape).reshape(3, -1)
    yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(at[2].astype(np.int32)), pa.array(total.ravel())], names=["part", "t", "bucket", "c"])


def _mins(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, PARTS * POSITIONS)


def _filed(rows: Iterator[pa.RecordBatch], thresholds: list[int], order: np.ndarray, hot: np.ndarray, blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each record under each of its signatures; x, y: the two blocks that meet there, if the signature is among the hot ones (sorted)."""
    for b in rows:
        m, ids = _mins(b.column("mins")), b.column("id").to_numpy()
        spread = (_mix(ids.astype(np.uint64)) >> np.uint64(2)).astype(np.int64)
        for part, t in enumerate(thresholds):
            for s in variants(m, part, t, order):
                s = s.view(np.int64)
                at = np.searchsorted(hot, s)
                n = np.where(hot[np.minimum(at, len(hot) - 1)] == s, blocks[np.minimum(at, len(hot) - 1)], 1) if len(hot) else np.ones(len(s), np.int64)
                block = spread % n
                row = np.repeat(np.arange(len(s)), n)
                other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                own, some = block[row], pa.array(row)
                pair = [pa.array(v.astype(np.int32)) for v in (np.minimum(own, other), np.maximum(own, other), own)]
                yield pa.RecordBatch.from_arrays([pa.array(s[row]), *pair, b.column("id").take(some), b.column("bits0").take(some), b.column("bits1").take(some)], names=["sig", "x", "y", "block", "id", "bits0", "bits1"])


def far(similarity: float) -> int:
    """Sketch bits in which a pair at the limit may differ: 3.3 standard deviations above the mean, which one such pair in 2,000 exceeds."""
    p = (1 - similarity) / 2
    return int(SKETCH * p + 3.3 * (SKETCH * p * (1 - p)) ** 0.5)


def _close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    d = np.bitwise_count(a[:, 0] ^ b[:, 0]).astype(np.uint8)
    return d + np.bitwise_count(a[:, 1] ^ b[:, 1]) <= most


def _pairs_of(bits: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within one group, as places in it, in strips of bounded size."""
    n = len(bits)
    strip = max(1, 2_000_000 // n)
    for lo in range(0, n, strip):
        x, y = bits[lo : lo + strip], bits[lo:]
        d = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0]).astype(np.uint8) + np.bitwise_count(x[:, None, 1] ^ y[None, :, 1])
        i, j = np.nonzero(d <= most)
        yield i[i < j] + lo, j[i < j] + lo


def _probed(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Candidates of the records of one task, which holds all records of each of its signatures, or of two blocks of a hot one."""
    t = gathered(rows)
    if t is None:
        return
    key = np.stack([t["sig"].to_numpy(), t["x"].to_numpy().astype(np.int64) << 32 | t["y"].to_numpy()], 1)
    ids, block = t["id"].to_numpy(), t["block"].to_numpy()
    bits = np.stack([t["bits0"].to_numpy(), t["bits1"].to_numpy()], 1).view(np.uint64)
    del t
    order = np.lexsort((key[:, 1], key[:, 0]))
    key, ids, block, bits = key[order], ids[order], block[order], bits[order]
    edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
    size = np.diff(edge)
    of, same = np.repeat(np.arange(len(size)), size), key[:, 1] >> 32 == key[:, 1] & 0xFFFFFFFF
    out = _Out()
    for k in range(1, 16):  # small groups, all at once: each record with the k-th after it
        i = np.flatnonzero((of[k:] == of[:-k]) & (size[of] <= 16)[:-k]) if k < len(of) else np.zeros(0, np.int64)
        # A pair within one block is found where the block meets itself only.
        i = i[(same[i] | (block[i] != block[i + k])) & _close(bits[i], bits[i + k], most)]
        yield from out.add(ids[i], ids[i + k])
    large = size > 16
    for lo, n in zip(edge[:-1][large].tolist(), size[large].tolist()):
        for i, j in _pairs_of(bits[lo : lo + n], most):
            i, j = i + lo, j + lo
            keep = same[lo] | (block[i] != block[j])
            yield from out.add(ids[i[keep]], ids[j[keep]])
    yield from out.end()


class _Out:
    """Gathers pairs into batches, least id first, each pair once a task."""

    def __init__(self) -> None:
        self.held, self.n = [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        apart = a != b  # a record delivered again is no pair
        a, b = a[apart], b[apart]
        if len(a):
            self.held.append((np.minimum(a, b), np.maximum(a, b)))
            self.n += len(a)
        if self.n > 500_000:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            both = np.unique(np.stack([np.concatenate([x[0] for x in self.held]), np.concatenate([x[1] for x in self.held])], 1), axis=0)
            self.held, self.n = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["id_a", "id_b"])


def _verified(rows: Iterator[pa.RecordBatch], width: int, similarity: float, least: int) -> Iterator[pa.RecordBatch]:
    runs = Runs(width)
    for b in rows:
        for lo in range(0, b.num_rows, 1000):
            part = b.slice(lo, 1000)
            (ra, sa), (rb, sb) = runs(part.column("text_a").to_pylist()), runs(part.column("text_b").to_pylist())
            na, nb = np.diff(sa), np.diff(sb)
            ka = np.repeat(np.arange(len(na), dtype=np.uint64), na)
            kb = np.repeat(np.arange(len(nb), dtype=np.uint64), nb)
            # Runs of one pair only meet each other: the pair's number is mixed into their hashes.
            shared, at, _ = np.intersect1d(_mix(ra + ka * np.uint64(0xD6E8FEB86659FD93)), _mix(rb + kb * np.uint64(0xD6E8FEB86659FD93)), assume_unique=True, return_indices=True)
            both = np.bincount(ka[at].astype(np.int64), minlength=len(na))
            either = na + nb - both
            ok = (na >= least) & (nb >= least) & (either > 0) & (both >= similarity * either - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in (part.column("id_a"), part.column("id_b"))] + [pa.array(both[ok] / either[ok])], names=["id_a", "id_b", "similarity"])


def signed(df: DataFrame, key: str, text: str, width: int, least: int) -> DataFrame:
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: _signed(it, width, least), "id long, class long, mins binary, bits0 long, bits1 long")


def near_duplicates(df: DataFrame, key: str, text: str, width: int = 5, similarity: float = 0.8, least: int = 1, miss: float = 0.002) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of the records whose sets of runs of `width` words have a Jaccard similarity of at least `similarity`.

    pairs: id_a < id_b, similarity, between representatives of classes, each pair once. members: id, class_id of every
    record with at least `least` runs, where class_id is the least key among the records of equal runs. A record
    delivered again is the same record. Empty tables give empty results; other columns are ignored.
    """
    spark = df.sparkSession
    if not 0 < miss < 1:
        raise ValueError("miss must be between 0 and 1, both excluded")
    base = staged(signed(df, key, text, width, least), "runs")
    n = base.count()
    multiple = base.groupBy("class").agg(F.min("id").alias("class_id"), F.max("id").alias("last")).where("class_id < last").drop("last")
    copies = staged(base.select("class", "id").join(multiple, "class").where("id <> class_id").select("id", "class_id").distinct(), "copies")
    copies_small = broadcast_if_small(copies)
    reps = base.join(copies_small, "id", "left_anti")
    members = base.select("id").distinct().join(copies_small, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))

    h = PARTS * POSITIONS

    def summed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], size: int) -> np.ndarray:
        """Counts by number over all records; as many as the numbers, so few enough for the driver."""
        total = np.zeros(size, np.int64)
        rows = base.mapInArrow(f, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
        total[rows["i"].to_numpy()] = rows["n"].to_numpy()
        return total

    values = summed(_common, h * BUCKETS).reshape(h, BUCKETS)
    mean = max(n, 1) / BUCKETS
    common = values > mean + 6 * mean**0.5
    order = grouped(summed(lambda it: _together(it, common), h * h).reshape(h, h), max(n, 1))
    moments = base.mapInArrow(lambda it: _moments(it, order), "part int, t int, bucket int, c long")
    squares = moments.groupBy("part", "t", "bucket").agg(F.sum("c").alias("c")).groupBy("part", "t").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("f2"))
    cost = {(p, t): 50.0 * n * (1, POSITIONS)[t] for p in range(PARTS) for t in (0, 1)}
    for r in squares.collect():  # PARTS * 2 rows
        cost[r.part, r.t] += max(0.0, r.f2 - n) / 2
    thresholds = allocate(cost, similarity, miss)

    slim = reps.select("id", "mins", "bits0", "bits1")
    none = np.zeros(0, np.int64)
    seen = slim.where(F.pmod(F.xxhash64("id"), F.lit(SEEN)) == 0).mapInArrow(lambda it: _filed(it, thresholds, order, none, none), FILED)
    large = seen.groupBy("sig").count().where(F.col("count") * SEEN > max(BLOCK // 2, n * sum(t + 2 for t in thresholds if t >= 0) // HOT))
    large = large.select("sig", F.ceil(F.col("count") * SEEN / BLOCK).alias("blocks")).orderBy("sig").toArrow()  # at most HOT rows
    hot = spark.sparkContext.broadcast((large["sig"].to_numpy(), large["blocks"].to_numpy()))
    filed = slim.mapInArrow(lambda it: _filed(it, thresholds, order, *hot.value), FILED)
    rows = n * sum((0, 1, POSITIONS)[t + 1] for t in thresholds)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 1_000_000))
    most = far(similarity)
    probed = filed.repartition(parts, "sig", "x", "y").mapInArrow(lambda it: _probed(it, most), "id_a long, id_b long")
    candidates = staged(probed.distinct(), "candidates")

    wanted = staged(candidates.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct(), "wanted")
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null")
    texts = once(texts.join(broadcast_if_small(wanted), "id", "left_semi"), "id", "text")
    both = candidates.join(texts.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a").join(texts.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b")
    pairs = both.mapInArrow(lambda it: _verified(it, width, similarity, least), "id_a long, id_b long, similarity double")
    return pairs, members


def components(edges: DataFrame) -> DataFrame:
    """u, v: every node of the graph (but the least of each component) with the least node of its component.

    Rounds of large and small stars: each node hands its larger neighbours, then its smaller ones, to its least one,
    until nothing changes; the rounds grow with the logarithm of the longest chain. Every round is staged.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = staged(edges.toDF("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = staged(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = staged(small.where("u <> v").distinct(), "edges")
        after = mark(edges)
        if after == before:
            return edges
        before = after


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """id, class_id, links, group_id of every record: its class of equal texts, how many other classes it is linked to, and
    the least class of all that links lead to."""
    pairs = staged(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    tied = ends.join(components(pairs.select("id_a", "id_b")).toDF("class_id", "group_id"), "class_id", "left")
    rows = members.join(broadcast_if_small(staged(tied, "tied")), "class_id", "left")
    return rows.select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "class_id").alias("group_id"))
