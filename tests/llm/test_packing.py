import random

import numpy as np
import pyarrow as pa

from folioscope.llm import encoding as en
from folioscope.llm import packing as pk


def test_table(spark):
    r = random.Random(0)
    words = "the court shall hear any appeal within thirty days of the order made by tribunal at headquarters".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([5, 40, 90, 150])))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "appeal " * 700), (1003, "order " * 256), (1004, rows[0][1])]
    df = spark.createDataFrame(rows, "d long, body string").selectExpr("*", "'a' as key", "1 as tokens", "2 as container", "'c' as text")
    out = pk.pack(df, "d", "body", capacity=256, shard=150).collect()
    e = en.Encoder(en.default_ranks())
    size = {k: len(e(t)) for k, t in rows}
    used, seen = {}, {}
    for x in out:
        seen.setdefault(x.d, []).append(x)
        assert (x.container is None) == (x.tokens == 0)
        if x.container is not None:
            used[x.container] = used.get(x.container, 0) + x.tokens
    assert seen.keys() == size.keys()
    for k, ps in seen.items():
        ps.sort(key=lambda x: x.piece)
        assert sum(p.tokens for p in ps) == size[k] and [p.first for p in ps] == [p.piece * 256 for p in ps]
        assert len(ps) == max(1, -(-size[k] // 256))
    assert max(used.values()) <= 256
    assert len(used) <= 1.08 * sum(size.values()) / 256 + 3
    again = pk.pack(df.orderBy(en.F.desc("d")), "d", "body", capacity=256, shard=150).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)
    assert pk.pack(df.limit(0), "d", "body").count() == 0


def test_neighbours_share_a_container():
    """Two kinds of items with no common tokens: containers are of one kind, but for the rest at the end."""
    size = np.array([30] * 40)
    kinds = [np.array([1, 2, 3]) + 10 * (i % 2) for i in range(40)]
    box = pk.fill(size, kinds, [np.array([1, 1, 1])] * 40, 100)
    mixed = sum(len({i % 2 for i in np.flatnonzero(box == b)}) > 1 for b in range(box.max() + 1))
    assert (box >= 0).all() and mixed <= 1 and np.bincount(box).max() <= 3


def test_everything_fits_somewhere():
    r = np.random.default_rng(0)
    for _ in range(20):
        n = int(r.integers(1, 60))
        size = r.integers(1, 101, n)
        terms = [np.unique(r.integers(0, 30, 8)) for _ in range(n)]
        box = pk.fill(size, terms, [np.ones(len(t)) for t in terms], 100)
        assert (box >= 0).all() and np.bincount(box, weights=size).max() <= 100


def test_shards_by_the_most_telling_token():
    count = np.array([0, 5, 90, 3, 0, 250, 4, 100, 1])
    first, number = pk.shards_of(count, 100)
    assert number.tolist() == [1, 1, 1, 1, 1, 3, 1, 1, 1]
    load = {}
    for t in np.flatnonzero(count):
        for i in range(number[t]):
            load.setdefault(int(first[t]) + i, []).append(int(t))
    assert load == {0: [1, 2, 3], 1: [5], 2: [5], 3: [5], 4: [6], 5: [7], 6: [8]}
    terms, tf = pa.array([[1, 2], [], [2, 3]], pa.list_(pa.int32())), pa.array([[3, 1], [], [1, 1]], pa.list_(pa.int32()))
    assert pk.telling(terms, tf, np.array([9.0, 1.0, 2.0, 2.0])).tolist() == [1, -1, 2]


def test_a_seed_is_asked_with_all_its_tokens():
    """The only likeness of seed and neighbour is one token among hundreds, and a hundred others are less like it."""
    size = np.array([60] + [40] * 101)
    terms = [np.arange(300)] + [np.array([7, 1000 + i]) for i in range(100)] + [np.arange(290, 300)]
    box = pk.fill(size, terms, [np.ones(len(t)) for t in terms], 100)
    assert box[0] == box[101]
