import random

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import near_duplicates as nd
from folioscope.llm.queries import record_pairs


def runs(text, width):
    words = nd.WORD.findall(text.lower()) if text else []
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, similarity, least):
    sets = {k: runs(t, width) for k, t in rows}
    keys = sorted(k for k, s in sets.items() if len(s) >= least)
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                out.add((a, b))
    return out


def corpus(n=60, seed=0):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = [r.choice(words) for _ in range(r.randint(60, 140))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(r.randint(0, 3)):
            x = list(base)
            for _ in range(r.randint(0, 6)):
                p = r.randrange(len(x))
                x[p : p + 1] = r.choice([[], [r.choice(words)], [x[p], r.choice(words)]])
            rows.append((len(rows), " ".join(x)))
    return rows


@pytest.mark.parametrize("width,similarity", [(3, 0.6), (5, 0.8)])
def test_all_pairs(spark, width, similarity):
    rows = corpus()
    rows += [(1000, rows[0][1]), (1001, rows[0][1].upper()), (1002, None), (1003, ""), (1004, "one two three"), rows[3]]
    df = spark.createDataFrame(rows, "k long, text string").selectExpr("k", "text", "'x' as id", "1 as class")
    pairs, members = nd.near_duplicates(df, "k", "text", width, similarity, 20)
    got = {(r[0], r[1]) for r in record_pairs(pairs, members).collect()}
    assert got == brute(dict(rows).items(), width, similarity, 20)
    groups = {r.id: r for r in nd.groups(pairs, members).collect()}
    assert groups[1000].class_id == groups[1001].class_id == 0
    assert not {1002, 1003, 1004} & groups.keys()


def test_hot_signature(spark, monkeypatch):
    """Many near copies of one text: more than a block shares each signature."""
    monkeypatch.setattr(nd, "BLOCK", 16)
    monkeypatch.setattr(nd, "SEEN", 1)
    r = random.Random(3)
    base = [f"w{r.randrange(300)}" for _ in range(120)]
    rows = []
    for i in range(60):
        x = list(base)
        x[r.randrange(len(x))] = f"u{i}"
        rows.append((i, " ".join(x)))
    df = spark.createDataFrame(rows, "k long, text string")
    pairs, members = nd.near_duplicates(df, "k", "text", 3, 0.6, 20)
    got = [(x[0], x[1]) for x in record_pairs(pairs, members).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3, 0.6, 20)


def test_tasks_of_a_hot_signature_are_bounded():
    """A million records of one signature: the pieces in which they meet hold two blocks each, and every pair of blocks meets once."""
    n, size = 1_000_000, nd.BLOCK
    order = np.arange(nd.PARTS * nd.POSITIONS)
    mins = np.zeros((1, nd.PARTS * nd.POSITIONS), np.uint16)
    thresholds = [0] + [-1] * (nd.PARTS - 1)
    sig = nd.variants(mins, 0, 0, order)[0].view(np.int64)
    blocks = -(-n // size)
    b = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([mins.tobytes()] * 2000, pa.binary()), pa.array([0] * 2000), pa.array([0] * 2000)], names=["id", "mins", "bits0", "bits1"])
    out = pa.Table.from_batches(list(nd._filed(iter([b]), thresholds, order, sig, np.array([blocks]))))
    assert out.num_rows == 2000 * blocks
    meets = {}
    for x, y, own, i in zip(*(out[c].to_pylist() for c in ("x", "y", "block", "id"))):
        assert own in (x, y) and 0 <= x <= y < blocks
        meets.setdefault((x, y), []).append(i)
    assert max(map(len, meets.values())) <= 8 * max(1, 2 * 2000 // blocks) + 8


def test_small_groups_of_two_blocks():
    rows = [(5, 0, 1, i % 2, i) for i in range(6)] + [(5, 0, 0, 0, i) for i in (0, 2, 4)] + [(5, 1, 1, 1, i) for i in (1, 3, 5)]
    sig, x, y, block, ids = zip(*rows)
    t = pa.RecordBatch.from_arrays([pa.array(sig), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(block, pa.int32()), pa.array(ids), pa.array([0] * 12), pa.array([0] * 12)], names=["sig", "x", "y", "block", "id", "bits0", "bits1"])
    got = [p for b in nd._probed(iter([t]), 3) for p in zip(b["id_a"].to_pylist(), b["id_b"].to_pylist())]
    assert sorted(got) == [(i, j) for i in range(6) for j in range(i + 1, 6)]


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(45)] + [(7, 7)]
    root = {}
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if find(x) != x}
    got = {x.u: x.v for x in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert nd.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_correlated_positions_form_a_partition():
    h, n = nd.PARTS * nd.POSITIONS, 10_000
    together = np.full((h, h), n * 0.01 * 0.01)
    np.fill_diagonal(together, n * 0.01)
    for own in ((3, 40, 71), (0, 20, 55)):
        for i in own:
            for j in own:
                together[i, j] = n * (0.2 if i == j else 0.18)
    order = nd.grouped(together, n)
    parts = {tuple(sorted(order[i : i + nd.POSITIONS].tolist())) for i in range(0, h, nd.POSITIONS)}
    assert {(3, 40, 71), (0, 20, 55)} <= parts and sorted(order.tolist()) == list(range(h))


def test_miss_of_zero_is_refused(spark):
    with pytest.raises(ValueError, match="miss"):
        nd.near_duplicates(spark.createDataFrame([], "k long, text string"), "k", "text", miss=0.0)


def test_empty(spark):
    pairs, members = nd.near_duplicates(spark.createDataFrame([], "k long, text string"), "k", "text")
    assert pairs.count() == 0 and members.count() == 0


def test_allocation_meets_the_bound():
    cost = {(p, t): float((p % 5 + 1) * (1, 30)[t]) for p in range(nd.PARTS) for t in (0, 1)}
    chosen = nd.allocate(cost, 0.6, 0.002)
    miss = np.prod([1 - nd.chance(0.6, t) for t in chosen if t >= 0])
    assert miss <= 0.002 * 1.3 and set(chosen) <= {-1, 0, 1}
    assert sum(c >= 0 for c in chosen) < nd.PARTS or 1 in chosen or miss > 1e-4


def test_long_text():
    run, start = nd.Runs(3)(["a b c " * 50_000, "x"])
    assert len(run) == 3 and start.tolist() == [0, 3, 3]
