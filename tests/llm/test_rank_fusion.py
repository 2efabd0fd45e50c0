import random
from math import comb

from folioscope.llm import rank_fusion as rf


def brute(rows, n):
    groups = {}
    for g, i, *s in rows:
        groups.setdefault(g, {})[i] = s
    out = {}
    for g, items in groups.items():
        size = len(items)
        key = lambda v: float("-inf") if v is None else v
        res = []
        for i, s in items.items():
            ranks = [sum(key(o[j]) >= key(s[j]) for o in items.values()) for j in range(n)]
            r = sorted(x / size for x in ranks)
            p = min(sum(comb(n, m) * r[k - 1] ** m * (1 - r[k - 1]) ** (n - m) for m in range(k, n + 1)) for k in range(1, n + 1))
            res.append((round(min(1.0, n * p), 12), sum(ranks), i))
        out[g] = [x[2] for x in sorted(res)]
    return out


def data(n=300, seed=1, groups=6):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((r.randrange(groups), i, r.random(), r.choice([r.uniform(-5, 400), 0.0]), r.choice([None, r.gauss(0, 3)])))
    return rows


DDL = "size long, significance long, semantic double, position double, total double"


def test_matches_brute_force(spark):
    rows = data()
    df = spark.createDataFrame(rows + rows[:9] + [(None, 1, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0)], DDL).selectExpr("*", "1 as g", "2 as item")
    df = df.withColumnRenamed("position", "lexical").withColumnRenamed("significance", "doc")
    got = {}
    for r in rf.aggregate_ranks(df, "size", "doc", ["semantic", "lexical", "total"]).orderBy("size", "position").collect():
        got.setdefault(r["size"], []).append(r["doc"])
        assert r.position == len(got[r["size"]])
    assert got == brute(rows, 3)


def test_hot_group_gives_the_same(spark):
    rows = data(400, 2, 2)
    df = spark.createDataFrame(rows, "q long, d long, a double, b double, c double")
    one = rf.aggregate_ranks(df, "q", "d", ["a", "b", "c"]).collect()
    two = rf.aggregate_ranks(df, "q", "d", ["a", "b", "c"], hot_rows=20).collect()
    show = lambda rs: sorted((r.q, r.d, round(r.significance, 12), r.position) for r in rs)
    assert show(one) == show(two)


def test_nan_and_empty(spark):
    df = spark.createDataFrame([(1, 1, float("nan"), 1.0), (1, 2, 0.1, 2.0)], "q long, d long, a double, b double")
    assert [r.d for r in rf.aggregate_ranks(df, "q", "d", ["a", "b"]).orderBy("position").collect()] == [2, 1]
    assert rf.aggregate_ranks(df.limit(0), "q", "d", ["a", "b"]).count() == 0


def test_hot_group_of_ties(spark):
    """Half of a hot group shares one significance, and a score is missing everywhere."""
    rows = [(1, i, float(i % 3), None if i % 2 else float(i), None) for i in range(300)] + [(2, 7, 1.0, None, None)]
    df = spark.createDataFrame(rows, "q long, d long, a double, b double, c double")
    one, two = ({(r.q, r.d): r.position for r in rf.aggregate_ranks(df, "q", "d", ["a", "b", "c"], **x).collect()} for x in ({}, {"hot_rows": 20}))
    assert one == two and sorted(v for (q, _), v in two.items() if q == 1) == list(range(1, 301))
