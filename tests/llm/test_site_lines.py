import random
import re

import numpy as np
import pyarrow as pa

from folioscope.llm import site_lines as sl


def norm(x):
    return " ".join(re.sub(r"\d+", "0", x).lower().split())


def brute(rows, least, share):
    docs, where, occ = {}, {}, []
    for k, s, t in {r[0]: r for r in rows if r[1] is not None and r[0] is not None}.values():
        docs[s] = docs.get(s, 0) + 1
        for i, x in enumerate((t or "").split("\n"), 1):
            if i > 1 and norm(x):
                where.setdefault((s, norm(x)), set()).add(k)
                occ.append((k, i, s, norm(x)))
    ok = {x for x, ks in where.items() if len(ks) >= least and len(ks) >= share * docs[x[0]]}
    return {(k, i) for k, i, s, x in occ if (s, x) in ok}


def data(seed=0):
    r = random.Random(seed)
    rows = []
    for k in range(400):
        source = r.choice(["hot", "hot", "a", "b", "few", None])
        body = [f"own line {k} {j} {r.random()}".replace(".", " x") for j in range(3)]
        if r.random() < 0.3:
            body.insert(r.randrange(3), f"  Printed  at PAGE {r.randrange(99)} of {source} ")
        if r.random() < 0.09:
            body.append("almost a tenth")
        if r.random() < 0.12:
            body.append("just over\ta tenth  here")
        rows.append((k, source, r.choice([None, ""]) if r.random() < 0.03 else "Heading\n\n" + "\n".join(body)))
    return rows


def test_matches_brute_force(spark):
    rows = data()
    df = spark.createDataFrame(rows + rows[:20], "k long, src string, body string").selectExpr("*", "1 as key", "'z' as source", "'y' as line", "7 as parts")
    got = [(r.k, r.line_no) for r in sl.repeated_lines(df, "k", "src", "body", 10, 0.1).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 10, 0.1)


def test_small_summaries_and_early_flushes_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(sl, "CAPACITY", 8)
    monkeypatch.setattr(sl, "HELD", 60)
    rows = data(3)
    parts = [list(sl._summaries(iter([b]), 0.1)) for b in batches(rows)]
    assert len(parts) > 3
    df = spark.createDataFrame(rows, "k long, src string, body string").repartition(7)
    assert {(r.k, r.line_no) for r in sl.repeated_lines(df, "k", "src", "body", 10, 0.1).collect()} == brute(rows, 10, 0.1)


def batches(rows):
    for lo in range(0, len(rows), 50):
        some = [(s, [hash(x) for x in (t or "").split("\n")]) for _, s, t in rows[lo : lo + 50] if s]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in some]), pa.array([x for _, x in some], pa.list_(pa.int64()))], names=["source", "lines"])


def test_removed(spark):
    rows = data(1)
    df = spark.createDataFrame(rows, "k long, src string, body string").selectExpr("*", "'x' as removed_lines")
    found = brute(rows, 10, 0.1)
    got = {r.k: r.body for r in sl.without_repeated(df, "k", "src", "body").collect()}
    for k, _, t in rows:
        assert got[k] == (t if t is None else "\n".join(x for i, x in enumerate(t.split("\n"), 1) if (k, i) not in found))


def test_merged_summaries_never_undercount_by_more_than_they_say():
    r = random.Random(2)
    true, parts = {}, []
    for p in range(8):
        s = sl.Summary(np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
        for i in range(500):
            lines = sorted({1 if r.random() < 0.15 else 10_000 + 500 * p + i, 100 + r.randrange(3000), -500 * p - i - 1})
            for x in lines:
                true[x] = true.get(x, 0) + 1
            s.merge(sl.Summary(np.array(lines), np.ones(len(lines), np.int64), 1), 0.1)
        parts.append(s)
    for order in (parts, parts[::-1]):
        whole = sl.Summary(np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
        for s in order:
            whole.merge(s, 0.1)
        got = dict(zip(whole.line.tolist(), whole.count.tolist()))
        assert whole.docs == 4000 and len(got) < 0.7 * len(true) and whole.lost <= 0.1 * whole.docs / 4
        assert all(got.get(x, 0) <= c <= got.get(x, 0) + whole.lost for x, c in true.items())


def test_empty(spark):
    assert sl.repeated_lines(spark.createDataFrame([], "k long, s string, t string"), "k", "s", "t").count() == 0
