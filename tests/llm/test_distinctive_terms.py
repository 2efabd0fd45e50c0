import re
from collections import Counter
from math import log

import pytest

from folioscope.llm import distinctive_terms as dt


def test_matches_brute_force(spark):
    texts = {1: "alpha alpha alpha beta gamma", 2: "beta gamma delta delta", 3: "Alpha beta gammas", 4: None, 5: "", 6: "tiny x " * 20_000}
    rows = [*texts.items(), (1, texts[1]), (None, "alpha")]
    df = spark.createDataFrame(rows, "k long, body string").selectExpr("*", "'a' as term", "2 as df", "0 as key", "'b' as text")
    tf = {k: Counter(re.findall("[a-z]{4,}", (t or "").lower())) for k, t in texts.items()}
    total = Counter(x for c in tf.values() for x in c.elements())
    n = sum(total.values())
    want = {}
    for k, c in tf.items():
        m = sum(c.values())
        for t, a in c.items():
            cells = ((a, total[t], m), (total[t] - a, total[t], n - m), (m - a, n - total[t], m), (n - total[t] - m + a, n - total[t], n - m))
            g = 2 * sum(x * log(x * n / (r * s)) for x, r, s in cells if x > 0)
            want[k, t] = (a, sum(t in d for d in tf.values()), round(g if a * n >= total[t] * m else -g, 6))
    got = {(r.k, r.term): (r.tf, r.df, round(r.score, 6)) for r in dt.distinctive_terms(df, "k", "body", "[a-z]{4,}").collect()}
    assert got == want
    some = dt.distinctive_terms(df, "k", "body", "[a-z]{4,}", min_tf=2, min_df=1, max_df=1).collect()
    assert {(r.k, r.term) for r in some} == {(k, t) for (k, t), v in want.items() if v[0] >= 2 and v[1] == 1}
    assert dt.distinctive_terms(df.limit(0), "k", "body").count() == 0


def test_queries_score_every_term(spark, monkeypatch):
    from pyspark.sql import functions as F

    from folioscope.llm import queries

    from ..compare import DATA

    texts = {r.chunk_key: r.text for r in spark.read.parquet(f"{DATA}/chunks.parquet").select("chunk_key", "text").collect()}
    pairs = {(k, t) for k, x in texts.items() for t in re.findall("[a-z]{5,}", (x or "").lower())}
    scored = queries.p7_scores(spark, DATA).collect()
    assert {(r.chunk_key, r.term) for r in scored} == pairs and len(scored) == len(pairs)
    assert all(r.score is not None for r in scored) and {r.tf for r in scored} >= {1, 2, 3}
    found = {tuple(r) for r in queries.p7_found(spark, DATA).collect()}
    assert found == {(r.chunk_key, r.term) for r in scored if r.tf >= 3 and 2 <= r.df <= 12}
    monkeypatch.setattr(dt, "log_likelihood", lambda *_: F.raise_error(F.lit("the score is evaluated")).cast("double"))
    with pytest.raises(Exception, match="the score is evaluated"):
        queries.p7_found(spark, DATA).collect()
