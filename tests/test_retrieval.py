from collections import Counter
from math import exp, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.config import Config, FusionConfig, RouteConfig
from folioscope.functions.embed import from_batches, hashing, pairs_from_batches
from folioscope.operators import evaluation, fusion, lexical, routing, vectors
from folioscope.plans.retrieve import contexts, nearest_texts, retrieve

DOCS = {1: "the court shall hear the appeal", 2: "the appeal lies to the high court court", 3: "", 4: "a bail bond", 5: None, 6: "the the the"}


def okapi(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = {k: (t or "").split() for k, t in docs.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(t for x in toks.values() for t in set(x))
    idf = {t: log(n - d + 0.5) - log(d + 0.5) for t, d in df.items()}
    low = eps * sum(idf.values()) / len(idf)
    idf = {t: low if v < 0 else v for t, v in idf.items()}
    return {k: sum(idf[t] * x.count(t) * (k1 + 1) / (x.count(t) + k1 * (1 - b + b * len(x) / avg)) for t in query.split() if t in x) for k, x in toks.items()}


@pytest.fixture(scope="module")
def index(spark):
    return lexical.build(spark.createDataFrame(list(DOCS.items()), "doc long, text string"), "doc", "text")


def test_bm25(spark, index):
    asked = {10: "court appeal", 11: "court court appeal", 12: "the bond", 13: "unknown"}
    q = spark.createDataFrame(list(asked.items()), "q long, t string")
    got = {(r.query, r.doc): r.score for r in lexical.scores(index, q, "q", "t").collect()}
    for k, t in asked.items():
        for d, s in okapi(DOCS, t).items():
            assert got.get((k, d), 0.0) == pytest.approx(s)
    top = {}
    for r in lexical.top_k(index, q, "q", "t", 3).orderBy("rank").collect():
        top.setdefault(r["query"], []).append(r.doc)
    assert top == {k: [d for d, _ in sorted(okapi(DOCS, t).items(), key=lambda x: (-x[1], x[0]))[:3]] for k, t in asked.items()}


def test_z_scores(spark, index):
    q = spark.createDataFrame([(1, "court appeal")], "q long, t string")
    s = np.array(list(okapi(DOCS, "court appeal").values()))
    for r in lexical.z_scores(index, *lexical.scores_and_moments(index, q, "q", "t")).collect():
        z = (okapi(DOCS, "court appeal")[r.doc] - s.mean()) / (s.std() + 1e-6)
        assert (r.z, r.squashed) == pytest.approx((z, 1 / (1 + exp(-z))))


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_knn(spark, metric):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    rows = [(i, [float(v) for v in r], "ab"[i % 2]) for i, r in enumerate(x)] + [(900, None, "a"), (901, [1.0] * 7, "a"), (902, [float("nan")] * 8, "a")]
    df = spark.createDataFrame(rows, "id long, v array<float>, cat string")
    q = df.where("id % 50 = 0").withColumn("cat", F.when(F.col("id") > 0, F.col("cat")))
    got = {}
    for r in vectors.knn(df, q, "id", "v", "id", "v", 4, metric, "cat", dim=8).orderBy("rank").collect():
        got.setdefault(r["query"], []).append((r.id, r.distance))
    x = x.astype(np.float32).astype(float)
    for i in range(0, 300, 50):
        d = ((x - x[i]) ** 2).sum(1) if metric == "l2sq" else 1 - x @ x[i] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i])
        ok = [j for j in range(300) if i == 0 or j % 2 == i % 2]
        want = sorted(ok, key=lambda j: (round(d[j], 9), j))[:4]
        assert [a for a, _ in got[i]] == want and [b for _, b in got[i]] == pytest.approx(d[want], abs=1e-9)


def test_route(spark):
    p = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [0.0, 1.0]), ("c", 2, [0.0, 1.0])], "category string, pos int, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, [-1.0, 0.1]), (3, [0.0, 2.0]), (4, [0.5, 3**0.5 / 2 * -1])], "query_id long, vector array<double>")
    got = {r.query_id: r for r in routing.route(routing.route_scores(q, p)).collect()}
    assert {k: r.category for k, r in got.items()} == {1: "a", 2: None, 3: "b", 4: "a"}
    assert [x.category for x in got[3].all_scores] == ["b", "c", "a"] and got[4].confidence == 0.5


def test_intents(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.74, 0.80, 0.76, 0.75])] + [(2, 0, 0.49)], "query_id long, pos int, score double")
    got = [(r.query_id, r.pos) for r in routing.nearest_in_score(df, RouteConfig()).orderBy("rank").collect()]
    assert got == [(1, 1), (1, 2)]


def test_context_without_intents(spark):
    q = spark.createDataFrame([(1, "q")], "query_id long, query string")
    routed = spark.createDataFrame([(1, None, 0.1)], "query_id long, category string, confidence double")
    none = spark.createDataFrame([], "query_id long, intent string, anchors array<string>, score double, rank int")
    r = routing.context(q, routed, none).first()
    assert (r.expanded_query, r.intents, r.anchors, r.confidence) == ("q", [], [], 0.0)


def test_features(spark):
    df = spark.createDataFrame([("stolen bike", "Theft of a bike", "x", "x", ["y"], ["The Bike Act, 5"], "bike act"), ("stolen", None, "x", "z", ["x ray"], [], "a"), ("q", "t", None, "z", [], None, "")], "q string, t string, asked string, cat string, topics array<string>, anchors array<string>, act string")
    c = F.col
    got = df.select(fusion.title_overlap(c("q"), c("t")), fusion.category_bonus(c("asked"), c("cat"), c("topics")), fusion.anchor_bonus(c("anchors"), c("act"))).collect()
    assert [tuple(r) for r in got] == [(0.02, 0.10, 0.15), (-0.05, 0.03, 0.0), (-0.05, 0.0, 0.0)]


def test_finish(spark):
    df = spark.createDataFrame([(1, i, "A", "1" if i < 2 else str(i), 9.0 - i) for i in range(5)], "query_id long, id long, act_name string, section_number string, final_score double")
    ids = lambda cfg: [r.id for r in fusion.finish(df, 3, "id", cfg=cfg).orderBy("rank").collect()]
    assert ids(FusionConfig()) == [0, 2] and ids(FusionConfig(dedupe_before_limit=True)) == [0, 2, 3]


def test_metrics(spark):
    results = spark.createDataFrame([(1, 1, "The B Act", "9"), (1, 4, "The A Act", "5"), (2, 2, "the b act", "1")], "query_id long, rank int, act_name string, section_number string")
    gold = spark.createDataFrame([(1, "primary", "a act", "5"), (1, "secondary", "B ACT", ""), (2, "primary", "a act", ""), (2, "secondary", "b act", "1")], "query_id long, kind string, act string, section string")
    cases = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    rows = evaluation.outcomes(results, gold, cases)
    assert {r.query_id: (r.strict_rank, r.relaxed_rank) for r in rows.collect()} == {1: (4, 4), 2: (None, 2), 3: (None, None)}
    m = {r.kind: r for r in evaluation.metrics(rows).collect()}
    assert (m["strict"].hit_5, m["strict"].mrr, m["relaxed"].hit_3, m["relaxed"].mrr) == (1, 0.0833, 1, 0.25)


def test_embedders(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "B a"), (3, ""), (4, None)], "id long, t string")
    got = {r.id: r.v for r in df.select("id", hashing(16)(F.col("t")).alias("v")).collect()}
    assert got[1] == got[2] and sum(x * x for x in got[1]) == pytest.approx(1) and set(got[3]) == set(got[4]) == {0.0}
    lengths = from_batches(lambda ts: np.array([[len(t)] for t in ts]))
    assert [r.v for r in df.select(lengths(F.col("t")).alias("v")).collect()] == [[3.0], [3.0], [0.0], [0.0]]


def test_cascade(spark):
    """The whole cascade against a loop over the same parts."""
    docs = [(i, f"the court hears appeal number {i} on bail", f"Bail {i}", f"Act {i % 5}", str(i), "criminal" if i % 2 else "family") for i in range(40)]
    chunks = spark.createDataFrame([(i, t, "c", n, ti, None, a, None, 2000, cat, "s", []) for i, t, ti, a, n, cat in docs], "doc long, text string, citation string, section_number string, section_title string, chapter string, act_name string, short_name string, year int, category string, source string, topics array<string>")
    store = chunks.select("doc", "category", hashing(64)(F.col("text")).alias("embedding"))
    q = spark.createDataFrame([(1, "bail appeal number 7", "bail appeal number 7", [], "criminal", []), (2, "court", None, None, None, None)], "query_id long, original_query string, expanded_query string, intents array<string>, category string, anchors array<string>")
    got = retrieve(q, chunks, store, Config(), top_k=5).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {1, 2} and all(r.category == "criminal" for r in got if r.query_id == 1)
    assert [r.rank for r in got if r.query_id == 1] == [1, 2, 3, 4, 5] and got[0].doc == 7
    scores = [r.final_score for r in got if r.query_id == 1]
    assert scores == sorted(scores, reverse=True)
    keys = [(r.query_id, r.act_name, r.section_number) for r in got]
    assert len(keys) == len(set(keys))
    assert retrieve(q.withColumn("category_filter", F.lit("family")), chunks, store, top_k=3).where("category <> 'family'").count() == 0
    assert retrieve(q, chunks, store, min_score=99.0).count() == 0


def test_contexts(spark):
    q = spark.createDataFrame([(1, "bail bond of the accused"), (2, "zzz")], "query_id long, query string")
    p = spark.createDataFrame([("criminal", 0, "accused bail bond"), ("family", 1, "deed of adoption")], "category string, pos int, prototype string")
    i = spark.createDataFrame([("bail_application", "criminal", ["Act A"], "bail bond", ["bail of the accused"], 0), ("theft", "criminal", ["Act B"], "stolen goods", ["theft"], 1)], "intent string, category string, anchors array<string>, prototype string, examples array<string>, pos int")
    got = {r.query_id: r for r in contexts(q, p, i).collect()}
    assert (got[1].category, got[1].intents, got[1].anchors, got[1].expanded_query) == ("criminal", ["bail_application"], ["Act A"], "bail bond of the accused bail application")
    assert (got[2].category, got[2].intents, got[2].expanded_query) == (None, [], "zzz")


def test_probe_and_saved_index(spark, index, tmp_path):
    store = spark.createDataFrame([(1, "x", "bail bond"), (2, "x", "deed of adoption"), (3, "y", "bail")], "doc long, category string, t string").select("doc", "category", hashing(64)(F.col("t")).alias("embedding"))
    q = spark.createDataFrame([(1, "bail")], "query_id long, query string")
    assert [r.doc for r in nearest_texts(q, store, 2).orderBy("rank").collect()] == [3, 1]
    assert [r.doc for r in nearest_texts(q, store, 2, "x").orderBy("rank").collect()] == [1, 2]
    lexical.save(index, f"{tmp_path}/bm25")
    again = lexical.load(spark, f"{tmp_path}/bm25")
    asked = spark.createDataFrame([(1, "court appeal")], "q long, t string")
    rows = lambda i: sorted(tuple(r) for r in lexical.top_k(i, asked, "q", "t", 4).collect())
    assert rows(again) == rows(index)


def test_pairs_in_batches(spark):
    df = spark.createDataFrame([("a b", "b"), (None, "x"), ("c", None)] * 7, "q string, d string")
    sizes = lambda pairs: [len(q) + 10 * len(d) + 100 * (len(pairs) > 8) for q, d in pairs]
    got = df.select(pairs_from_batches(sizes)(F.col("q"), F.col("d")).alias("v")).collect()
    assert sorted(r.v for r in got) == [1.0] * 7 + [10.0] * 7 + [13.0] * 7


def test_leaks_and_pass(spark):
    results = spark.createDataFrame([(1, "A", "5", "x"), (1, "B", "6", "y"), (2, "C", "7", "y")], "query_id long, act_name string, section_number string, category string")
    cases = spark.createDataFrame([(1, "x"), (2, None)], "query_id long, category_filter string")
    assert [(r.act_name, r.section_number, r.category) for r in evaluation.leaked_results(results, cases).collect()] == [("B", "6", "y")]
    rows = spark.createDataFrame([(1, 2), (2, None)], "query_id long, strict_rank int")
    assert [tuple(evaluation.passed(x).first()) for x in (rows, rows.where("query_id = 1"), rows.limit(0))] == [(2, 1, False), (1, 0, True), (0, 0, True)]


def test_scores_of_all_pairs_are_not_staged(spark, monkeypatch):
    kept = {}

    def counted(df, name, write=lexical.staged):
        out = write(df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(lexical, "staged", counted)
    docs = {i: f"the court hears {'the ' * (i % 7)}case {i % 50}" for i in range(500)}
    asked = {k: f"court the {k}" for k in range(40)}
    index = lexical.build(spark.createDataFrame(list(docs.items()), "doc long, text string"), "doc", "text")
    found, stats = lexical.scores_and_moments(index, spark.createDataFrame(list(asked.items()), "q long, t string"), "q", "t")
    got = {(r.query, r.doc): r.z for r in lexical.z_scores(index, found, stats).collect()}
    assert len(got) == 500 * 40 and max(kept.values()) < len(got) / 10, kept
    for k in (0, 39):
        s = okapi(docs, asked[k])
        mean, std = np.mean(list(s.values())), np.std(list(s.values()))
        assert [got[k, d] for d in docs] == pytest.approx([(s[d] - mean) / (std + 1e-6) for d in docs], abs=1e-7)
