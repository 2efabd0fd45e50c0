import random

from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import splitting as sp


def check(text, limit=1200, overlap=150, least=400):
    cuts = sp.split(text, limit, overlap, least)
    assert "".join(text[b:e] for _, b, e in cuts) == text
    assert all(e - a <= limit and 0 <= b - a <= overlap for a, b, e in cuts)
    assert all(e > b for _, b, e in cuts) or not text
    return cuts


@given(st.text(alphabet=st.sampled_from("ab .\ń\U0001f600;"), max_size=3000))
@settings(max_examples=60, deadline=None)
def test_pieces_make_up_the_text(text):
    check(text, 120, 15, 40)


def test_boundaries_and_local_edits():
    r = random.Random(0)
    text = "\n\n".join(" ".join(f"word{r.randrange(500)}" for _ in range(r.randint(20, 60))) + "." for _ in range(60))
    cuts = check(text)
    assert all(text[:e].endswith("\n\n") for _, _, e in cuts[:-1])
    edited = text[:9000] + "an edit " + text[9000:]
    old = {text[b:e] for _, b, e in cuts}
    new = {edited[b:e] for _, b, e in check(edited)}
    assert len(new - old) <= 4


def test_no_boundary():
    assert len(check("x" * 100_000)) > 80


def test_table(spark):
    rows = [(1, "a " * 1000), (1, "a " * 1000), (2, "b" * 1200), (3, None), (None, "c " * 1000), (4, ""), (5, "d" * 1201)]
    df = spark.createDataFrame(rows, "k long, body string").selectExpr("*", "9 as chunk_index", "'t' as text", "0 as key")
    out = sp.split_oversized(df, "k", "body").collect()
    assert {r.k for r in out} == {1, 5}
    for k in (1, 5):
        ps = sorted((r for r in out if r.k == k), key=lambda r: r.chunk_index)
        assert [p.chunk_index for p in ps] == list(range(ps[0].total_chunks))
        assert "".join(p.text[p.overlap :] for p in ps) == dict(rows)[k]
    assert sp.split_oversized(df.limit(0), "k", "body").count() == 0
