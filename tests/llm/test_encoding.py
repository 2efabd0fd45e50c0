import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import encoding as en

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    e = en.Encoder(en.default_ranks())
    return e, tiktoken.Encoding("own", pat_str=en.PATTERN, mergeable_ranks=e.ranks, special_tokens={})


def test_any_text(both):
    e, t = both

    @given(st.one_of(st.text(max_size=200), st.text(alphabet="ab' \n\t\x1c\x85s2é<|>endoftx", max_size=200)))
    @settings(max_examples=300, deadline=None)
    def run(text):
        text = text.encode("utf-8", "replace").decode()
        assert e(text).tolist() == t.encode_ordinary(text)

    run()


def test_long_parts(both):
    e, t = both
    for text in ("a" * 5000, "ab" * 3000, "विधि" * 800, "x" * 70 + "y" * 70, "\n" * 3000, "  <|endoftext|>  "):
        assert e(text).tolist() == t.encode_ordinary(text)


def test_part_of_one_million_characters_ends():
    e = en.Encoder(en.default_ranks())
    text = "abcdefgh" * 25_000
    ids = e(text)
    back = {v: k for k, v in e.ranks.items()}
    assert b"".join(back[i] for i in ids.tolist()) == text.encode()


def test_table(spark, both):
    rows = [(1, "No. 5 it's"), (1, "No. 5 it's"), (2, None), (3, ""), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, body string").selectExpr("*", "'a' as ids", "1 as k", "2 as t")
    got = en.encode(df, "doc_id", "body")
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    out = sorted(((r.doc_id or 0), list(r.ids)) for r in got.collect())
    ids = both[1].encode_ordinary
    assert out == [(0, ids("x")), (1, ids(rows[0][1])), (1, ids(rows[0][1])), (2, []), (3, [])]
    assert en.encode(df.limit(0), "doc_id", "body").count() == 0


def test_lists():
    assert en.lists([np.array([1, 2], np.int32), np.zeros(0, np.int32)], en.pa.int32()).to_pylist() == [[1, 2], []]
