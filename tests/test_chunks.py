from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.config import ChunkConfig
from folioscope.functions.text import sentences
from folioscope.operators import chunks as C


def pieces(spark, *texts, cfg=ChunkConfig()):
    return [r.p for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", C.pieces(F.col("t"), cfg).alias("p")).orderBy("i").collect()]


def test_limits(spark):
    a, b = "x" * 1200, "y" * 1201
    assert pieces(spark, a, b, "z" * 40, "") == [[a], [b], ["z" * 40], [""]]


def test_long_sentence_stands_alone(spark):
    s = ["A" * 99 + ".", "B" * 1300 + ".", "C" * 99 + ".", "D" * 100 + "."]
    assert pieces(spark, " ".join(s)) == [[s[0], s[1], s[2] + " " + s[3]]]


def test_short_tail_is_dropped(spark):
    s = ["A" * 1190 + ".", "B" * 70 + "."]
    assert pieces(spark, " ".join(s)) == [[s[0]]]


@given(st.lists(st.text(alphabet='Ab.;— \n("', max_size=120), min_size=1, max_size=12))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_pieces_are_packed_sentences(spark, texts):
    """Put together the pieces are the sentences; each fits or is one sentence; none could have taken the next sentence too."""
    cfg = ChunkConfig(max_chars=30, min_chars=0)
    split = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", sentences(F.col("t")).alias("s")).orderBy("i").collect()
    for t, got, row in zip(texts, pieces(spark, *texts, cfg=cfg), split):
        if len(t) <= 30:
            assert got == [t]
            continue
        assert " ".join(got) == " ".join(row.s)
        left = list(row.s)
        for p in got:
            own = []
            while left and len(" ".join(own)) < len(p):
                own.append(left.pop(0))
            assert " ".join(own) == p and (len(p) <= 30 or len(own) == 1)
            assert not left or len(p) > 30 or len(left[0]) > 30 or len(p) + 1 + len(left[0]) > 30


def test_short_pieces_are_left_out(spark):
    text = "Aaaa. Bb bb bb bb bb bb bb bb bb b. C. " + "D" * 40 + ". Ee."
    every, long = (pieces(spark, text, cfg=ChunkConfig(max_chars=30, min_chars=n))[0] for n in (0, 6))
    assert long == [x for x in every if len(x) >= 6] and len(long) < len(every)


def test_records(spark):
    df = spark.createDataFrame([("A, 1999", "5", "T", None, None, 1999, None, None, "Aa. " * 400, "cite", 7)], "act_name string, section_number string, section_title string, chapter string, short_name string, year int, category string, source string, text string, citation string, key int")
    rows = C.chunk_sections(df, keep=("key",)).orderBy("chunk_index").collect()
    assert [(r.citation, r.total_chunks) for r in rows] == [("cite (part 1/2)", 2), ("cite (part 2/2)", 2)]
    assert rows[0].text.startswith("Section 5 T\n\nAa. Aa.") and rows[0].category == "general" and rows[0].source == "" and len(rows[0].chunk_id) == 64
    assert C.chunk_sections(df.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_sentences(spark):
    got = spark.createDataFrame([('One. Two; "Three"? (four) five. six ! Seven',)], "t string").select(sentences(F.col("t")).alias("s")).first().s
    assert got == ["One.", "Two;", '"Three"?', "(four) five. six !", "Seven"]
