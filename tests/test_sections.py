import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.config import ParseConfig
from folioscope.functions import text as T
from folioscope.operators import sections as S

PAD = " It shall have effect according to its terms in every district."


def rows(spark, text):
    return spark.createDataFrame([("d", text)], "doc string, text string")


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_clean(spark):
    text = "  12 \n—\nx Extraordinary y\nkeep\t  this\nREGISTERED NO. 5\n\n\n\nend  "
    assert one(spark, text, T.clean) == "keep this\n\nend"


def test_heads(spark):
    text = f"Intro\n1. Short title.—A{PAD}\nmid 5. not.— a head{PAD}\nSection 4A. Four.–B{PAD}\n2.\nDefs.—C{PAD}"
    got = [(r.section_number, r.section_title) for r in S.spans(rows(spark, text)).where("pos >= 1").orderBy("pos").collect()]
    assert got == [("1", "Short title"), ("4A", "Four"), ("2", "Defs")]


def test_spans_equal_a_scan_for_matches(spark):
    pattern = re.compile(r"^(?:Section\s+)?(\d+[A-Z]?)\.\s+(.+?)\.[—–―-]", re.M)
    r = random.Random(0)
    parts = ["1. One.—a", "text 2. no.—b", "\n", "3.\n", "Section 7B. Seven. Eight.-c", "9. no dash.", "CHAPTER I\nTitle", "12. T.—", "\n"]
    for _ in range(40):
        text = "\n".join(r.choice(parts) for _ in range(12))
        ms = list(pattern.finditer(text))
        want = [(m[1].strip(), m[2].strip(), text[m.start() : n].strip()) for m, n in zip(ms, [x.start() for x in ms[1:]] + [len(text)])]
        got = [(x.section_number, x.section_title, x.span) for x in S.spans(rows(spark, text)).where("pos >= 1").orderBy("pos").collect()]
        assert got == want


def test_short_spans_and_chapters(spark):
    short, enough = "8. T.—" + "x" * 43, "9. T.—" + "x" * 44
    assert (len(short), len(enough)) == (49, 50)
    text = f"1. A.—{PAD}\nCHAPTER II\n  Of things \n{short}\n2. B.—{PAD}\nCHAPTER 3\n{enough}\n4. D.—{PAD}"
    got = S.fold_footnotes(S.with_chapters(S.spans(rows(spark, text)))).orderBy("pos").collect()
    assert [(r.section_number, r.chapter) for r in got] == [("1", "General"), ("2", "Of things"), ("9", "9. T.—" + "x" * 44), ("4", "9. T.—" + "x" * 44)]


NOTE = "7. 3rd May, 1987.— Ss. 4 to 9, vide notification No. S.O. 55(B), see Gazette of India, Extraordinary, Part IV, sec. 1(k)."


def test_footnote_goes_to_the_section_before(spark):
    text = f"{NOTE}\nlost, nothing before it\n1. A.—{PAD}  \n{NOTE}\n(5) goes on here\n{NOTE}\n3. C.—{PAD}"
    got = S.fold_footnotes(S.with_chapters(S.spans(rows(spark, text)))).orderBy("pos").collect()
    assert [r.section_number for r in got] == ["1", "3"]
    assert got[0].text == f"1. A.—{PAD}\n(5) goes on here"


def test_commencement(spark):
    text = f"1. Start.—This shall come into force on a day.{PAD}\n2. B.—{PAD}"
    count = lambda cfg: S.fold_footnotes(S.with_chapters(S.spans(rows(spark, text))), cfg=cfg).count()
    assert (count(ParseConfig()), count(ParseConfig(strict_footnotes=False))) == (1, 2)


def test_duplicates(spark):
    df = spark.createDataFrame(
        [("d", 1, "5", "1st May, 2001", "General", "x" * 99), ("d", 2, "5", "T", "General", "a" * 60), ("d", 3, "5", "T", "General", "b" * 90), ("d", 4, "5", "T", "General", "c" * 90), ("d", 5, "6", "2 May 2001", "General", "q"), ("d", 6, "6", "3 May 2001", "General", "qq")],
        "doc string, pos int, section_number string, section_title string, chapter string, text string",
    )
    got = {r.section_number: (r.pos, r.text) for r in S.dedupe_numbers(df).collect()}
    assert got == {"5": (1, "b" * 90), "6": (5, "q")}


def test_paragraphs(spark):
    got = S.paragraphs(rows(spark, "x" * 100 + "\n\n " + "y" * 101 + " \n\nshort")).collect()
    assert [(r.section_number, r.text) for r in got] == [("P1", "y" * 101)]
    assert S.paragraphs(rows(spark, f"1. A.—{PAD}\n\n" + "y" * 101)).count() == 0


def test_parse(spark):
    raw = spark.createDataFrame([("the_2019a_act", "rights", f"1. A.—{PAD}"), ("plain", "rights", "y" * 120), ("none", "rights", None), ("empty", "rights", "")], "path string, category string, text string")
    got = {r.path: r for r in S.parse_acts(raw).collect()}
    assert got.keys() == {"the_2019a_act", "plain"}
    a = got["the_2019a_act"]
    assert (a.act_name, a.short_name, a.citation, a.char_count) == ("The 2019A Act", "the_2019a_ac", "The 2019A Act › Section 1 › A", len(a.text))
    assert got["plain"].chapter == "Unknown"
    assert S.parse_acts(raw.limit(0)).count() == 0


@pytest.mark.parametrize("query,number", [("what is section 66 about", "66"), ("sec  12A", "12"), ("in 2019 or 7", "2019"), ("a 7 and 12345", None)])
def test_section_number(spark, query, number):
    assert one(spark, query, T.section_number) == number


def test_topics(spark):
    assert one(spark, "The current state", T.topics) == ["rent"]
    assert one(spark, "nothing", lambda c: T.topics(c, default=True)) == ["general"]
    assert one(spark, None, T.topics) == []
    assert one(spark, "EVICTION for rent and advance amount", T.topics) == ["security deposit", "lease termination", "rent"]
