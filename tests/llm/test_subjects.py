import random
import re
import time

import pyarrow as pa

from folioscope.llm import subjects as sb

AREAS = {"river_law": "ferry master,boat permit,harbour dues,tide table", "school_law": "head teacher,class register,exam paper,school meal", "farm_law": "seed grain,cattle pound,plough share,harvest tax"}
GENERAL = ["the office shall keep the record in good order", "any notice is sent by post within ten days", "the fee is paid at the counter before noon"]


def document(r, subjects, n=12, other=None):
    out = []
    for i in range(n):
        if i % 2 and subjects:
            out.append(f"the {r.choice(AREAS[r.choice(subjects)].split(','))} is named in the order of the day")
        else:
            out.append(r.choice(GENERAL))
    if other:
        out.append(f"a {AREAS[other].split(',')[0]} came by on that day")
    return ". ".join(out).capitalize() + "."


def tables(spark, seed=0, docs=300):
    r = random.Random(seed)
    names = list(AREAS)
    rows, labels, truth = [], [], {}
    for i in range(docs):
        s = r.choice([[], *[[x] for x in names] * 3, r.sample(names, 2)])
        truth[i] = set(s)
        t = document(r, s, 24 if len(s) > 1 else 12, other=r.choice([x for x in names if x not in s]) if r.random() < 0.3 else None)
        rows.append((i, r.choice([str.upper, str, str])(t)))
        if r.random() < 0.4:
            given = s if r.random() > 0.05 else [r.choice(names)]
            labels += [(i, x.upper().replace("_", " ")) for x in given] or [(i, None)]
    rows += [(900, None), (901, ""), (902, "  \n "), rows[0]]
    labels += [(5, "no such subject"), (None, names[0]), (9999, names[0])]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as subject", "1 as share", "2 as key")
    areas = spark.createDataFrame([(k, f"Matters such as {v.replace(',', ', ')}.", None) for k, v in AREAS.items()], "subject string, prototype string, hindi_terms array<string>")
    return d, spark.createDataFrame(labels, "doc_id long, subject string"), areas, truth


def test_held_out_accuracy(spark):
    d, labels, areas, truth = tables(spark)
    got = {}
    for x in sb.subjects_of(d, labels, areas).collect():
        assert x.share >= 0.25
        got.setdefault(x.doc_id, set()).add(x.subject)
    right = sum(got.get(i, set()) == t or len(t) > 1 and got.get(i, set()) & t == got.get(i) for i, t in truth.items())
    assert right >= 0.97 * len(truth) and not {900, 901, 902} & got.keys()


def test_prototypes_alone(spark):
    d, labels, areas, truth = tables(spark)
    got = {}
    for x in sb.subjects_of(d, labels.limit(0), areas).collect():
        got.setdefault(x.doc_id, set()).add(x.subject)
    one = [i for i, t in truth.items() if len(t) == 1]
    assert sum(got.get(i) == truth[i] for i in one) >= 0.9 * len(one)


def test_empty(spark):
    d, labels, areas, _ = tables(spark, docs=5)
    assert sb.subjects_of(d.limit(0), labels, areas).count() == 0
    assert sb.subjects_of(d, labels, areas.limit(0)).count() == 0


def test_sentences():
    assert sb.sentences("Café costs, in Lamsorn. Ok.\nNo one-off​ fee 12 is due") == [["cafe", "costs", "in", "lamsorn"], ["no", "one-off", "fee", "is", "due"]]
    assert sb.sentences("समिति विवाह के विषय में।") == [["समिति", "विवाह", "के", "विषय", "में"]]
    assert sb.sentences(None) == sb.sentences("  ") == []


WORD = re.compile(r"[a-z]+(?:-[a-z]+)*")
END = re.compile(r"(?<![\s.])[.?!।]+\s+|\n+")


def defined(text):
    """sentences() by the patterns that define it."""
    t = sb.plain(text)
    find = WORD.findall if t.isascii() else sb.MARKED.findall
    return [w for w in map(find, END.split(t)) if len(w) >= sb.LEAST_WORDS]


def test_sentences_are_as_defined():
    r = random.Random(1)
    for i in range(20_000):
        text = "".join(r.choices("abzA.- \n?!।\t\r\x0b\x1c\x1f{`~™é़क_1'\u200b\x85", k=r.randint(1, 30)))
        text = text.encode("ascii", "ignore").decode() if i % 2 else text
        assert sb.sentences(text) == defined(text), repr(text)


def test_sentences_take_less_time_than_their_definition():
    r = random.Random(2)
    texts = [document(r, list(AREAS), 60) for _ in range(200)]

    def took(f):
        began = time.process_time()
        for t in texts:
            f(t)
        return time.process_time() - began

    assert min(took(sb.sentences) for _ in range(7)) < 0.75 * min(took(defined) for _ in range(7))


def test_linked_phrases_are_those_of_each_sentence():
    phrases = {x: i for i, x in enumerate(["boat", "boat permit", "harbour dues", "the tide", "one-off fee"])}
    texts = ["The boat permit and the boat. Of the tide.\nThe one-off fee is a boat", "Harbour. Dues of the harbour-dues", None, "Harbour dues, harbour dues"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], names=["key", "text"])
    got = sorted(tuple(x.values()) for b in sb._linked(iter([rows]), phrases) for x in b.to_pylist())
    assert got == [(0, 3, 0, 0, True), (0, 3, 0, 1, True), (0, 3, 1, 3, True), (0, 3, 2, 0, False), (0, 3, 2, 4, True), (3, 1, 0, 2, True)]


def test_phrases_joined_or_broadcast_give_the_same(spark):
    d, labels, areas, _ = tables(spark, docs=80)
    show = lambda df: sorted((x.doc_id, x.subject, round(x.share, 9)) for x in df.collect())
    assert show(sb.subjects_of(d, labels, areas, most=0)) == show(sb.subjects_of(d, labels, areas)) != []


def test_sums_by_document_move_no_rows(spark):
    """The links lie in buckets by document, so judging documents needs no shuffle."""
    links = sb.kept_by(spark.createDataFrame([(1, 2, 0, 5), (1, 2, 1, 5), (2, 1, 0, 6)], "key long, sentences int, sentence int, phrase long"), "key", "links")
    speaks = spark.createDataFrame([(5, 1, 1.0), (6, 2, 1.0)], "phrase long, subject int, w double")
    judged = sb._judged(links, speaks, ["a", "b"], 0.25)
    assert {r.key: [tuple(x) for x in r.subjects] for r in judged.collect()} == {1: [("a", 1.0)], 2: [("b", 1.0)]}
    assert "Exchange hashpartitioning" not in judged._jdf.queryExecution().executedPlan().toString()
