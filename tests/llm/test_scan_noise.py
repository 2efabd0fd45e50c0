import random

from folioscope.llm import scan_noise as sn

WORDS = "the committee shall publish particulars of every application within thirty days of receipt and maintain the register kept for that purpose under seal"


def sentences(r, n):
    words = WORDS.split()
    return [" ".join(r.choice(words) for _ in range(r.randint(8, 16))).capitalize() + "." for _ in range(n)]


def wrap(text, width=50):
    lines = [""]
    for w in text.split(" "):
        if len(lines[-1]) + len(w) + 1 > width:
            lines.append("")
        lines[-1] = (lines[-1] + " " + w).strip()
    return lines


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, body string, act string, ch string, ti string").selectExpr("*", "'x' as key", "1 as text", "2 as noise")


def test_noise_is_found_and_repaired(spark):
    r = random.Random(0)
    act = "Sulrell Village Courts Act, 1996"
    rows = [(i, "\n\n".join(" ".join(sentences(r, 3)) for _ in range(3)), act, "General", "Duties as to registers") for i in range(60)]
    rows.append((60, "The self-assessment shall publish. A self-assessment is of the register.", act, None, None))
    clean = {i: t for i, t, *_ in rows}
    want = {}
    for i in range(100, 130):
        text = " ".join(sentences(r, 12)) + " The self-assessment is kept."
        lines, out, noise = wrap(text), [], []
        for n, x in enumerate(lines):
            if n == 4:
                out += ["- 12 -", "SULRELL VILLAGE COURTS ACT"]
                noise += [(len(out) - 1, "page_number"), (len(out), "running_header")]
            if n == 2 and "committee" in x:
                x = x.replace("committee", "cornmittee", 1)
                noise.append((len(out) + 1, "misread"))
            if n == 6 and " register" in x:
                a, b = x.split(" register", 1)
                out.append(a + " regi-")
                noise.append((len(out), "broken_word"))
                x = "ster" + b
            out.append(x)
        rows.append((i, "\n".join(out), act, "General", None))
        want[i], clean[i] = noise, text
    rows += [rows[-1], (500, None, None, None, None), (501, "", None, None, None)]
    got = {x.k: x for x in sn.repair(table(spark, rows), "k", "body", "act", "ch", "ti").collect()}
    assert len(got) == len({x[0] for x in rows})
    for i, noise in want.items():
        assert sorted((x.line_no, x.kind) for x in got[i].noise) == sorted(noise), rows[i]
        assert got[i].text == clean[i]
    assert all(not got[i].noise and got[i].text == clean[i] for i in range(61))
    assert got[500].text is None and got[501].text == "" and not got[500].noise


def test_hyphen_of_the_word():
    model = sn.Model({"self-assessment": 5.0, "register": 50.0, "the": 90.0}, {})
    assert sn.joined(model, "self-", "assessment")[0] is False
    assert sn.joined(model, "self-assess-", "ment")[:2] == (True, "self-assessment")
    assert sn.joined(model, "regi-", "5ter") == (True, "regi5ter", "register")


def test_context_decides():
    words = {w: 100.0 for w in ("the", "form", "farm", "of", "a", "kept")} | {"form": 1000.0}
    model = sn.Model(words, {("the", "farm"): 90.0, ("farm", "kept"): 90.0, ("a", "form"): 900.0, ("form", "of"): 900.0})
    assert model.decode(["a", "form", "of"]) == ["a", "form", "of"]
    assert model.decode(["the", "f0rm", "kept"]) != ["the", "f0rm", "kept"]
    assert model.decode(["the", "zzz"]) == ["the", "zzz"]


def test_lines():
    for x in ("12", "- 140 -", "[7]", "Page 16", "xv", "  94 ", "- l9O -", "(xii)"):
        assert sn.is_page_number(x), x
    for x in ("12.", "vi.", "840;", "within 12 days", "mix", "l", ""):
        assert not sn.is_page_number(x), x
    titles = sn.Titles("Sulrell Village Courts Act, 1996")
    for x in ("SULRELL VILLAGE COURTS ACT", "  SULRFLL VILLAGE COURTS ACT", "THE GAZETTE OF SULRELL : EXTRAORDINARY", "Sulrell Village Courts Act            [Sec. 1   99", "Ch.] General", "Sulrell   1996   Department of Law"):
        assert titles.holds(x), x
    for x in ("The Sulrell Village Courts Act shall apply.", "(1) In every case", "A COURT", "In  every  case of doubt"):
        assert not titles.holds(x), x


def test_long_and_empty(spark):
    rows = [(1, "word " * 100_000, None, None, None)]
    assert len(sn.repair(table(spark, rows), "k", "body", "act", "ch", "ti").collect()) == 1
    assert sn.repair(table(spark, rows).limit(0), "k", "body", "act", "ch", "ti").count() == 0


def test_confusions_and_titles_that_no_list_holds(spark):
    """The scanner reads k for h, and the pages bear a title that has no form and is not the act's."""
    r = random.Random(7)
    act = "Sulrell Village Courts Act, 1996"
    rows = [(i, "\n\n".join(" ".join(sentences(r, 3)) for _ in range(3)), act, None, None) for i in range(80)]
    want = {}
    for i in range(100, 140):
        out, noise, text = [], [], " ".join(sentences(r, 12))
        for n, x in enumerate(wrap(text)):
            if n in (3, 9):
                out += ["", str(10 * i + n), "Proceedings of the lower house  " + str(i), ""]
                noise += [(len(out) - 2, "page_number"), (len(out) - 1, "running_header")]
            hit = [w for w in x.split() if "h" in w[1:]]
            if n % 5 == 2 and hit:
                w = r.choice(hit)
                x = x.replace(w, w[0] + w[1:].replace("h", "k", 1), 1)
                noise.append((len(out) + 1, "misread"))
            out.append(x)
        rows.append((i, "\n".join(out), act, None, None))
        want[i] = (noise, text)
    assert ("k", "h") not in sn.CONFUSIONS
    got = {x.k: x for x in sn.repair(table(spark, rows), "k", "body", "act", "ch", "ti").collect()}
    for i, (noise, text) in want.items():
        assert sorted((x.line_no, x.kind) for x in got[i].noise) == sorted(noise), rows[i - 20]
        assert got[i].text.split() == text.split()
    assert not any(got[i].noise for i in range(80))


def test_any_number_of_misread_places_in_words_of_any_length():
    long = "antidisestablishmentarianismcommissioner" + "s" * 30
    model = sn.Model({long: 9.0, "assessments": 9.0, "self": 9.0, "a": 1.0}, {}, dict.fromkeys(sn.CONFUSIONS, 0.2))
    assert model.decode([long.replace("i", "1").replace("ss", "5s", 1)]) == [long]
    assert model.decode(["a55e55mcnt5"]) == ["assessments"]
    assert model.decode(["a0" * 60_000]) == ["a0" * 60_000]


def test_alike_words_are_no_confusions(spark):
    """Words that differ by nature do so in trusted texts too."""
    counts = [("walk", 90, 0), ("talk", 80, 0), ("stock", 90, 0), ("lake", 70, 0), ("made", 99, 0)]
    counts += [("wolk", 0, 3), ("tolk", 0, 2), ("loke", 0, 2), ("mode", 1, 1)]  # o for a
    counts += [("wulk", 3, 0), ("tulk", 3, 0), ("luke", 3, 0), ("mude", 3, 0), ("stuck", 0, 2), ("tulke", 0, 1), ("muder", 0, 1)]
    df = spark.createDataFrame([(w, "", s, u) for w, s, u in counts] + [("walk", "talk", 5, 5)], "first string, second string, sure long, unsure long")
    assert sn.learned(df) == [("o", "a")]
    assert sn.learned(df.limit(0)) == []


def test_listed_confusions_keep_the_strokes():
    assert sn.left_out(sn.CONFUSIONS) == ""
    assert set("kx") <= set(sn.left_out([*sn.CONFUSIONS, ("k", "x")])) and not set("co") & set(sn.left_out([*sn.CONFUSIONS, ("k", "x")]))
    assert set("khbli1") <= set(sn.left_out([*sn.CONFUSIONS, ("k", "h")]))


def test_a_model_in_parts_gives_the_same(spark, monkeypatch):
    from folioscope.llm.common import table as load

    monkeypatch.setattr(sn, "GROUP", 25)
    rows = load(spark, "/root/testdata/sf0.001", "parsed_sections")
    show = lambda df: sorted((r.section_key, r.text or "", tuple(map(tuple, r.noise))) for r in df.collect())
    cols = ("section_key", "text", "act_name", "chapter", "section_title")
    whole = show(sn.repair(rows, *cols))
    assert show(sn.repair(rows, *cols, most=0)) == whole and sum(len(x[2]) for x in whole) > 20
