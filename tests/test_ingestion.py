import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators import ingestion
from folioscope.sources import files
from folioscope.sources.store import Store
from folioscope.streaming.ingest import ingest_stream

PAD = " It shall have effect according to its terms in every district."


def section(number, text, source="a.json", key="a1", title="Duties"):
    return ("rights", "Act", 2000, "General", number, title, ["t"], text, f"cite {number}", len(text), "A", None, source, key)


DDL = "category string, act_name string, year int, chapter string, section_number string, section_title string, topics array<string>, text string, citation string, char_count int, short_name string, ministry string, source string, file_key string"


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    one = spark.createDataFrame([section("1", "x" * 90), section("2", "y" * 90), section("3", "z", title="Repeal of acts")], DDL)
    assert tuple(store.ingest(one).first()) == (1, 0, 1) and store.chunks.count() == store.vectors.count() == 2
    assert tuple(store.ingest(one).first()) == (0, 1, 1) and store.chunks.count() == 2
    changed = spark.createDataFrame([section("1", "x" * 91, key="a2"), section("7", "w" * 90, "b.json", "b1")], DDL)
    assert tuple(store.ingest(changed).first()) == (2, 0, 2)
    assert sorted((r.source, r.n) for r in store.rows_by_source().collect()) == [("a.json", 1), ("b.json", 1)]
    assert store.cache.count() == 4 and store.manifest.count() == 3
    assert store.vectors.join(store.chunks, "chunk_id").count() == 2
    assert tuple(store.ingest(one.limit(0)).first()) == (0, 0, 0)
    before = sorted(map(tuple, store.chunks.select("source", "chunk_id").collect()))
    store.compact()
    assert store.versions() == [3] and sorted(map(tuple, store.chunks.select("source", "chunk_id").collect())) == before
    assert store.cache.count() == 4 and store.vectors.count() == 2 and tuple(store.ingest(changed).first()) == (0, 2, 2)
    store.ingest(one, reset=True)
    assert store.manifest.count() == 1


def test_store_after_a_crash(spark, tmp_path, monkeypatch):
    """What was written without its marker is not there, and the next ingestion writes over it."""
    store = Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([section("1", "x" * 90)], DDL)
    more = spark.createDataFrame([section("2", "y" * 90, "b.json", "b1")], DDL)
    store.ingest(rows)
    written = []
    monkeypatch.setattr(store, "_path", lambda name, path=store._path: (_ for _ in ()).throw(OSError("lost")) if name == "commits/2" else path(name))
    try:
        store.ingest(more)
    except OSError:
        written.append(True)
    monkeypatch.undo()
    assert written and store.versions() == [1] and store.chunks.count() == store.manifest.count() == 1
    assert tuple(store.ingest(more).first()) == (1, 0, 1) and store.chunks.count() == 2


def test_fetch_documents(spark):
    def get(url):
        if "slow" in url:
            raise TimeoutError("no answer")
        return (404, "text/html", b"") if "gone" in url else (200, "application/pdf", url.encode())

    acts = spark.createDataFrame([("a", ["gone/1", "slow/1", "x/1"]), ("b", ["slow/2"]), ("c", []), ("d", None)], "k string, urls array<string>")
    got = {r.k: r for r in files.fetch(acts, "k", get).collect()}
    assert (got["a"].url, bytes(got["a"].content), got["a"].error) == ("x/1", b"x/1", None)
    assert got["b"].error == "slow/2: TimeoutError: no answer" and got["c"].error == got["d"].error == "no urls"
    assert sorted(r.k for r in files.failed_fetches(files.fetch(acts, "k", get), "k").collect()) == ["b", "c", "d"]


def test_pdf_pages():
    pytest.importorskip("pypdf")
    with pytest.raises(Exception):
        files.pdf_pages(b"no pdf")


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([section("1", "x" * 90), section("2", "y" * 90)], DDL).drop("file_key")
    rows.write.parquet(f"{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/store")
    for run in ("first", "first", "again"):
        ingest_stream(spark, f"{tmp_path}/in", store, f"{tmp_path}/{run}").awaitTermination()
        assert store.chunks.count() == 2 and store.manifest.count() == 1
    rows.withColumns({"source": F.lit("b.json"), "act_name": F.lit("B")}).write.mode("append").parquet(f"{tmp_path}/in")
    ingest_stream(spark, f"{tmp_path}/in", store, f"{tmp_path}/first").awaitTermination()
    assert sorted((r.source, r.n) for r in store.rows_by_source().collect()) == [("a.json", 2), ("b.json", 2)]


def test_documents(spark, tmp_path):
    for name, body in (("rights/the_act.pdf", b"page one\f\fpage two"), ("cyber/bad.pdf", b"\xff\xfe"), ("cyber/no.txt", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {r.path: r for r in files.scan_documents(spark, str(tmp_path), files.text_pages).collect()}
    assert got.keys() == {"the_act", "bad"}
    assert (got["the_act"].category, got["the_act"].text, got["the_act"].source) == ("rights", "page one\npage two", "the_act.pdf")
    assert got["bad"].text is None and "UnicodeDecodeError" in got["bad"].error
    assert got["the_act"].file_key.startswith("rights/the_act.pdf:")


def test_sections_as_json(spark, tmp_path):
    folder = tmp_path / "parsed" / "rights"
    folder.mkdir(parents=True)
    (folder / "act_a.json").write_text(json.dumps([{"act_name": "A", "section_number": "66C", "topics": ["x"], "text": "é"}, {"act_name": "A", "section_number": "P1"}], ensure_ascii=False))
    rows = files.read_sections(spark, str(tmp_path / "parsed"))
    assert sorted((r.category, r.source, r.path, r.section_number, r.text) for r in rows.collect()) == [("rights", "act_a.json", "act_a", "66C", "é"), ("rights", "act_a.json", "act_a", "P1", None)]
    files.write_sections(rows, str(tmp_path / "out"))
    again = spark.read.json(str(tmp_path / "out"))
    assert again.count() == 2 and again.select("category").distinct().first()[0] == "rights"
    files.write_sections(rows.unionByName(rows.withColumn("section_number", F.lit("9"))).coalesce(1), str(tmp_path / "lines"))
    back = files.read_sections(spark, str(tmp_path / "lines"))
    assert sorted((r.category, r.section_number) for r in back.collect()) == [("rights", "66C"), ("rights", "9"), ("rights", "9"), ("rights", "P1")]


def test_fetch(spark):
    df = spark.createDataFrame([("a", 1, "u1", 404, "application/pdf"), ("a", 2, "u2", 200, "text/html"), ("a", 3, "u3", 200, "Application/PDF"), ("a", 4, "u4", 200, "application/octet-stream"), ("b", 1, "v1", 500, None)], "k string, pos int, url string, status int, content_type string")
    got = files.first_fetched(df, "k")
    assert {r.k: r.url for r in got.collect()} == {"a": "u3", "b": None}
    assert {r.ok: r.n for r in files.fetch_summary(got).collect()} == {True: 1, False: 1}


def test_ids(spark):
    df = spark.range(500).selectExpr("id % 7 as a", "id as b").unionByName(spark.createDataFrame([(3, 3)] * 5, "a long, b long"))
    got = ingestion.assign_ids(df, ["a", "b"], 10, "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(10, 515)) and [(r.a, r.b) for r in got] == sorted((r.a, r.b) for r in got)
    assert ingestion.assign_ids(df.limit(0), ["a", "b"]).count() == 0


def test_defaults(spark):
    rows = spark.createDataFrame([("x",), ("y",)], "k string")
    meta = spark.createDataFrame([("x", "Known")], "k string, name string")
    got = files.with_defaults(rows, meta, "k", {"name": F.upper("k")})
    assert sorted((r.k, r.name) for r in got.collect()) == [("x", "Known"), ("y", "Y")]
