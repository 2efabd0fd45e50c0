"""Subject areas of documents, by propagating labels over a graph of documents and the phrases they share.

Documents that share a distinctive phrase are alike in what they are about; instead of an edge for each such pair,
the graph has the phrase as a hub, linked to each of its documents. A phrase (a word or two adjacent words) is
distinctive, and its links are verified, if the lower bound of the share of one subject among its labelled
documents is high enough. The phrases are chosen once, from the labels given. The links are a table of (document,
sentence, phrase), kept by document; labels go over it by joins and sums, `rounds` times, and nothing but the list of
subjects comes to the driver:

* from documents to phrases: a phrase's distribution over the subjects is that of its documents, known so far;
* from phrases to documents: a sentence deals with the subject for which its phrases speak most, if they speak
  clearly; a document's shares are those of its sentences (of at least LEAST_WORDS words; shorter ones are headings and
  numbers and count on neither side), and it has every subject of at least `share` of them: one, several or none;
* seeds are clamped: a labelled document keeps its labels while its own sentences bear them out. A label that they
  do not bear out is not trusted, and the document takes what its sentences say.

The phrases of a text are looked up in a broadcast table of phrases while it has at most `most` rows; beyond that the
words and pairs of the texts are joined with it, which gives the same links.

The subjects' prototypes and terms count as PROTOTYPE labelled documents each. A label is matched to a subject without regard to
case, white space, hyphens and underscores; labels of no known subject are left out, null labels say "none".
Nulls, empty and blank texts have no subject. A document delivered again counts once; equal texts under different
ids are documents of their own. Equal scores go to the subject first in order. Empty tables give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, kept_by, once, staged

#: Words are runs of [a-z], with single hyphens between letters. In ASCII texts all else but the ends of sentences becomes blank.
LETTERS = "".join(c if c.islower() or c in "-\n" else " " for c in map(chr, range(128)))
LOOSE = re.compile(r"-(?:(?<![a-z]-)|(?![a-z]))")
#: Scripts whose vowel signs are marks, which \w does not hold: words are runs of their letters and marks.
MARKED = re.compile(r"[a-z]+(?:-[a-z]+)*|[ऀ-ॣ०-෿]+|[^\W\d_]+")
#: (?<![\s.])[.?!।]+\s+|\n+, with its first character in front: the search skips to it.
SENTENCE = re.compile(r"[.?!।\n](?:(?<=\n)\n*|(?<![\s.][.?!।])[.?!।]*\s+)")
LEAST_WORDS = 3
#: Two of two documents will do for a link; what the documents labelled later do not bear out falls to CLEAR.
PURE, CLEAR = 0.34, 0.65
PROTOTYPE = 4


def _ignored() -> str:
    """A class of the accents (but not the marks of Indic scripts) and invisible characters of the basic plane."""
    code = [i for i in range(0x80, 0xD800) if (k := unicodedata.category(chr(i))) == "Cf" or k == "Mn" and not 0x900 <= i <= 0xDFF] + [*range(0xFE00, 0xFE10), 0xFEFF]
    return "[" + "".join(f"\\u{i:04x}" for i in code) + "]+"


IGNORED = re.compile(_ignored())


def plain(text: str) -> str:
    """Lower case, without accents and invisible characters."""
    if text.isascii():
        return text.lower()
    return IGNORED.sub("", unicodedata.normalize("NFKD", text).lower())


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence of at least LEAST_WORDS words."""
    if not text:
        return []
    t = plain(text)
    if not t.isascii():
        return [w for w in map(MARKED.findall, SENTENCE.split(t)) if len(w) >= LEAST_WORDS]
    t = SENTENCE.sub("\n", t).translate(LETTERS)
    if "-" in t:
        t = LOOSE.sub(" ", t)
    return [w for s in t.split("\n") if len(w := s.split()) >= LEAST_WORDS]


def subject_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)[\s_\-]+", "")


def _counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the labelled documents: (phrase, subject, documents), all documents under the subject ''."""
    count: dict[str, Counter[str]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for s, of in count.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(of)), pa.array([s] * len(of)), pa.array(list(of.values()))], names=["phrase", "subject", "n"])
        count.clear()

    for b in rows:
        for text, labels in zip(b.column("text").to_pylist(), b.column("labels").to_pylist()):
            found: set[str] = set()
            for w in sentences(text):
                found.update(w)
                found.update(map(" ".join, pairwise(w)))
            for s in ("", *(labels or ())):
                count.setdefault(s, Counter()).update(found)
        if sum(map(len, count.values())) > 1_000_000:
            yield from flush()
    yield from flush()


def _linked(rows: Iterator[pa.RecordBatch], phrases: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """key, sentences (of the document), sentence, phrase: each different phrase of each sentence; first: of the document."""
    number_of = {tuple(p.split(" ")) if " " in p else p: i for p, i in phrases.items()}
    single = {p for p in phrases if " " not in p}
    pairs = number_of.keys() - single
    for b in rows:
        keys, totals, number, at, hits, first = [], [], [], [], [], []
        for k, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
            all_ = sentences(text)
            n, seen = 0, set()
            for i, w in enumerate(all_):
                found = [number_of[x] for x in (*single.intersection(w), *pairs.intersection(pairwise(w)))]
                if found:
                    hits += found
                    at += [i] * len(found)
                    n += len(found)
                    first += [x not in seen for x in found]
                    seen.update(found)
            keys.append(k)
            totals.append(len(all_))
            number.append(n)
        number = np.array(number, np.int64)
        own = (np.repeat(np.array(x, np.int64), number) for x in (keys, totals))
        yield pa.RecordBatch.from_arrays([pa.array(next(own)), pa.array(next(own).astype(np.int32)), pa.array(at, pa.int32()), pa.array(hits, pa.int32()), pa.array(first, pa.bool_())], names=["key", "sentences", "sentence", "phrase", "first"])


def _phrases(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for all phrases, by their text."""
    for b in rows:
        for k, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
            all_, seen = sentences(text), set()
            for i, w in enumerate(all_):
                found = list({*w, *map(" ".join, pairwise(w))})
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int64()), pa.array([len(all_)] * n, pa.int32()), pa.array([i] * n, pa.int32()), pa.array(found, pa.string()), pa.array([x not in seen for x in found], pa.bool_())], names=["key", "sentences", "sentence", "name", "first"])
                seen.update(found)


def lower_bound(n: Column, of: Column, z: float = 1.96) -> Column:
    """Wilson's lower bound of a share."""
    p = n / of
    return (p + z * z / (2 * of) - z * F.sqrt((p * (1 - p) + z * z / (4 * of)) / of)) / (1 + z * z / of)


def subjects_of(
    docs: DataFrame, labels: DataFrame, areas: DataFrame, key: str = "doc_id", text: str = "text", subject: str = "subject", share: float = 0.25, rounds: int = 2, most: int = 200_000
) -> DataFrame:
    """key, subject, share of the document's sentences, for shares of at least `share`.

    docs: key, text. labels: key, subject. areas: subject, prototype, hindi_terms. Up to `most` phrases are broadcast.
    """
    known = areas.where(F.col(subject).isNotNull()).select(F.col(subject).alias("subject"), subject_key(F.col(subject)).alias("_k"))
    given = labels.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), subject_key(F.col(subject)).alias("_k")).join(F.broadcast(known), "_k", "left")
    # A document is labelled "none" by null labels only; a label of no known subject says nothing.
    given = given.where(F.col("subject").isNotNull() | F.col("_k").isNull()).groupBy("key").agg(F.array_sort(F.collect_set("subject")).alias("labels"))
    given = staged(given, "labels")
    rows = once(docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")), "key", "text")
    rows = staged(rows.where("text is not null").join(broadcast_if_small(given), "key", "left"), "documents")
    prototypes = areas.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(PROTOTYPE)))).select(F.explode(F.concat(F.array("prototype"), F.coalesce("hindi_terms", F.array().cast("array<string>")))).alias("text"), F.array(subject).alias("labels"))
    seeds = rows.where("labels is not null").select("text", "labels").unionByName(prototypes.where("text is not null"))

    counts = seeds.mapInArrow(_counted, "phrase string, subject string, n long").groupBy("phrase", "subject").agg(F.sum("n").alias("n"))
    top = counts.groupBy("phrase").agg(F.max(F.when(F.col("subject") != "", F.col("n"))).alias("n"), F.max(F.when(F.col("subject") == "", F.col("n"))).alias("docs"))
    top = staged(top.where(F.col("n").isNotNull() & (lower_bound(F.col("n"), F.col("docs")) >= PURE)), "phrases")
    # Two words say nothing more where one of them is distinctive alone.
    clear = top.where(~F.col("phrase").contains(" ") & (F.col("n") >= 0.8 * F.col("docs"))).select("phrase")
    clear = broadcast_if_small(clear)
    pairs = top.where(F.col("phrase").contains(" ")).withColumns({"a": F.split_part("phrase", F.lit(" "), F.lit(1)), "b": F.split_part("phrase", F.lit(" "), F.lit(2))})
    pairs = pairs.join(clear.withColumnRenamed("phrase", "a"), "a", "left_anti").join(clear.withColumnRenamed("phrase", "b"), "b", "left_anti").drop("a", "b")
    chosen = staged(top.where(~F.col("phrase").contains(" ")).unionByName(pairs).select(F.col("phrase").alias("name"), F.monotonically_increasing_id().alias("id")), "chosen")
    n = chosen.count()
    kind = "key long, sentences int, sentence int"
    if n <= most:
        table = chosen.orderBy("name").toArrow()  # bounded by `most`
        shared = docs.sparkSession.sparkContext.broadcast({p: i for i, p in enumerate(table["name"].to_pylist())})
        numbers = docs.sparkSession.createDataFrame(list(shared.value.items()), "name string, phrase int") if n else chosen.toDF("name", "phrase")
        hits = rows.select("key", "text").mapInArrow(lambda it: _linked(it, shared.value), kind + ", phrase int, first boolean")
    else:
        numbers = chosen.toDF("name", "phrase")
        hits = rows.select("key", "text").mapInArrow(_phrases, kind + ", name string, first boolean").join(numbers, "name").drop("name")
    hits = kept_by(hits, "key", "links")

    # The prototypes are clamped seeds of every round.
    own = prototypes.where("text is not null").mapInArrow(_counted, "name string, subject string, n long").where("subject <> ''").groupBy("name", "subject").agg(F.sum("n").cast("double").alias("w"))
    own = staged(own.join(broadcast_if_small(numbers), "name").select("phrase", "subject", "w"), "prototypes")
    links = hits.where("first").select("key", "phrase")
    names = sorted(r.subject for r in known.select("subject").distinct().collect())
    number = F.array_position(F.lit(names), F.col("x.subject")).cast("int")
    # What is known of documents: their subjects with weights; a null one for "none", no row for nothing known.
    state = given.select("key", F.col("labels").alias("kept"))
    for i in range(rounds + 1):
        weight = F.lit(1.0) / F.greatest(F.size("kept"), F.lit(1))
        spoken = broadcast_if_small(staged(state.select("key", F.explode_outer("kept").alias("subject"), weight.alias("w")), "spoken"))
        mass = links.join(spoken, "key").groupBy("phrase", "subject").agg(F.sum("w").alias("w")).unionByName(own)
        mass = mass.groupBy("phrase", "subject").agg(F.sum("w").alias("w"))
        speaks = mass.groupBy("phrase").agg(F.max(F.when(F.col("subject").isNotNull(), F.struct("w", "subject"))).alias("x"), F.sum("w").alias("total"))
        p = F.col("x.w") / F.col("total")
        # At most one subject of a phrase can be that clear.
        speaks = staged(speaks.where(p >= CLEAR).select("phrase", number.alias("subject"), (0.5 + F.ln(p / (1.02 - p))).alias("w")), "weights")
        judged = staged(_judged(hits, speaks, names, share), "judged")
        if i < rounds:
            state = _clamped(judged, given)
    return judged.select(F.col("key").alias(key), F.explode("subjects").alias("x")).select(key, "x.subject", "x.share")


def _judged(hits: DataFrame, speaks: DataFrame, names: list[str], least: float) -> DataFrame:
    """key, subjects: those with at least `least` of the sentences, with their shares. hits are kept by key, so none of the sums moves them.

    speaks: phrase, subject (its number in names, from 1), w.
    """
    heard = hits.join(broadcast_if_small(speaks), "phrase").groupBy("key", "sentences", "sentence", "subject").agg(F.sum("w").alias("w"))
    # The score to six decimals and the subject in one number, so that its largest value is the first of the best.
    scored = (F.round(F.col("w") * 1e6).cast("long") * F.lit(1 << 16) + (F.lit((1 << 16) - 1) - F.col("subject"))).alias("x")
    best = heard.select("key", "sentences", "sentence", scored).groupBy("key", "sentences", "sentence").agg(F.max("x").alias("x"))
    subject = (F.lit((1 << 16) - 1) - F.col("x").bitwiseAND((1 << 16) - 1)).cast("int").alias("subject")
    shares = best.select("key", "sentences", subject).groupBy("key", "sentences", "subject").agg(F.count("*").alias("n"))
    shares = shares.select("key", F.element_at(F.lit(names or [""]), F.col("subject")).alias("subject"), (F.col("n") / F.col("sentences")).alias("share"))
    many = F.sort_array(F.collect_list(F.when(F.col("share") >= least, F.struct("subject", "share"))))
    return shares.groupBy("key").agg(many.alias("subjects"))


def _clamped(judged: DataFrame, given: DataFrame) -> DataFrame:
    """Seeds with a label that their sentences bear out keep their labels; all others take their sentences' subjects."""
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    rows = judged.select("key", F.transform("subjects", lambda x: x["subject"]).alias("subjects")).join(broadcast_if_small(given), "key", "left")
    return rows.select("key", F.when(F.size(F.array_intersect("subjects", labels)) > 0, labels).otherwise(F.col("subjects")).alias("kept"))
