"""Repair of text from scanned pages, by a noisy-channel model.

Page furniture (page numbers, running headers) is told by its form, by the section's own titles, and by repetition: a
line that stands again and again beside the page numbers of an act, its numbers aside, is a running title there. A word
broken at the end of a line is joined with its rest, which may stand beyond a page break, unless the hyphen belongs to
the word: then the word stands with it elsewhere in the table. Misread words are found by a noisy channel: for
each word of a line the candidates are the known words that its characters may have come from, by the fewest misread
places, sought along the known words' beginnings; a candidate's likelihood is the product of its characters'
confusion probabilities, its prior an interpolated bigram model of the corpus; Viterbi decodes the line. The counts of
the model are those of the whole table; the words of texts that show no line breaks within sentences count in full,
those of the other texts, which may be misread, little.

The confusions are a list of common ones and those that the table shows (see `learned`); the probabilities of all are
estimated from the table by one round of decoding words on their own. A confusion that does not occur gets next to none.

Lines are parted by newline and counted from 1. Null texts have no lines; empty ones nothing to repair. A section
delivered again counts once. A line of over 160 characters is no running title, one of over 24 no page number.

The model's tables are sent to all tasks while words and pairs have at most `most` rows each. Beyond that they stay
tables: sections are dealt to groups, a group's words are joined with the known words that they may have been (which have
the same strokes), and each group gets the part of the model that its lines ask for. Both ways give the same.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, once, staged

#: Shapes that scanners take for one another, (as read, as printed); the table's own are learned beside these.
CONFUSIONS = [
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("0", "o"), ("o", "0"), ("5", "s"), ("s", "5"), ("1", "l"), ("l", "1"),
    ("1", "i"), ("i", "1"), ("l", "i"), ("i", "l"), ("o", "a"), ("a", "o"), ("b", "h"), ("h", "b"), ("9", "g"), ("g", "9"), ("q", "g"),
    ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"), ("ii", "u"), ("u", "ii"), ("d", "cl"), ("cl", "d"), ("m", "in"), ("in", "m"),
    ("h", "li"), ("li", "h"), ("n", "ri"), ("ri", "n"), ("u", "n"), ("n", "u"), ("rm", "nn"), ("nn", "rm"), ("8", "b"), ("6", "b"), ("f", "e"), ("v", "y"), ("y", "v"),
]
TOKEN = re.compile(r"\S+")
NUMBER = re.compile(r"^(?=.*\d)(?=.*[lO])[\dlO]+$")
CORE = re.compile(r"^[^\w]*(.*?)[^\w]*$", re.S)
DIGITS = r"[\dlOoIi]"
ROMAN = re.compile(r"^(?=[ivxl1])(?!l$)(?:xl|l?x{0,3})(?:ix|iv|v?[il1]{0,3})$")  # up to 89, as front matter has
PAGE = re.compile(rf"^(?:[-–—~*•·\[\](){{}}|<>=.\s]*)(?:[Pp]\w?[gq9]\w?\.?\s*|[Pp]\.\s*|No\.\s*)?({DIGITS}+)(?:\s*(?:of|/)\s*{DIGITS}+)?(?:\s*[Pp]a[gq9][ec])?(?:[-–—~*•·\[\](){{}}|<>=\s]*)$")
UNSEEN = 1e-13
#: Of a character being misread, before the table has been asked; of a word of an untrusted text being trusted.
MISREAD, TRUST = 0.003, 1e-5
#: A word that no known word explains is taken for a new one if read so often.
NEW = 3
#: A confusion is learned if so many words show it, in this share of the printed shape's places, and so many times as
#: often as rare words of trusted texts differ from common ones by it.
SHOWN, RATE, CONTRAST = 3, 1e-3, 5
#: A line beside a page number is a running title if it stands there so often in the act, at this share of its page breaks.
BREAKS, AT_BREAKS = 5, 0.1
#: Sections, or different words, of a group that gets its own part of a model too large to be sent to all tasks.
GROUP = 20_000


_FOLD = str.maketrans({"c": "e", "f": "e", "t": "e", "0": "o", "a": "o", "5": "s", "1": "l", "i": "l", "9": "g", "q": "g", "b": "h", "8": "h"})


def folded(s: str) -> str:
    """One form for all that scanners take for one another, to compare titles with."""
    s = re.sub(r"[\W_]+", " ", s.lower()).strip()
    for a, b in (("rn", "m"), ("vv", "w"), ("ii", "u"), ("cl", "d"), ("in", "m"), ("li", "h")):
        s = s.replace(a, b)
    return s.translate(_FOLD)


def unnumbered(line: str) -> str:
    """The folded line without its numbers, as the same title bears another page's."""
    return re.sub(r"\s+", " ", folded(re.sub(r"\d+", " ", line))).strip()


def is_page_number(line: str) -> bool:
    s = line.strip()
    if not s or len(s) > 24 or s[-1] in ".,;:":
        return False
    m = PAGE.match(s)
    if m and (any(c.isdigit() for c in m[1]) or re.fullmatch(r"[lO]{2,4}", m[1])):
        return True
    bare = re.sub(r"^[-–—~\[(\s]+|[-–—~\])\s]+$", "", s)
    return bool(ROMAN.match(bare)) and bare == bare.lower()


GAZETTE = [folded(x) for x in ("GAZETTE OF", "EXTRAORDINARY")]
ENACTED = tuple(" " + folded(x) for x in ("ACT", "RULES", "CODE", "ORDINANCE"))


class Titles:
    """The running titles that a section's pages may bear."""

    def __init__(self, act: str | None, learned: list[str] | None = None) -> None:
        act = re.sub(r"[,\s]*\(?\b\d{4}\)?\s*$", "", act or "")
        self.act, self.learned = folded(act), set(learned or ())

    def holds(self, line: str) -> bool:
        s = line.strip()
        if self.learned and len(s) <= 160 and unnumbered(s) in self.learned:
            return True
        if not s or len(s) > 160:
            return False
        upper, bracket, apart = sum(map(str.isupper, s)), "[" in s or "]" in s, "   " in s
        if not (bracket or apart or 3 * upper > len(s) or abs(len(s) - len(self.act)) <= 16):
            return False  # most lines: far from any running title
        if bracket and (re.match(r"^[\dlO\s]*[CG][hb]\.?\s*[\dlO]*\s*\]", s) or re.search(r"\[\s*[S5][ec][ce]\.?\s*[\dlO]", s) or re.search(r"\[\s*[CG][hb]\.", s)):
            return any(map(str.isalpha, s))
        letters = sum(map(str.isalpha, s))
        if not letters:
            return False
        f = folded(s)
        if upper >= 0.8 * letters and letters >= 6 and (any(x in f for x in GAZETTE) or f.endswith(ENACTED) or self.act and self.act in f):
            return True
        if apart and s[-1] not in ".;:,":
            fields = re.split(r"\s{3,}", s)
            if all(x[0].isupper() or x[0].isdigit() or x[0] in "[(" for x in fields):
                return True
        return bool(self.act) and re.sub(r"^(?:[\dol]+ )+|(?: [\dolgs]+)+$", "", f) == self.act


_CORES: dict[str, tuple[str, str]] = {}


def cores(token: str) -> tuple[str, str]:
    """The token without punctuation at its ends, as it is and in lower case."""
    got = _CORES.get(token)
    if got is None:
        if len(_CORES) > 300_000:
            _CORES.clear()
        c = CORE.match(token)[1]
        got = _CORES[token] = (c, c.lower())
    return got


def core_of(token: str) -> str:
    return cores(token)[0]


class Line:
    """A line of a section: its kind, its tokens, and the rest of its last word if that is broken."""

    __slots__ = ("kind", "tokens", "rest", "raw")

    def __init__(self, raw: str) -> None:
        self.raw, self.kind, self.tokens, self.rest = raw, "", TOKEN.findall(raw), None


def lines_of(text: str, titles: Titles) -> list[Line]:
    lines = [Line(x) for x in text.split("\n")]
    for x in lines:
        x.kind = "page_number" if is_page_number(x.raw) else "running_header" if titles.holds(x.raw) else "text" if x.tokens else "blank"
    return lines


def is_wrapped(lines: list[Line]) -> bool:
    """Whether lines end within sentences, as those of scanned pages do."""
    body = [x for x in lines if x.kind in ("text", "blank")]
    inner = ends = 0
    for a, b in zip(body, body[1:]):
        if a.kind == b.kind == "text":
            ends += 1
            inner += a.tokens[-1][-1] not in ".:;?!—"
    return inner > 0 and inner >= 0.2 * ends


def words_of(lines: list[Line]) -> list[list[str]]:
    """The words of each line, lower case. A word broken at the end of a line counts, whole, only where it is whole."""
    out, skip = [], False
    body = [x for x in lines if x.kind == "text"]
    for i, x in enumerate(body):
        words = [cores(t)[1] for t in x.tokens]
        broken = x.tokens[-1].endswith("-") and i + 1 < len(body)
        out.append([w for w in words[1 if skip else 0 : len(words) - 1 if broken else None] if w])
        skip = broken
    return out


class Model:
    """words, pairs: their weights; total, left: the sums of these, and by the first of a pair, where the tables are but a part of the model's."""

    def __init__(
        self, words: dict[str, float], pairs: dict[tuple[str, str], float], confusion: dict[tuple[str, str], float] | None = None, total: float | None = None, left: dict[str, float] | None = None
    ) -> None:
        self.words, self.pairs = words, pairs
        self.vocabulary = sorted(w for w, c in words.items() if c >= 1)
        self.total = max(1.0, sum(words.values()) if total is None else total)
        if left is None:
            left = Counter()
            for (a, _), c in pairs.items():
                left[a] += c
        self.left = left
        self.confusion = confusion or dict.fromkeys(CONFUSIONS, MISREAD)
        self.printed: dict[str, list[tuple[str, float]]] = {}
        for (read, printed), chance in self.confusion.items():
            self.printed.setdefault(read, []).append((printed, log(chance)))
        self.kept: dict[str, list[tuple[str, float]]] = {}
        self.sure: dict[str, bool] = {}

    def plain(self, token: str) -> bool:
        """Whether nothing but the token itself can be meant by it."""
        got = self.sure.get(token)
        if got is None:
            if len(self.sure) > 300_000:
                self.sure.clear()
            core, word = cores(token)
            got = self.sure[token] = (not word or len(self.candidates(word)) == 1) and not NUMBER.match(core) and not token.startswith("(l)")
        return got

    def unigram(self, w: str) -> float:
        if w.isdigit():
            return 0.01
        return max(self.words.get(w, 0.0), UNSEEN * self.total) / self.total

    def given(self, before: str, w: str) -> float:
        n = self.left.get(before, 0.0)
        own = self.unigram(w)
        return own if not n else 0.3 * own + 0.7 * (self.pairs.get((before, w), 0.0) + own) / (n + 1)

    def known(self, w: str) -> bool:
        """From a trusted text, or read so often in others that it is taken for a new word (see fit)."""
        return self.words.get(w, 0.0) >= 1

    def candidates(self, w: str) -> list[tuple[str, float]]:
        """(word as printed, log chance of being read as w), the word itself first."""
        got = self.kept.get(w)
        if got is None:
            if len(self.kept) > 300_000:
                self.kept.clear()
            got = self.kept[w] = self._candidates(w)
        return got

    def begins(self, prefix: str) -> bool:
        """Whether a known word begins so."""
        i = bisect_left(self.vocabulary, prefix)
        return i < len(self.vocabulary) and self.vocabulary[i].startswith(prefix)

    def _candidates(self, w: str) -> list[tuple[str, float]]:
        """The known words (or words joined by hyphens) that w may have been, by the fewest misread places, of a known word by one."""
        found = {w: 0.0}
        if not w or not any(c.isalnum() and c.isascii() for c in w):
            return [(w, 0.0)]
        fewest = 1 if self.known(w) else len(w)
        better: dict[str, tuple[int, float]] = {}
        # From left to right along the known words: (place in w, word so far, of it the part after a hyphen, misread places, log chance).
        todo = [(0, "", "", 0, 0.0)]
        while todo:
            i, whole, part, edits, p = todo.pop()
            if i == len(w):
                if edits and self.known(part) and (edits < fewest or edits == fewest and p > better.get(whole, (0, -1e9))[1]):
                    if edits < fewest:
                        better.clear()
                    fewest = edits
                    better[whole] = (edits, p)
                continue
            c = w[i]
            if self.begins(part + c):
                todo.append((i + 1, whole + c, part + c, edits, p))
            if c == "-" and self.known(part):
                todo.append((i + 1, whole + c, "", edits, p))
            if edits < fewest:
                for width in (1, 2):
                    for printed, q in self.printed.get(w[i : i + width], ()) if i + width <= len(w) else ():
                        if self.begins(part + printed):
                            todo.append((i + width, whole + printed, part + printed, edits + 1, p + q))
        found.update((t, p) for t, (_, p) in better.items() if t != w)
        return list(found.items())

    def decode(self, words: list[str], before: str = "") -> list[str]:
        """The words as printed, by Viterbi over the candidates of each."""
        options = [self.candidates(w) for w in words]
        out, n, i = list(words), len(words), 0
        while i < n:
            if len(options[i]) == 1:
                i += 1
                continue
            # A word of one candidate parts the line: what is before it has no say in what follows.
            states = {out[i - 1] if i else before: (0.0, [])}
            j = i
            while j < n and len(options[j]) > 1:
                after: dict[str, tuple[float, list[str]]] = {}
                for c, p in options[j]:
                    after[c] = max(((s + log(self.given(b, c)) + p, [*path, c]) for b, (s, path) in states.items()), key=lambda x: x[0])
                states = after
                j += 1
            if j < n:
                states = {c: (s + log(self.given(c, words[j])), path) for c, (s, path) in states.items()}
            out[i:j] = max(states.values(), key=lambda x: x[0])[1]
            i = j
        return out


class Asked(Model):
    """Knows nothing, and notes which words are looked up."""

    def __init__(self) -> None:
        super().__init__({}, {})
        self.asked: set[str] = set()

    def candidates(self, w: str) -> list[tuple[str, float]]:
        self.asked.add(w)
        return [(w, 0.0)]


def joined(model: Model, left: str, right: str) -> tuple[bool, str, str]:
    """Whether the hyphen between the two was put in; the whole word as read; as printed."""
    a, b = left[:-1], right
    whole, hyphened = a + b, a + "-" + b

    def best(w: str) -> tuple[float, str]:
        return max((model.words.get(c, 0.0) * 2.718281828 ** p, c) for c, p in model.candidates(w) if model.known(c) or c == w)

    (s1, c1), (s2, c2) = best(whole), best(hyphened)
    if s2 > s1:
        return False, hyphened, c2
    return True, whole, c1


def examine(text: str, titles: Titles, model: Model) -> tuple[list[tuple[int, str]], str]:
    """((line number, kind) of what needs repair, the text repaired)."""
    lines = lines_of(text, titles)
    found: list[tuple[int, str]] = []
    body = [i for i, x in enumerate(lines) if x.kind == "text"]
    numeric = bool(re.search(r"^\s*\(\d\)", text, re.M))
    fixed: dict[int, list[str]] = {}
    misread: set[int] = set()
    carried: tuple[str, str, bool] | None = None  # of a word begun on the line before
    for n, i in enumerate(body):
        x = lines[i]
        tokens = x.tokens
        if not carried and not tokens[-1].endswith("-") and all(map(model.plain, tokens)):
            fixed[i] = list(tokens)
            continue
        words = [cores(t)[1] for t in tokens]
        last_joined = None
        if tokens[-1].endswith("-") and len(tokens[-1]) > 1 and tokens[-1][-2].isalpha() and n + 1 < len(body):
            following = lines[body[n + 1]].tokens[0]
            if following[0].isalpha() or following[0].isdigit():
                last_joined = joined(model, re.sub(r"^\W+", "", tokens[-1]).lower(), core_of(following).lower())
                words[-1] = last_joined[1]
        if carried:
            words[0] = carried[1]
        printed = model.decode([w for w in words if w])
        it = iter(printed)
        out = []
        for k, (t, w) in enumerate(zip(tokens, words)):
            c = next(it) if w else ""
            wrong = bool(w) and c != w
            if not wrong and k and not (last_joined and k == len(tokens) - 1) and model.plain(t):
                out.append(t)
                continue
            if NUMBER.match(core_of(t)):
                wrong, c = True, core_of(t).replace("l", "1").replace("O", "0")
            elif numeric and re.match(r"^\(l\)", t):
                wrong, c = True, "1"
            if k == 0 and carried:
                if wrong:
                    _blame(w, c, len(carried[0]), i, carried_line, misread)
                out.append("")
                continue
            if k == len(tokens) - 1 and last_joined:
                out.append(_cased(re.sub(r"^\W+", "", t), c))
                continue
            if wrong:
                misread.add(i)
            out.append(t.replace(core_of(t), _cased(core_of(t), c)) if wrong else t)
        if carried:  # the rest of the broken word goes to where it begins
            tail = re.search(r"\W*$", tokens[0])[0]
            before = fixed[carried_line]
            before[-1] = before[-1] + tail
        if last_joined:
            head = re.match(r"^\W*", tokens[-1])[0]
            out[-1] = head + out[-1]
            if last_joined[0]:
                found.append((i + 1, "broken_word"))
            carried, carried_line = (re.sub(r"^\W+", "", tokens[-1])[: -1 if last_joined[0] else None], last_joined[1], last_joined[0]), i
        else:
            carried = None
        fixed[i] = out
    for i, x in enumerate(lines):
        if x.kind in ("page_number", "running_header"):
            found.append((i + 1, x.kind))
    found += [(i + 1, "misread") for i in misread]
    return found, _paragraphs(lines, fixed)


def _blame(read: str, printed: str, border: int, second: int, first: int, misread: set[int]) -> None:
    """Marks the line that holds the misread part of a broken word."""
    a = 0
    while a < min(len(read), len(printed)) and read[a] == printed[a]:
        a += 1
    b = 0
    while b < min(len(read), len(printed)) - a and read[-1 - b] == printed[-1 - b]:
        b += 1
    if a < border:
        misread.add(first)
    if len(read) - b > border:
        misread.add(second)


def _cased(like: str, word: str) -> str:
    if like.isupper() and len(like) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def _paragraphs(lines: list[Line], fixed: dict[int, list[str]]) -> str:
    """Furniture gone, lines joined; a blank line parts paragraphs unless a page break lies in a sentence."""
    out: list[str] = []
    current: list[str] = []
    gap = page = False
    for i, x in enumerate(lines):
        if x.kind == "blank":
            gap = True
        elif x.kind == "text":
            words = [w for w in fixed[i] if w]
            if gap and current and not (page and current[-1][-1] not in ".:;?!—"):
                out.append(" ".join(current))
                current = []
            gap = page = False
            current += words
        else:
            page = True
    if current:
        out.append(" ".join(current))
    return "\n\n".join(out)


def _counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words (second = '') and of neighbours, of trusted texts and of the others.

    Also, with an act after "#" as the first, how often a line (second) stands beside a page number, '' for all page numbers.
    """
    words: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    pairs: tuple[Counter[tuple[str, str]], Counter[tuple[str, str]]] = (Counter(), Counter())

    def flush() -> Iterator[pa.RecordBatch]:
        for (sure, unsure), ends in ((words, lambda k: (k, "")), (pairs, lambda k: k)):
            keys = list(sure.keys() | unsure.keys())
            if keys:
                both = [ends(k) for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in both]), pa.array([k[1] for k in both]), pa.array([sure[k] for k in keys]), pa.array([unsure[k] for k in keys])], names=["first", "second", "sure", "unsure"])
            sure.clear()
            unsure.clear()

    for b in rows:
        for text, act, chapter, title in zip(*(c.to_pylist() for c in b.columns[1:5])):
            titles = Titles(act)
            lines = lines_of(text or "", titles)
            at = 1 if is_wrapped(lines) else 0
            for line in beside(lines):
                pairs[1]["#" + titles.act, line] += 1
            for found in words_of(lines):
                words[at].update(found)
                pairs[at].update(zip(found, found[1:]))
            for extra in (act, chapter, title):
                found = [w for w in (cores(t)[1] for t in TOKEN.findall(extra or "")) if w]
                words[0].update(found)
                pairs[0].update(zip(found, found[1:]))
        if len(pairs[0]) + len(pairs[1]) > 500_000:
            yield from flush()
    yield from flush()


def beside(lines: list[Line]) -> Iterator[str]:
    """The lines next to each page number (blank ones aside) that may be titles, without their numbers; '' for the page number."""
    full = [x for x in lines if x.kind != "blank"]
    for i, x in enumerate(full):
        if x.kind == "page_number":
            yield ""
            for y in {i - 1, i + 1} & set(range(len(full))):
                if full[y].kind == "text" and len(full[y].raw) <= 160 and (title := unnumbered(full[y].raw)):
                    yield title


def _confused(rows: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """How often each confusion explains a word that is not known, and how often its printed form was read right.

    Also, as ('=', word, n), the words of untrusted texts that no known word explains: new words, unless rare.
    """
    seen: Counter[tuple[str, str]] = Counter()
    right: Counter[str] = Counter()
    shapes = {p for _, p in model.confusion}
    for b in rows:
        for w, n in zip(b.column("first").to_pylist(), b.column("unsure").to_pylist()):
            if model.known(w):
                for printed in shapes:
                    right[printed] += n * w.count(printed)
                continue
            options = [(model.unigram(c) * 2.718281828**p, c) for c, p in model.candidates(w) if c != w]
            if options:
                c = max(options)[1]
                a = 0
                while w[a : a + 1] == c[a : a + 1] != "":
                    a += 1
                for read, printed in model.confusion:
                    if w.startswith(read, a) and c.startswith(printed, a) and w[a + len(read) :] == c[a + len(printed) :]:
                        seen[read, printed] += n
            elif n >= NEW:
                seen["=", w] = n
    keys = [*seen, *(("", p) for p in right)]
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] if k[0] else right[k[1]] for k in keys], pa.int64())], names=["read", "printed", "n"])


def learned(counts: DataFrame) -> list[tuple[str, str]]:
    """The confusions (as read, as printed) that the table itself shows.

    Words that only untrusted texts have are set beside the known words that differ in one place, of one or two
    characters; each goes with that of the shortest difference, then the commonest. What misreading does not explain, as words are alike by nature too,
    shows among the rare words of trusted texts as well, and is no confusion.
    """
    words = counts.where("second = ''").where(F.col("first").rlike("^[a-z0-9]{3,64}$"))
    gaps = F.expr(
        "flatten(transform(sequence(1, length(first)), i -> transform(filter(array(1, 2), r -> i + r <= length(first) + 1), "
        "r -> struct(concat(substring(first, 1, i - 1), ' ', substring(first, i + r)) AS around, substring(first, i, r) AS seg))))"
    )
    cut = words.select("first", "sure", "unsure", F.explode(gaps).alias("g")).select("first", "sure", "unsure", "g.around", "g.seg")
    # A known word that is no commoner than SHOWN explains nothing, and no word explains one nearly as common.
    common = cut.where((F.col("sure") > SHOWN) & F.col("first").rlike("^[a-z]+$")).select("around", F.col("seg").alias("printed"), F.col("sure").alias("common"))
    pair = cut.join(common, "around").where(F.col("common") >= 10 * F.greatest("sure", "unsure"))
    pair = pair.where((F.left("seg", F.lit(1)) != F.left("printed", F.lit(1))) & (F.right("seg", F.lit(1)) != F.right("printed", F.lit(1))))
    best = pair.groupBy("first", "sure", "unsure").agg(F.max_by(F.struct("seg", "printed"), F.struct(-F.length("seg") - F.length("printed"), "common", "seg", "printed")).alias("x"))
    bad = F.col("sure") == 0
    shown = best.groupBy("x.seg", "x.printed").agg(F.count_if(bad).alias("words"), F.sum(F.when(bad, F.col("unsure")).otherwise(0)).alias("n"), F.sum("sure").alias("control"))
    shown = staged(shown.where((F.col("words") >= SHOWN) & (F.col("n") >= CONTRAST * F.col("control"))), "shown")
    places = [F.sum(F.col("unsure") * F.floor((F.length("first") - F.length(F.replace("first", F.lit(p), F.lit("")))) / len(p))).alias(p) for p in sorted({r.printed for r in shown.select("printed").distinct().collect()})]
    if not places:
        return []
    right = words.where("sure > 0").agg(*places).first()
    pairs = {(r.seg, r.printed): r.n for r in shown.collect() if r.n >= RATE * (right[r.printed] or 0)}  # of one or two characters
    # A pair that holds a commoner one, with something beside it, is that one in a word with another ending.
    return sorted(p for p, n in pairs.items() if not any(q != p and m > n and q[0] in p[0] and q[1] in p[1] for q, m in pairs.items()))


def titles_of(counts: DataFrame) -> DataFrame:
    """act, titles: the running titles that stand beside the page numbers of the act, besides those told by their form."""
    rows = counts.where(F.col("first").startswith("#")).select(F.substring("first", 2, 1 << 30).alias("act"), "second", "unsure")
    all_ = rows.where("second = ''").select("act", F.col("unsure").alias("breaks"))
    kept = rows.where("second <> ''").join(broadcast_if_small(all_), "act").where((F.col("unsure") >= BREAKS) & (F.col("unsure") >= AT_BREAKS * F.col("breaks")))
    return staged(kept.groupBy("act").agg(F.sort_array(F.collect_list("second")).alias("titles")), "titles")


#: Characters as strokes: words that a listed confusion turns into one another have the same ones.
STROKES = [("[cfet]", "C"), ("[0oa]", "O"), ("[5s]", "S"), ("[1lir]", "I"), ("[buhn86]", "II"), ("m", "III"), ("d", "CI"), ("[9gq]", "G"), ("[vy]", "V"), ("w", "VV")]


def left_out(confusions: list[tuple[str, str]]) -> str:
    """The characters whose confusions change the strokes; without them, and all that is taken for them, words still have the same."""

    def strokes(x: str) -> str:
        for pattern, to in STROKES:
            x = re.sub(pattern, to, x)
        return x

    out: set[str] = set()
    while True:
        odd = {c for a, b in confusions for c in a + b if out & set(a + b) or strokes(a) != strokes(b)}
        if odd <= out:
            return "".join(sorted(out))
        out |= odd


def _strokes(word: Column, out: str) -> Column:
    for pattern, to in ([("[" + re.escape(out) + "]", "")] if out else []) + STROKES:
        word = F.regexp_replace(word, pattern, to)
    return word


def _reach(needs: DataFrame, words: DataFrame, confusions: list[tuple[str, str]]) -> DataFrame:
    """g, word, w: of each group the words needed, and the known words that these, or their parts between hyphens, may have been.

    needs: g, word. words: word, w.
    """
    out = left_out(confusions)
    parts = needs.select("g", F.explode(F.array_distinct(F.concat(F.array("word"), F.split("word", "-")))).alias("word")).where("word <> ''").distinct()
    known = words.where("w >= 1").withColumn("key", _strokes(F.col("word"), out))
    near = parts.select("g", _strokes(F.col("word"), out).alias("key")).distinct().join(known, "key").select("g", "word", "w")
    return staged(near.unionByName(parts.join(words, "word").select("g", "word", "w")).distinct(), "slices")


def _tables(t: pa.Table) -> tuple[dict, dict, dict]:
    """Words, pairs and sums by first of a slice (first, second, w), where words have no second and sums have none but a blank."""
    words, pairs, left = {}, {}, {}
    for a, b, w in zip(*(t[c].to_pylist() for c in ("first", "second", "w"))):
        if b is None:
            words[a] = w
        elif b == " ":
            left[a] = w
        else:
            pairs[a, b] = w
    return words, pairs, left


@dataclass
class Fitted:
    """words: word, w; pairs: first, second, w; small: whether both may be sent to all tasks; titles: act, titles."""

    words: DataFrame
    pairs: DataFrame
    confusion: dict[tuple[str, str], float]
    titles: DataFrame
    small: bool


def fit(rows: DataFrame, most: int) -> Fitted:
    counts = staged(rows.mapInArrow(_counts, "first string, second string, sure long, unsure long").groupBy("first", "second").agg(F.sum("sure").alias("sure"), F.sum("unsure").alias("unsure")), "ngrams")
    # However often a word is read in texts that are not trusted, that alone does not make it known.
    weight = (F.col("sure") + F.least(F.lit(0.5), TRUST * F.col("unsure"))).alias("w")
    told = counts.where(~F.col("first").startswith("#"))
    words = staged(told.where("second = ''").select(F.col("first").alias("word"), "unsure", weight), "words")
    pairs = staged(told.where("second <> ''").select("first", "second", weight).where("w >= 1"), "pairs")
    n = words.count()
    small = n <= most and pairs.limit(most + 1).count() <= most
    start = dict.fromkeys([*CONFUSIONS, *learned(told)], MISREAD)
    asked = words.where("unsure > 0").select(F.col("word").alias("first"), "unsure")
    kind = "read string, printed string, n long"
    if small:
        model = Model(_dict(words), {}, start)
        seen = asked.mapInArrow(lambda it: _confused(it, model), kind)
    else:
        total = words.agg(F.sum("w")).first()[0]
        asked = asked.withColumn("g", F.pmod(F.xxhash64("first"), F.lit(-(-n // GROUP))))
        near = _reach(asked.select("g", F.col("first").alias("word")), words.select("word", "w"), list(start))

        def explained(own: pa.Table, part: pa.Table) -> pa.Table:
            m = Model(dict(zip(part["word"].to_pylist(), part["w"].to_pylist())), {}, start, total)
            return pa.Table.from_batches(list(_confused(iter(own.to_batches()), m)))

        seen = asked.groupBy("g").cogroup(near.groupBy("g")).applyInArrow(explained, kind)
    seen = staged(seen.groupBy("read", "printed").agg(F.sum("n").alias("n")), "confusions")
    shown = {(r.read, r.printed): r.n for r in seen.where("read <> '='").collect()}  # as many rows as confusions and printed shapes
    chances = {(a, b): (shown.get((a, b), 0) + 1) / (shown.get((a, b), 0) + shown.get(("", b), 0) + 1 / MISREAD) for a, b in start}
    new = seen.where("read = '='").select(F.col("printed").alias("word"), "n")
    words = words.join(broadcast_if_small(new), "word", "left").select("word", F.coalesce(F.col("n").cast("double"), "w").alias("w"))
    return Fitted(staged(words, "words"), pairs, chances, titles_of(counts), small)


def _dict(words: DataFrame) -> dict[str, float]:
    t = words.orderBy("word").toArrow()
    return dict(zip(t["word"].to_pylist(), t["w"].to_pylist()))


def _sections(df: DataFrame, key: str, text: str, act: str, chapter: str, title: str) -> DataFrame:
    cols = {"text": text, "act": act, "chapter": chapter, "title": title}
    rows = df.select(F.col(key).cast("long").alias("key"), *(F.col(c).cast("string").alias(k) for k, c in cols.items()))
    return once(rows, "key", *cols)


def repair(df: DataFrame, key: str, text: str, act: str, chapter: str, title: str, most: int = 300_000) -> DataFrame:
    """key, text (repaired), noise: the lines that needed repair, as an array of (line_no, kind)."""
    spark = df.sparkSession
    rows = staged(_sections(df, key, text, act, chapter, title), "sections")
    fitted = fit(rows, most)
    # An act's folded name, as Titles has it, is the key.
    folds = F.udf(lambda a: Titles(a).act, "string")
    acts = staged(rows.select("act").distinct().where("act is not null").select(F.col("act").alias("name"), folds("act").alias("act")), "acts")
    titles = fitted.titles.join(acts, "act").select(F.col("name").alias("act"), "titles")
    rows = rows.select("key", "text", "act").join(broadcast_if_small(titles), "act", "left") if titles.limit(1).count() else rows.select("key", "text", "act", F.lit(None).cast("array<string>").alias("titles"))
    kind, confusion = "key long, text string, noise array<struct<line_no:int,kind:string>>", fitted.confusion
    if fitted.small:
        t = fitted.pairs.orderBy("first", "second").toArrow()  # both bounded by `most`
        shared = spark.sparkContext.broadcast((_dict(fitted.words), dict(zip(zip(t["first"].to_pylist(), t["second"].to_pylist()), t["w"].to_pylist()))))
        return rows.mapInArrow(lambda it: _repaired(it, Model(*shared.value, confusion)), kind).withColumnRenamed("key", key)

    rows = rows.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-rows.count() // GROUP)))))
    needs = rows.select("g", "text", "act", "titles").mapInArrow(_needs, "g long, word string").distinct()
    near = _reach(needs, fitted.words, list(confusion))
    mine = near.select("g", F.col("word").alias("first"))
    pairs = fitted.pairs.join(mine, "first").join(near.select("g", F.col("word").alias("second")), ["g", "second"])
    sums = fitted.pairs.groupBy("first").agg(F.sum("w").alias("w")).join(mine, "first").select("g", "first", F.lit(" ").alias("second"), "w")
    part = near.select("g", F.col("word").alias("first"), F.lit(None).cast("string").alias("second"), "w").unionByName(pairs.select("g", "first", "second", "w")).unionByName(sums)
    total = fitted.words.agg(F.sum("w")).first()[0]

    def mended(own: pa.Table, model: pa.Table) -> pa.Table:
        words, known, left = _tables(model)
        return pa.Table.from_batches(list(_repaired(iter(own.to_batches()), Model(words, known, confusion, total, left))))

    return rows.groupBy("g").cogroup(part.groupBy("g")).applyInArrow(mended, kind).withColumnRenamed("key", key)


def _needs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        found: dict[int, Asked] = {}
        for g, t, a, own in zip(*(b.column(c).to_pylist() for c in ("g", "text", "act", "titles"))):
            if t:
                examine(t, Titles(a, own), found.setdefault(g, Asked()))
        for g, m in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(m.asked), pa.int64()), pa.array(list(m.asked), pa.string())], names=["g", "word"])


def _repaired(rows: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())]))
    names = ["key", "text", "noise"]
    yield pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], kind)], names=names)
    for b in rows:
        for lo in range(0, b.num_rows, 500):
            part = b.slice(lo, 500)
            out, noise = [], []
            for t, a, own in zip(*(part.column(c).to_pylist() for c in ("text", "act", "titles"))):
                found, fixed = examine(t, Titles(a, own), model) if t else ([], t)
                out.append(fixed)
                noise.append([{"line_no": n, "kind": k} for n, k in sorted(found)])
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, pa.string()), pa.array(noise, kind)], names=names)
