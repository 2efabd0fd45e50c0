"""Text functions, as column expressions that stay in generated code.

Patterns carry (?U) where white space, digits or letters of any script count, and (?dm) where lines end at \\n only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A line that matches one of these is noise of the printed page.
NOISE = [
    r"(?dU)^\s*\d+\s*$",
    r"(?i)THE GAZETTE OF INDIA",
    r"(?i)MINISTRY OF LAW",
    r"(?dU)^\s*—\s*$",
    r"(?i)jftLVªh laö",
    r"(?i)REGISTERED NO\.",
    r"(?i)EXTRAORDINARY",
]
#: Topics and the keywords that show them.
TOPICS = {
    "security deposit": ["security deposit", "advance amount", "deposit refund"],
    "lease termination": ["termination", "eviction", "vacate"],
    "rent": ["rent", "monthly payment", "arrears"],
}
#: Titles that hold one of these are of low value.
LOW_VALUE = ["power to make rules", "repeal", "repeals", "power to remove difficulties", "delegation of powers"]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def clean(text: Column, noise: list[str] = NOISE) -> Column:
    """Noise lines dropped, three or more newlines cut to two, runs of blanks and tabs to one, stripped."""
    any_noise = lambda x: reduce(lambda a, b: a | b, (x.rlike(p) for p in noise))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~any_noise(x)), "\n")
    return strip(F.regexp_replace(F.regexp_replace(kept, r"\n{3,}", "\n\n"), r"[ \t]+", " "))


def title_case(c: Column) -> Column:
    """Each run of letters starts with a capital and goes on in lower case."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), 1), F.initcap), "")


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-zA-Z0-9]+)"), 1)


def tokens_ws(text: Column) -> Column:
    """What white space parts, lower case."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Split after an end mark, before a capital, an opening bracket or a quotation mark; stripped, none empty."""
    parts = F.split(text, r'(?U)(?<=[.!?;—])\s+(?=[A-Z\("])')
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def topics(text: Column, table: dict[str, list[str]] = TOPICS, default: bool = False) -> Column:
    """The topics of which a keyword occurs in the text, in the table's order; ["general"] for none if default."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    found = F.array_compact(F.array(*(F.when(hit(words), F.lit(t)) for t, words in table.items())))
    return F.when(F.size(found) == 0, F.array(F.lit("general"))).otherwise(found) if default else found


def is_low_value(title: Column, phrases: list[str] = LOW_VALUE) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in phrases))


def search_text(act: Column, number: Column, title: Column, chapter: Column, text: Column) -> Column:
    """What is indexed: act, number and title, chapter, a blank line, text."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return strip(F.concat(e(act), F.lit("\n"), e(number), F.lit(" "), e(title), F.lit("\n"), e(chapter), F.lit("\n\n"), e(text)))


def document_text(act: Column, category: Column, number: Column, title: Column, topics_: Column, text: Column) -> Column:
    """The labelled form."""
    e = lambda c: F.coalesce(c, F.lit(""))
    shown = F.when(F.size(topics_) > 0, F.array_join(topics_, ", ")).otherwise("general")
    rows = [("Act: ", e(act)), ("\nCategory: ", e(category)), ("\nSection: ", e(number)), ("\nTitle: ", e(title)), ("\nTopics: ", shown), ("\n\n", e(text))]
    return F.concat(*(x for label, c in rows for x in (F.lit(label), c)))


def section_number(query: Column) -> Column:
    """The number after "section" or "sec", else the first number of two to four digits."""
    low = F.lower(query)
    named = F.nullif(F.regexp_extract(low, r"(section|sec)\s+(\d+)", 2), F.lit(""))
    return F.coalesce(named, F.nullif(F.regexp_extract(low, r"\b(\d{2,4})\b", 1), F.lit("")))


def first_seen(arrays: Column) -> Column:
    """Distinct values in the order in which they first come."""
    return F.array_distinct(F.flatten(arrays))
