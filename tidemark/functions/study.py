"""Column functions on prompts, answers, notes, identifiers and dates of a study store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = "〇一二三四五六七八九"
#: last of each joined part's separator: fixed by the id scheme
SEPARATOR = "␟"


def chinese_number(n: Column) -> Column:
    """1 to 99 in Chinese numerals; null beyond."""
    digit = lambda d: F.substring(F.lit(_DIGITS), d.cast("int") + 1, F.lit(1))
    tens, ones = F.floor(n / 10), n % 10
    head = F.when(tens == 0, "").when(tens == 1, "十").otherwise(F.concat(digit(tens), F.lit("十")))
    return F.when((n >= 1) & (n <= 99), F.concat(head, F.when(ones == 0, "").otherwise(digit(ones))))


def namespace(knowledge_id: Column) -> Column:
    """The first two parts of a dotted id; null for ids of fewer."""
    return F.when(F.size(F.split(knowledge_id, r"\.")) >= 2, F.substring_index(knowledge_id, ".", 2))


def chapter_prefix(knowledge_id: Column) -> Column:
    """The id up to its part chNN, or empty."""
    return F.regexp_extract(knowledge_id, r"^(.*?\.ch\d+)(?:\.|$)", 1)


def subject_key(domain: Column, subject: Column) -> Column:
    return F.concat_ws(":", domain, F.coalesce(F.nullif(F.trim(subject), F.lit("")), F.lit("default")))


def preview(text: Column, most: int = 100) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def excerpt(text: Column, needle: Column, around: int = 24) -> Column:
    """The needle's first place in the text with around characters on both sides; null where it is not."""
    at = F.locate(needle, text) if isinstance(needle, str) else F.call_function("locate", needle, text)
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.substring(text, start, at - start + F.length(needle) + around))


def marked_numbers(text: Column, last: int = 20) -> Column:
    """Distinct numbers 1 to last that stand alone as words, ascending."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{1,2})\b"), 1), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= last))))


def missing_numbers(found: Column, last: int = 20) -> Column:
    return F.array_except(F.sequence(F.lit(1), F.lit(last)), found)


def answer_words(text: Column, translation: Column) -> Column:
    """Words with a letter, or the characters that are no white space of a translation."""
    return F.when(translation, F.length(F.regexp_replace(text, r"\s", ""))).otherwise(F.regexp_count(text, F.lit("[A-Za-z]+"))).cast("long")


def asked_words(prompt: Column) -> Column:
    """The number in "about N words", or null."""
    return F.regexp_extract(F.lower(prompt), r"about (\d+) words", 1).try_cast("int")


def paragraph_references(text: Column) -> Column:
    """Distinct numbers of paragraphs that a text names, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?:[Pp]aragraph|\bpara)\s+(\d+)"), 1)
    return F.array_distinct(found)


def with_tag(analysis: Column, tag: Column) -> Column:
    """The analysis led in by the tag, unless it has it."""
    return F.when(F.contains(analysis, tag), analysis).otherwise(F.concat(tag, F.lit("\n"), analysis))


def note_entries(text: Column) -> Column:
    """Entries between rules of three dashes, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(text, r"(?m)^---$"), lambda x: F.trim(x, F.lit(" \n"))), lambda x: x != "")


def compact_number(n: Column) -> Column:
    """Thousands as k and ten thousands as w, with one decimal, half up."""
    short = lambda by, letter: F.concat(F.format_string("%.1f", F.floor(n / (by / 10) + 0.5) / 10), F.lit(letter))
    return F.when(n >= 10_000, short(10_000, "w")).when(n >= 1_000, short(1_000, "k")).otherwise(n.cast("string"))


def blanked_lines(text: Column, marks: Sequence[str]) -> Column:
    """The text with lines that begin with a mark emptied, so that line numbers stay."""
    hit = lambda x: F.array_contains(F.array(*[F.startswith(F.trim(x), F.lit(m)) for m in marks]), True)
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(hit(x), "").otherwise(x)), "\n")


def first_heading(text: Column, fallback: Column) -> Column:
    found = F.regexp_extract(text, r"(?m)^#\s+(.+?)\s*$", 1)
    return F.when(found != "", found).otherwise(fallback)


def tags(*labels: Column) -> Column:
    """Distinct labels that are not blank, in order."""
    return F.array_distinct(F.filter(F.array(*labels), lambda x: x.isNotNull() & (F.trim(x) != "")))


def joined_id(*parts: Column, length: int = 16) -> Column:
    """The first hexadecimal digits of the sha256 of trimmed parts."""
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *[F.trim(p) for p in parts]), 256), 1, length)


def canonical_json(json: Column) -> Column:
    """A flat JSON object with sorted keys and no white space."""
    entries = F.array_sort(F.map_entries(F.from_json(json, "map<string,string>")))
    return F.to_json(F.map_from_entries(entries))


def by_suffix(json: Column, suffix: str) -> Column:
    """Values of a flat JSON object whose keys end so."""
    return F.map_values(F.map_filter(F.from_json(json, "map<string,string>"), lambda k, v: F.endswith(k, F.lit(suffix))))


def day_of(stamp: Column, modified: Column, today: Column) -> Column:
    """The day that a stamp begins with, else that of the change, else today."""
    return F.coalesce(F.substring(stamp, 1, 10).try_cast("date"), F.to_date(modified), today)


def day_label(day: Column) -> Column:
    return F.concat(F.month(day), F.lit("月"), F.day(day), F.lit("日"))


def countdown(day: Column, as_of: Column) -> Column:
    """Days left and their stage: final to 30, near to 120, else early."""
    left = F.datediff(day, as_of)
    return F.struct(left.alias("days"), F.when(left <= 30, "final").when(left <= 120, "near").otherwise("early").alias("stage"))
