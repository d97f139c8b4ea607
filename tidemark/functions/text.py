"""Column functions on text: titles, numerals, terms, headings, ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The digits and units of Chinese numerals.
NUMERALS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "零": 0, "两": 2}
UNITS = {"十": 10, "百": 100}


def is_blank(text: Column) -> Column:
    """Null, empty, or white space of any script."""
    return F.coalesce(F.regexp_replace(text, r"(?U)\s+", ""), F.lit("")) == ""


def numeral(text: Column) -> Column:
    """Value of a Chinese numeral below a thousand; null where another character stands."""
    digits = F.create_map(*[F.lit(x) for kv in NUMERALS.items() for x in kv])
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit"))

    def step(a: Column, c: Column) -> Column:
        unit = F.element_at(units, c)
        with_unit = F.struct((a["total"] + F.greatest(F.lit(1), a["digit"]) * unit).alias("total"), F.lit(0).alias("digit"))
        return F.when(unit.isNotNull(), with_unit).otherwise(F.struct(a["total"].alias("total"), F.element_at(digits, c).alias("digit")))

    letters = F.split(text, "")
    value = F.aggregate(F.filter(letters, lambda c: c != ""), start, step, lambda a: a["total"] + a["digit"])
    known = text.rlike("^[" + "".join((*NUMERALS, *UNITS)) + "]+$")
    return F.when(known, value)


#: What chapter titles are compared without.
TITLE_NUMBER = r"^(?:第[一二三四五六七八九十百\d]+章|\d+)[\s、.．]*"
TITLE_DROPPED = r"[\s·•:：,，。.!！?？()（）\[\]【】/／与及和病变]"


def bare_title(title: Column) -> Column:
    """A chapter title without its number, joining words and punctuation, for comparison."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), TITLE_NUMBER, ""), TITLE_DROPPED, "")
    return F.replace(bare, F.lit("过敏"), F.lit("敏感"))


def bilingual(title: Column) -> tuple[Column, Column]:
    """Latin term and its translation after a colon; the translation is empty where there is none."""
    pattern = r"^([A-Za-z][A-Za-z \-']*)[:：]\s*([\x{3400}-\x{9fff}].*)$"
    latin = F.regexp_extract(title, pattern, 1)
    return F.when(latin != "", F.trim(latin)).otherwise(title), F.regexp_extract(title, pattern, 2)


def count_term(text: Column, term: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def guarded_replace(text: Column, rules: Sequence[tuple[str, str]], protected: Sequence[str]) -> Column:
    """Rules in order, longest first, each on what the one before made; protected words stay as they are.

    Protected words are masked by private-use characters meanwhile.
    """
    masks = {w: chr(0xE000 + i) for i, w in enumerate(sorted(protected, key=lambda w: (-len(w), w)))}
    for word, mask in masks.items():
        text = F.replace(text, F.lit(word), F.lit(mask))
    for old, new in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        text = F.replace(text, F.lit(old), F.lit(new))
    for word, mask in masks.items():
        text = F.replace(text, F.lit(mask), F.lit(word))
    return text


def short_id(*parts: Column, separator: str = ":", length: int = 16) -> Column:
    """First hex letters of the sha256 of the joined parts; null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def path_id(path: Column, offset: Column) -> Column:
    """First 12 hex letters of the sha1 of path, NUL, offset."""
    return F.substring(F.sha1(F.concat(path, F.lit("\0"), offset.cast("string")).cast("binary")), 1, 12)


def safe_name(name: Column, most: int = 80, fallback: str = "untitled") -> Column:
    """A file name: illegal characters become dashes, white space single spaces."""
    n = F.trim(F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|]', "-"), r"\s+", " "))
    return F.coalesce(F.nullif(F.trim(F.substring(n, 1, most)), F.lit("")), F.lit(fallback))


def duration(seconds: Column) -> Column:
    """Seconds below a minute, else minutes with what is left."""
    m, s = F.floor(seconds / 60), F.floor(seconds % 60)
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("秒"))).when(s == 0, F.concat(m.cast("string"), F.lit("分钟"))).otherwise(F.concat(m.cast("string"), F.lit("分"), s.cast("string"), F.lit("秒")))
