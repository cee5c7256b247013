"""Cleaning of names and postal codes, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _marked_letters() -> dict[str, str]:
    """Latin letters with marks, and the plain letters that their decomposition begins with."""
    found = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and plain.isascii() and all(map(unicodedata.combining, marks)):
            found[chr(code)] = plain
    return found


_MARKED = _marked_letters()
#: Letters with marks, then marks by themselves; what they fold to, place by place; the marks have no place and go.
ACCENTED = "".join(_MARKED) + "".join(map(chr, range(0x300, 0x370)))
PLAIN = "".join(_MARKED.values())


#: ASCII but for letters, in a class of a pattern.
_ASCII_GAP = r"\x00-\x40\x5B-\x60\x7B-\x7F"


def cap(word: Column) -> Column:
    """First character in upper case, the rest in lower case."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))


def capitalize(text: Column) -> Column:
    """Capitalises each run of letters and squashes spaces.

    Unchanged: null, empty, and texts without letters. Signs followed by one run of letters are capitalised as a whole, so
    the sign takes the capital. A longer text that starts with a sign has its gaps one place early: gaps and words are
    paired by position, and the words begin with an empty one. Existing names were made this way, so it stays.
    """
    words = F.split(text, r"\P{L}+", -1)
    gaps = F.split(text, r"\p{L}+", -1)
    paired = F.transform(F.arrays_zip(gaps.alias("gap"), words.alias("word")), lambda p: F.concat(F.coalesce(p["gap"], F.lit("")), cap(F.coalesce(p["word"], F.lit("")))))
    joined = F.regexp_replace(F.array_join(paired, ""), " {2,}", " ")
    # A text that starts with a letter and has plain ASCII gaps, as most have, is cut once, before each word; lower case leaves such gaps alone.
    # Spark compiles the pattern of split() for each row, that of regexp_extract_all() once.
    squashed = F.when(text.contains("  "), F.regexp_replace(text, " {2,}", " ")).otherwise(text)
    plain = F.array_join(F.transform(F.regexp_extract_all(squashed, F.lit(rf"\p{{L}}+[{_ASCII_GAP}]*"), F.lit(0)), cap), "")
    return (
        F.when(text.rlike(r"\A\p{L}+\z"), cap(text))
        .when(text.rlike(rf"\A\p{{L}}[\p{{L}}{_ASCII_GAP}]*\z"), plain)
        .when(text.isNull() | (text == "") | ~text.rlike(r"\p{L}"), text)
        .when(text.rlike(r"\A\P{L}+\p{L}+\z"), cap(text))
        .otherwise(joined)
    )


def fold(text: Column) -> Column:
    """Lower case without accents: the key for comparing names."""
    return F.lower(F.translate(text, ACCENTED, PLAIN))


def slugify(name: Column, path: Column) -> Column:
    """A name and the path above it as one lower-case word of letters, digits and single underscores."""
    whole = F.translate(F.concat_ws(", ", name, path), ACCENTED, PLAIN)
    return F.lower(F.regexp_replace(F.regexp_replace(whole, "[^A-Za-z0-9]+", "_"), r"^_+|_+\z", ""))


def normalize_postcode(code: Column) -> Column:
    """Brings a postal code to dddd-ddd where a known pattern allows it; anything else stays. Null becomes 0000-000.

    The patterns end at the very end of the text, so a line end behind a code makes it no match."""
    c = F.trim(code)
    part = lambda a, n: F.substring(c, a, n)
    zero = F.lit("-000")
    return (
        F.when(c.isNull(), "0000-000")
        .when(c.rlike(r"\A\d{4}-\d{3}\z"), c)
        .when(c.rlike(r"\A\d{4}-\d{2}\z"), F.concat(c, F.lit("0")))
        .when(c.rlike(r"\A\d{4}\z"), F.concat(c, zero))
        .when(c.rlike(r"\A\d{3}\z"), F.concat(c, F.lit("0"), zero))
        .when(c.rlike(r"\A\d{3}-\d{3}\z"), F.concat(F.lit("0"), part(1, 3), zero))
        .when(c.rlike(r"\A\d{2}-\d{3}\z"), F.concat(F.lit("00"), part(1, 2), zero))
        .when(c.rlike(r"\A\d-\d{3}\z"), F.concat(F.lit("000"), part(1, 1), zero))
        .when(c.rlike(r"\A\d{5}\z"), F.concat(part(1, 4), zero))
        .when(c.rlike(r"\A\d{4}-\d{3},"), part(1, 8))
        .otherwise(c)
    )


def postcode_number(code: Column) -> Column:
    """A code's seven digits as a number; null where they aren't digits, instead of failing the job."""
    return F.concat(F.substring(code, 1, 4), F.substring(code, 6, 4)).try_cast("int")


def without_suffix(name: Column) -> Column:
    """A municipality's name without a remark in brackets, which white space goes before."""
    return F.when(name.contains("("), F.regexp_replace(name, r"(.*)\s+\(.*\)", "$1")).otherwise(name)


def island_district(district: Column) -> Column:
    """Districts that name an island, by their archipelago: Madeira, and all other islands are of Açores, as the registry has it."""
    return F.when(district == "Ilha Da Madeira", "Madeira").when(district.like("Ilha D%"), "Açores").otherwise(district)
