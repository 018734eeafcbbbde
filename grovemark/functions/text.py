"""Column expressions over titles, abstracts and tokens."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters the tokeniser deletes (quotes and slashes, then punctuation; the hyphen stays).
DELETED = "\"/\\'" + ".,?;*!%^&_+():<=>@[]{}"
# The characters that Python's str.split() treats as white space, as a regular expression class.
WHITE_SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def document_text(title: Column, abstract: Column) -> Column:
    """Title and abstract with a space between; null when either is null."""
    return F.concat(title, F.lit(" "), abstract)


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def clean_title(title: Column) -> Column:
    """Drop one leading '[', then one trailing '.', then one trailing ']'. Empty stays empty."""
    opened = F.regexp_replace(title, r"^\[", "")
    return F.regexp_replace(F.regexp_replace(opened, r"\.\z", ""), r"\]\z", "")


def tokens(text: Column) -> Column:
    """Lower-cased tokens with punctuation deleted; null for null text."""
    bare = F.translate(F.lower(text), DELETED, "")
    return F.array_remove(F.split(bare, WHITE_SPACE), "")


@cache
def digit_class() -> str:
    """Regular expression class of every character for which str.isdigit() holds."""
    extra = [
        code
        for code in range(sys.maxunicode + 1)
        if unicodedata.category(chr(code)) != "Nd" and chr(code).isdigit()
    ]
    starts = [code for code in extra if code - 1 not in extra]
    ends = [code for code in extra if code + 1 not in extra]
    return r"[\p{Nd}" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]"


def has_digit(word: Column) -> Column:
    return word.rlike(digit_class())


def joined(items: Column) -> Column:
    """Array (or the keys of a map turned into an array) as one ';' separated string."""
    return F.concat_ws(";", items)


def class_keys(index: Column) -> Column:
    """The class keys of a phrase's index as strings, in ascending class order."""
    return F.transform(F.array_sort(F.map_keys(index)), lambda k: k.cast("string"))


def tokens_in_class(tokens_column: Column, index: Column, class_id: int = 1) -> Column:
    """Tokens at the sorted positions the index lists for a class; null when the class is missing."""
    positions = F.array_sort(F.map_keys(F.try_element_at(index, F.lit(class_id))))
    return F.transform(positions, lambda i: F.get(tokens_column, i))


def tokens_outside(tokens_column: Column, inside: Column) -> Column:
    """Distinct tokens that are not among the inside tokens; all of them when inside is null."""
    return F.array_except(tokens_column, F.coalesce(inside, F.array().cast("array<string>")))


def first_part(parts: Column) -> Column:
    return F.get(parts, F.lit(0))
