"""Character classes and small text expressions shared by the jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space a line is stripped of, as characters.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Java regex class bodies (without brackets) for the same notions.
SPACE_CLASS = r"\p{IsWhite_Space}\x1c-\x1f"
WORD_CLASS = r"a-zA-Z0-9_\p{L}\p{N}"


def strip(text: Column) -> Column:
    """Remove white space, Unicode spaces included, from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def text_preview(text: Column, length: int) -> Column:
    """The first ``length`` characters, marked with dots when cut."""
    return F.when(
        F.char_length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))
    ).otherwise(text)


def signature_hash(patterns: Column) -> Column:
    """Twelve hex digits of the md5 of the sorted patterns."""
    return F.substring(F.md5(F.array_join(F.array_sort(patterns), "|")), 1, 12)


def keyword_flags(text: Column, groups: dict[str, Sequence[str]]) -> list[Column]:
    """One boolean column per group: does the text hold any of its words?"""
    lowered = F.lower(text)
    flags = []
    for name, words in groups.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(lowered, F.lit(word.lower()))
        flags.append(hit.alias(name))
    return flags


def join_fields(fields: Column) -> Column:
    return F.array_join(fields, "\t")
