"""Positional field extraction: a pattern read as a template for its line.

A line that follows its pattern literally is read by one regular expression inside
generated code. The others, and only they, go to the forward walk in Arrow batches.
Both take time in proportion to the line.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .template import content_parts, follows, inside, is_region
from .text import SPACE_CLASS, WORD_CLASS, strip
from .walk import field_walk

_PURE_SYMBOLS = f"^[^{WORD_CLASS}{SPACE_CLASS}]+$"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def pattern_tokens(pattern: Column) -> Column:
    words = F.split(strip(pattern), f"[{SPACE_CLASS}]+")
    return F.filter(words, lambda w: w != "")


def locate_any(needles: Column, line: Column, start: Column) -> Column:
    """Position of the first needle that occurs at or after ``start``, else 0.

    Needles are tried in order; generated patterns always have exactly one.
    """
    several = F.filter(
        F.transform(needles, lambda n: F.position(n, line, start)), lambda p: p > 0
    )
    return (
        F.when(F.size(needles) == 1, F.position(needles[0], line, start))
        .when(F.size(needles) == 0, F.lit(0))
        .otherwise(F.coalesce(F.get(several, F.lit(0)), F.lit(0)))
    )


def token_kinds(pattern: Column) -> Column:
    """Tokens as ``(kind, token, needles, closer)``; unusable tokens drop out.

    ``needles`` are the characters to look for, ``closer`` ends a region and is
    empty where the token cannot enclose anything.
    """

    def describe(token: Column) -> Column:
        body = F.replace(token, F.lit("X"), F.lit(""))
        kind = (
            F.when(token == "X", F.lit("complex_content"))
            .when(F.rlike(token, F.lit(_PURE_SYMBOLS)), F.lit("symbol"))
            .when(F.contains(token, F.lit("X")), F.lit("enclosed_content"))
        )
        needles = (
            F.when(body == "", F.array().cast("array<string>"))
            .when(body == token, F.array_distinct(F.split(token, "")))
            .otherwise(F.array(F.left(body, F.lit(1))))
        )
        closer = F.when(
            (body != token) & (F.char_length(body) > 1), F.right(body, F.lit(1))
        ).otherwise(F.lit(""))
        return F.struct(
            kind.alias("kind"),
            token.alias("token"),
            needles.alias("needles"),
            closer.alias("closer"),
        )

    return F.filter(
        F.transform(pattern_tokens(pattern), describe), lambda t: t["kind"].isNotNull()
    )


def _unlike(line: Column, pattern: Column) -> tuple[Column, Column]:
    """Line and pattern where the line does not follow the pattern, else null."""
    other = ~follows(line, pattern)
    return F.when(other, line), F.when(other, pattern)


def extract_fields(line: Column, pattern: Column) -> Column:
    """The variable parts of a line, in order."""
    return F.when(
        follows(line, pattern),
        F.transform(
            content_parts(line, pattern), lambda p: F.when(is_region(p), inside(p)).otherwise(p)
        ),
    ).otherwise(F.transform(field_walk(*_unlike(line, pattern)), lambda f: f["text"]))


def categorize_fields(line: Column, pattern: Column) -> Column:
    """The same fields as two lists: plain gaps and enclosed contents."""

    def from_parts(parts: Column) -> Column:
        return F.struct(
            F.filter(parts, lambda p: ~is_region(p)).alias("whitespace_fields"),
            F.transform(F.filter(parts, is_region), inside).alias("x_fields"),
        )

    def from_walk(fields: Column) -> Column:
        def texts(enclosed: bool) -> Column:
            kept = F.filter(fields, lambda f: f["enclosed"] == enclosed)
            return F.transform(kept, lambda f: f["text"])

        return F.struct(
            texts(False).alias("whitespace_fields"), texts(True).alias("x_fields")
        )

    return F.when(
        follows(line, pattern), bind(content_parts(line, pattern), from_parts)
    ).otherwise(bind(field_walk(*_unlike(line, pattern)), from_walk))


def select_fields_unified(fields: Column, indices: Sequence[int]) -> Column:
    """Fields at the given positions, in that order; positions outside drop out."""
    if not indices:
        return F.array().cast("array<string>")
    # Not a lambda over the fields: those may come from Arrow batches.
    return F.array_compact(F.array(*[F.get(fields, F.lit(int(i))) for i in indices if i >= 0]))


def select_fields_dual(
    gaps: Column, enclosed: Column, gap_indices: Sequence[int], enclosed_indices: Sequence[int]
) -> Column:
    return F.struct(
        select_fields_unified(gaps, gap_indices).alias("whitespace_fields"),
        select_fields_unified(enclosed, enclosed_indices).alias("x_fields"),
    )
