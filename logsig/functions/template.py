"""Lines that follow their pattern literally, read with regular expressions.

Where the symbols of a line, its regions closed at their first closer, are just
the tokens of its pattern, reading the line token by token can only stop where a
left-to-right scan stops. One regular expression then yields every part of the
line in linear time and inside generated code. ``follows`` says for which lines
this holds; the callers treat the others with their general fold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .signature import OPENERS, REGIONS, _cls
from .text import SPACE_CLASS, WORD_CLASS, strip

_W, _WS = f"[{WORD_CLASS}]", f"[{WORD_CLASS}{SPACE_CLASS}]"
_SYMBOL = f"[^{WORD_CLASS}{SPACE_CLASS}]"
_PLAIN_SYMBOL = f"[^{WORD_CLASS}{SPACE_CLASS}{_cls(OPENERS)}{_cls(']}>')}]"
_REGION = "|".join(f"{_cls(o)}[^{_cls(c)}]*+{_cls(c)}" for o, c in REGIONS.items())
_TEXT = f"{_W}(?:{_WS}*{_W})?"
# A stretch between regions whose only symbols are three dots.
_DOTTED = (
    rf"(?<![^\"\]\}}\>]){_WS}*+\.{_WS}*+\.{_WS}*+\.{_WS}*+(?=[{_cls(OPENERS)}]|\z)"
)
# An opener without a closer takes the rest of the line with it, once; its lone symbol
# then equals no pattern.
_OUTLINE = f"{_WS}+|" + "|".join(
    rf"({_cls(o)})[^{_cls(c)}]*+({_cls(c)}|\z)" for o, c in REGIONS.items()
)
_MASK = "|".join(f"{_cls(o)}X{_cls(c)}" for o, c in REGIONS.items())
_AT_MASK = rf"(?= [{_cls(OPENERS)}]|\z)"
_STRETCH = (
    rf"(?:\.\.\.|(?!\. \. \.{_AT_MASK}){_PLAIN_SYMBOL}(?: {_PLAIN_SYMBOL})*+){_AT_MASK}"
)
_GENERATED = rf"\A(?:{_MASK}|{_STRETCH})(?: (?:{_MASK}|{_STRETCH}))*+\z"


def follows(line: Column, pattern: Column) -> Column:
    """Does the line consist of exactly its pattern's tokens and plain text?"""
    outline = F.regexp_replace(line, _OUTLINE, "$1$2$3$4$5$6$7$8")
    return (outline == F.translate(pattern, "X ", "")) & F.rlike(pattern, F.lit(_GENERATED))


def is_region(part: Column) -> Column:
    return F.left(part, F.lit(1)).isin(*OPENERS)


def inside(part: Column) -> Column:
    return F.substring(part, F.lit(2), F.char_length(part) - 2)


def _dots(pattern: Column) -> Column:
    return F.contains(pattern, F.lit("..."))


def _split_dotted(part: Column) -> tuple[Column, Column, Column]:
    """Is this a three-dot stretch, and the texts around its first dot."""
    dotted = ~is_region(part) & F.contains(part, F.lit(".")) & (F.char_length(part) > 1)
    return (
        dotted,
        strip(F.substring_index(part, ".", 1)),
        strip(F.substring(part, F.position(F.lit("."), part) + 1, F.char_length(part))),
    )


def content_parts(line: Column, pattern: Column) -> Column:
    """Texts and regions (delimiters kept) of a line that follows its pattern."""
    plain = F.regexp_extract_all(line, F.lit(f"{_REGION}|{_TEXT}"), F.lit(0))

    def spread(part: Column) -> Column:
        dotted, before, after = _split_dotted(part)
        return F.when(dotted, F.filter(F.array(before, after), lambda t: t != "")).otherwise(
            F.array(part)
        )

    with_dots = F.regexp_extract_all(line, F.lit(f"{_REGION}|{_DOTTED}|{_TEXT}"), F.lit(0))
    return F.when(_dots(pattern), F.flatten(F.transform(with_dots, spread))).otherwise(plain)


def masked_text(line: Column, pattern: Column) -> Column:
    """Texts, symbols and masks of a line that follows its pattern, spaced."""

    def mask(part: Column) -> Column:
        return F.when(
            is_region(part), F.concat(F.left(part, F.lit(1)), F.lit("X"), F.right(part, F.lit(1)))
        ).otherwise(part)

    def spread(part: Column) -> Column:
        dotted, before, after = _split_dotted(part)
        return F.when(
            dotted, F.filter(F.array(before, F.lit("..."), after), lambda t: t != "")
        ).otherwise(F.array(mask(part)))

    plain = F.regexp_extract_all(line, F.lit(f"{_REGION}|{_TEXT}|{_SYMBOL}"), F.lit(0))
    with_dots = F.regexp_extract_all(
        line, F.lit(f"{_REGION}|{_DOTTED}|{_TEXT}|{_SYMBOL}"), F.lit(0)
    )
    return F.array_join(
        F.when(_dots(pattern), F.flatten(F.transform(with_dots, spread))).otherwise(
            F.transform(plain, mask)
        ),
        " ",
    )
