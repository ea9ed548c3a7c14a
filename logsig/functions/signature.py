"""Structural signature of a log line.

A signature is the line's symbols with each outermost quoted or bracketed
region replaced by a mask. Masking is context sensitive (regions nest, a quote
closes only a quote, stray closers vanish, a region that never closes swallows
the rest), so it needs a stack in general. Nearly every real line nests at most
``NESTING`` levels deep and is settled by one linear, possessive regular
expression inside whole-stage codegen; the lines it leaves open go through a
fold over their symbols, which is exact for any depth.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_CLASS, WORD_CLASS

# The regions that get masked, opener to closer.
REGIONS = {'"': '"', "[": "]", "{": "}", "<": ">"}
OPENERS = "".join(REGIONS)
NESTING = 3

_NOT_SYMBOL = f"[{WORD_CLASS}{SPACE_CLASS}]+"


def _cls(chars: str) -> str:
    return "".join("\\" + c for c in chars)


def _region(opener: str, depth: int) -> str:
    """Regex of a closed region that nests at most ``depth`` levels."""
    closer = REGIONS[opener]
    inner = [f"[^{_cls(OPENERS)}{_cls(closer)}]++"]
    if depth > 1:
        inner += [_region(o, depth - 1) for o in OPENERS if o != closer]
    return f"{_cls(opener)}(?:{'|'.join(inner)})*+{_cls(closer)}"


_CLOSED = "|".join(_region(o, NESTING) for o in OPENERS)
_MASKABLE = f"(?=(.))(?:{_CLOSED})(?<=(.))"
_OPEN_LEFT = f"(?<!X)[{_cls(OPENERS)}](?!X)"
# A prefix of settled regions, then an opener whose closer never follows.
_UNCLOSED = f"^(?:{_CLOSED}|[^{_cls(OPENERS)}])*+(?:" + "|".join(
    f"{_cls(o)}[^{_cls(c)}]*+" for o, c in REGIONS.items()
) + ")$"
_STRAY_CLOSER = r"(?<!X)[\}\]\>]"
_THREE_DOTS = r"(?<![^\"\]\}\>])\.\.\.(?![^\"\[\{\<])"


def symbol_skeleton(line: Column) -> Column:
    """All characters that are neither word characters nor white space."""
    return F.regexp_replace(line, _NOT_SYMBOL, "")


def split_symbols(segment: Column) -> Column:
    """Tokens of a run of symbols outside any region."""
    return (
        F.when(segment == "...", F.array(segment))
        .when(segment == "", F.array().cast("array<string>"))
        .otherwise(F.split(segment, ""))
    )


def _spaced(masked: Column) -> Column:
    """Put the tokens of a masked skeleton apart, one space between each."""
    dotted = F.regexp_replace(masked, _THREE_DOTS, "D")
    apart = F.rtrim(F.regexp_replace(dotted, "(.X.|.)", "$1 "))
    return F.replace(apart, F.lit("D"), F.lit("..."))


def _flush(segment: Column) -> Column:
    return F.when(segment == "...", F.lit("... ")).otherwise(
        F.regexp_replace(segment, "(.)", "$1 ")
    )


def mask_by_fold(symbols: Column) -> Column:
    """The exact signature of a symbol string for any nesting depth."""
    start = F.struct(
        F.lit("").alias("open"), F.lit("").alias("run"), F.lit("").alias("done")
    )

    def step(state: Column, sym: Column) -> Column:
        opened, run, done = state["open"], state["run"], state["done"]
        top = F.right(opened, F.lit(1))
        outer = opened == ""
        wanted = F.translate(top, "".join(REGIONS.keys()), "".join(REGIONS.values()))
        closes = ~outer & (sym == wanted)
        opens = sym.isin(*OPENERS)
        stray = sym.isin("]", "}", ">")
        popped = F.left(opened, F.char_length(opened) - 1)
        return (
            F.when(
                closes,
                F.struct(
                    popped.alias("open"),
                    F.lit("").alias("run"),
                    F.when(
                        F.char_length(opened) == 1, F.concat(done, top, F.lit("X"), sym, F.lit(" "))
                    )
                    .otherwise(done)
                    .alias("done"),
                ),
            )
            .when(
                opens,
                F.struct(
                    F.concat(opened, sym).alias("open"),
                    F.lit("").alias("run"),
                    F.when(outer & (run != ""), F.concat(done, _flush(run)))
                    .otherwise(done)
                    .alias("done"),
                ),
            )
            .when(~outer | stray, state)
            .otherwise(
                F.struct(opened.alias("open"), F.concat(run, sym).alias("run"), done.alias("done"))
            )
        )

    def finish(state: Column) -> Column:
        tail = F.when(
            (state["open"] == "") & (state["run"] != ""), _flush(state["run"])
        ).otherwise(F.lit(""))
        return F.rtrim(F.concat(state["done"], tail))

    chars = F.when(symbols == "", F.array().cast("array<string>")).otherwise(F.split(symbols, ""))
    return F.aggregate(chars, start, step, finish)


def signature_of_symbols(symbols: Column) -> Column:
    masked = F.regexp_replace(symbols, _MASKABLE, "$1X$2")
    cut = F.regexp_replace(masked, f"{_OPEN_LEFT}.*$", "")
    return (
        F.when(
            ~F.rlike(masked, F.lit(_OPEN_LEFT)),
            _spaced(F.regexp_replace(masked, _STRAY_CLOSER, "")),
        )
        .when(
            F.rlike(symbols, F.lit(_UNCLOSED)),
            _spaced(F.regexp_replace(cut, _STRAY_CLOSER, "")),
        )
        .otherwise(mask_by_fold(symbols))
    )


def pattern_signature(line: Column) -> Column:
    """Signature of a line: its symbol tokens, regions masked, space-joined."""
    return signature_of_symbols(symbol_skeleton(line))
