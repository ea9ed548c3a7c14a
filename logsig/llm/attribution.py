"""Token counts per field or section from one encoding of the whole document.

A document is encoded once; its tokens' character spans (kept in UTF-8 bytes, as tokens
may end inside a character) are interval-joined to its sections, and tokens that cross
a border are allocated by a rule:

- ``first``: to the section that holds the token's first byte;
- ``most``: to the section that holds most of its bytes, the earlier one if equal;
- ``split``: to each section by its part of the bytes.

Sections of a document must not overlap; where they do, a section ends where the next
one starts. Tokens outside of all sections count as ``outside``. Null and empty texts
have no tokens, and their sections count zero. Sections that are null, empty or beyond
the text are counted as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import SLICE, spans

RULES = ("first", "most", "split")
SECTIONS = "array<struct<name string, start int, end int>>"


def line_bounds(text: str) -> np.ndarray:
    """Byte bounds of the lines of a text; a line holds the break that ends it."""
    data = np.frombuffer(text.encode(), np.uint8)
    return np.unique(np.concatenate([[0], np.flatnonzero(data == 10) + 1, [len(data)]]))


def byte_offsets(text: str, at: np.ndarray) -> np.ndarray:
    """Byte offsets of character offsets."""
    if text.isascii():
        return np.minimum(at, len(text))
    data = np.frombuffer(text.encode(), np.uint8)
    starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return starts[np.minimum(at, len(starts) - 1)]


def allocate(
    ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens per section, crossing tokens that touch it, and tokens outside.

    ``ends`` are the tokens' byte ends in order; sections are sorted and disjoint.
    """
    n = len(starts)
    counts, crossing = np.zeros(n), np.zeros(n, np.int64)
    if not len(ends) or not n:
        return counts, crossing, float(len(ends))
    begins = np.concatenate([[0], ends[:-1]])
    # All bounds cut the text into pieces that are inside one section or none.
    bounds = np.unique(np.concatenate([starts, stops, [0, ends[-1]]]))
    owner = np.searchsorted(starts, bounds, side="right") - 1
    owner = np.where((owner >= 0) & (bounds < stops[owner]), owner, n)
    first = np.searchsorted(bounds, begins, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    whole = owner[first] == owner[last]
    whole &= first == last
    total = np.bincount(owner[first[whole]], minlength=n + 1).astype(np.float64)
    for t in np.flatnonzero(~whole):
        share: dict[int, int] = {}
        for piece in range(first[t], last[t] + 1):
            end = bounds[piece + 1] if piece + 1 < len(bounds) else ends[t]
            size = min(end, ends[t]) - max(bounds[piece], begins[t])
            share[int(owner[piece])] = share.get(int(owner[piece]), 0) + int(size)
        inside = [s for s in share if s < n]
        if len(share) > 1:
            crossing[inside] += 1
        if rule == "first":
            total[owner[first[t]]] += 1
        elif rule == "most":
            total[max(share, key=lambda s: (share[s], -s))] += 1
        else:
            for s, size in share.items():
                total[s] += size / sum(share.values())
    return total[:n], crossing, float(total[n])


_COUNT = pa.struct(
    [
        ("name", pa.string()),
        ("start", pa.int32()),
        ("end", pa.int32()),
        ("n_tokens", pa.float64()),
        ("n_crossing", pa.int64()),
    ]
)


def attributed(
    df: DataFrame,
    text: str,
    path: str,
    pattern: str,
    sections: str | Column | None = None,
    rule: str = "most",
) -> DataFrame:
    """``df`` with ``n_tokens``, ``outside`` and ``sections`` (name, start, end, tokens,
    crossing tokens), in characters, by start.

    ``sections`` is a column ``array<struct<name, start, end>>`` in characters; without it the
    lines are the sections, named by their number.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encoding = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}
        )
        sizes = np.zeros(max(ranks.value.values()) + 1, np.int64)
        for token, rank in ranks.value.items():
            sizes[rank] = len(token)
        for texts, given in batches:
            for a, b in spans(texts, SLICE):
                own = texts.slice(a, b - a), given.slice(a, b - a)
                yield _attribute(own[0].to_pylist(), own[1], encoding, sizes, rule)

    schema = (
        "n_tokens bigint, outside double, sections array<struct<name string, start int, "
        "end int, n_tokens double, n_crossing bigint>>"
    )

    @F.arrow_udf(schema)
    def count(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from run(batches)

    given = F.lit(None).cast(SECTIONS) if sections is None else sections
    made = df.select(
        "*",
        count.asNondeterministic()(
            F.col(text), (F.col(given) if isinstance(given, str) else given).cast(SECTIONS)
        ).alias("_made"),
    )
    names = ["n_tokens", "outside", "sections"]
    return made.select(*[c for c in df.columns if c not in names], *[f"_made.{n}" for n in names])


def _attribute(texts, given, encoding, sizes: np.ndarray, rule: str) -> pa.Array:
    tokens, outside, offsets = [], [], [0]
    parts: list[list] = [[], [], [], [], []]
    for text, own in zip(texts, given.to_pylist(), strict=True):
        text = text or ""
        ids = np.array(encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(sizes[ids])
        if own is None:
            bounds = line_bounds(text)
            starts, stops = bounds[:-1], bounds[1:]
            names = [str(i) for i in range(len(starts))]
            # Line borders are characters' borders.
            shown = bounds if text.isascii() else _characters(text, bounds)
            shown_starts, shown_stops = shown[:-1], shown[1:]
        else:
            rows = sorted(
                (max(s["start"] or 0, 0), max(s["end"] or 0, 0), s["name"]) for s in own if s
            )
            names = [r[2] for r in rows]
            shown_starts = np.array([r[0] for r in rows], np.int64)
            shown_stops = np.array([r[1] for r in rows], np.int64)
            starts = byte_offsets(text, shown_starts)
            stops = byte_offsets(text, shown_stops)
            if len(starts):
                stops = np.minimum(stops, np.append(starts[1:], stops[-1]))
                stops = np.maximum(stops, starts)
        counts, crossing, rest = allocate(ends, starts, stops, rule)
        tokens.append(len(ids))
        outside.append(rest)
        offsets.append(offsets[-1] + len(names))
        for part, values in zip(parts, (names, shown_starts, shown_stops, counts, crossing)):
            part.append(values)
    flat = [[n for p in parts[0] for n in p], *(np.concatenate(p or [[]]) for p in parts[1:])]
    inner = pa.StructArray.from_arrays(
        [pa.array(v, f.type) for v, f in zip(flat[:1], list(_COUNT)[:1])]
        + [pa.array(v).cast(f.type) for v, f in zip(flat[1:], list(_COUNT)[1:])],
        names=[f.name for f in _COUNT],
    )
    return pa.StructArray.from_arrays(
        [
            pa.array(tokens, pa.int64()),
            pa.array(outside, pa.float64()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner),
        ],
        names=["n_tokens", "outside", "sections"],
    )


def _characters(text: str, at: np.ndarray) -> np.ndarray:
    """Character offsets of byte offsets at characters' borders."""
    data = np.frombuffer(text.encode(), np.uint8)
    return np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), at)


def joined_fields(fields: dict[str, Column], separator: str = "\n") -> tuple[Column, Column]:
    """One text of several fields, and its sections by field name; null fields are empty."""
    values = {n: F.coalesce(c.cast("string"), F.lit("")) for n, c in fields.items()}
    text = F.concat_ws(separator, *values.values())
    at, sections = F.lit(0), []
    for name, value in values.items():
        end = at + F.length(value)
        sections.append(
            F.struct(F.lit(name).alias("name"), at.alias("start"), end.alias("end"))
        )
        at = end + len(separator)
    return text, F.array(*sections).cast(SECTIONS)
